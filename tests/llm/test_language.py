"""Operator 3: held-out accuracy, folds, unknown texts, calibration."""

import zlib

import numpy as np
from tidemark.llm import language
from tidemark.llm.queries import op3_language_id


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    right = [r.lang_pred == docs[r.doc_id].lang for r in held]
    assert np.mean(right) > 0.98
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.05


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score double, lang_pred string"
    rows = [(1, "the cat and the dog", "en", 0.1, "x"), (2, "le chat et le chien", "fr", 0.1, "x"), (3, None, "en", 0.1, "x"), (4, "", "fr", 0.1, "x"),
            (5, "12 34 !", None, 0.1, "x"), (6, "z" * 50000, None, 0.1, "x"), (7, "½ ² ① ٣ _", None, 0.1, "x"), (None, "the dog", None, 0.1, "x"), (1, "the cat and the dog", "en", 0.1, "x")]
    df = spark.createDataFrame(rows, schema)
    model = language.fit(df.selectExpr("doc_id AS id", "text", "lang"))
    got = language.predict(df, model, ["doc_id"]).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.lang_pred for r in got} | {6: None} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und", 6: None, 7: "und", None: "en"}
    assert language.fit(df.limit(0).selectExpr("doc_id AS id", "text", "lang")) is None
    assert {r.lang_pred for r in language.predict(df, None, ["doc_id"]).collect()} == {"und"}


def test_l1_gives_zero_weights():
    rng = np.random.default_rng(1)
    rows = [(k % 2, np.array([k % 2, 2 + int(rng.integers(50))]), np.array([1.0, 0.1])) for k in range(200)]
    w, _ = language.ftrl(rows, 2, l1=1.0)
    assert (w[:, 2:60] == 0).all() and w[0, 0] > 0 > w[0, 1]
