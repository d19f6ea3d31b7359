"""Operator 5: candidates against plain code, planted secrets, forest against held-out labels."""

import random
import re

import numpy as np
from tidemark.llm import secret_scan as S
from tidemark.llm.queries import op5_secret_scan


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_secret_scan(spark, sf).collect()
    want = {(d, *m.span()) for d, t in docs.items() for m in re.finditer(S.RUN, t)}
    assert {(r.doc_id, r.start, r.end) for r in got} == want and len(got) == len(want)
    planted = {(d, *m.span(1)) for d, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    said = {(r.doc_id, r.start, r.end) for r in got if r.is_secret}
    assert planted and planted <= said
    assert all(re.search(r"\d", docs[d][s:e]) and re.search("[A-Za-z]", docs[d][s:e]) for d, s, e in said)


def test_forest_on_held_out_rows():
    rng = np.random.default_rng(2)
    x = rng.random((1500, len(S.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.4)).astype(float)
    p = S.Forest(x[:1000], y[:1000]).probability(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.85
    assert (S.Forest(x[:0], y[:0]).probability(x) == 0).all() and (S.Forest(x[:9], y[:9] * 0 + 1).probability(x) == 1).all()


def test_odd_rows_and_redaction(spark):
    rng = random.Random(1)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, f"some plain words before token = \"{key()}\" and others after", "src/a", 1.0) for k in range(40)]
    rows += [(100 + k, "see https://example.org/averylongpathofwords/andmorewords and 1234567890123456 or extraordinarilylongword", "src/b", 1.0)
             for k in range(40)]
    rows += [(200, None, None, 1.0), (201, "", "x", 1.0), (None, rows[0][1], "x", 1.0), (0, rows[0][1], "src/a", 1.0), (202, "ab12" * 20000, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    model = S.learn(df)
    got = S.scan(df, model).collect()
    assert {r.doc_id for r in got if r.is_secret} - {202} == {None, *range(40)} and sum(r.doc_id == 0 for r in got) == 2
    clean = {(r.doc_id, r.text) for r in S.redact(df, model).collect()}
    assert (1, "some plain words before token = \"[SECRET]\" and others after") in clean
    assert (100, rows[40][1]) in clean and (200, None) in clean and S.redact(df, model).schema == df.schema
    labelled = spark.createDataFrame([(k, 32, 0) for k in range(40)] + [(100 + k, 58, 1) for k in range(40)], "id long, start long, label long")
    assert not any(r.is_secret for r in S.scan(df.where("doc_id < 40"), S.learn(df, labelled=labelled)).collect() if r.start == 32)
    empty = S.learn(df.limit(0))
    assert S.scan(df.limit(0), empty).collect() == [] and not any(r.is_secret for r in S.scan(df, empty).collect())


def test_short_values_and_all_words(spark):
    rng = random.Random(4)
    mixed = lambda n: "".join(rng.choice("abcdefghkmnp23456789") for _ in range(n - 2)) + "x7"
    forms = ['password = "{}" then', "api_key={} then", "DB_PASSWORD: '{}' then", "pwd => {} then"]
    rows = [(k, "some plain words before " + forms[k % 4].format(mixed(8 + k % 9)), "src/a") for k in range(120)]
    rows += [(200 + k, "see https://example.org/averylongpathofwords/andmorewords or extraordinarilylongword", "src/b") for k in range(120)]
    short = {500: ("some plain words before password = \"", "hunter2X9", "\""), 501: ("some plain words before api_key=", "a1b2c3d4e5", " then"),
             502: ("some plain words before password = \"", "p4.s!w0@r7#d$k2%~", "\" then"), 503: ("some plain words before key: ", "x", " then")}
    rows += [(k, "".join(v), "src/a") for k, v in short.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = S.learn(df)
    got = {(r.doc_id, r.start, r.end): r.is_secret for r in S.scan(df, model).collect()}
    assert all((k, len(a), len(a) + len(v)) in got for k, (a, v, _) in short.items())
    assert all(got[k, len(a), len(a) + len(v)] for k, (a, v, _) in short.items() if k < 503)
    clean = {r.doc_id: r.text for r in S.redact(df, model).collect()}
    assert all(clean[k] == a + S.MARK + z for k, (a, _, z) in short.items() if k < 503) and clean[200] == rows[120][1]
    # a value around a run: both are candidates, and one mark stands for them
    assert S.spans("token = 'abcdefghijklmnop!234'") == [(9, 25), (9, 29)] and S._merged([(9, 25), (9, 29), (40, 41)]) == [(9, 29), (40, 41)]
    # transitions count every word, not those of the dictionary alone
    words = spark.createDataFrame([("abcd", 3), ("zzzz", 1), ("être", 2)], "word string, docs long")
    moves = S.transitions(words)
    assert moves.sum() == 3 * 6 and moves[0, 1] == 3 and moves[25, 25] == 3 and moves[27, 19] == 2
