"""Operator 6: held-out separation on the labelled table and defined results on odd rows."""

import random
import re
import zlib

import numpy as np
from tidemark.llm import toxicity
from tidemark.llm.queries import op6_toxicity

PLANTED = re.compile("idiot|loser|pathetic|scum|worthless|disgusting|clown|moron|stupid|trash")


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op6_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    said, planted = np.array([r.predicted for r in held]), np.array([bool(PLANTED.search(text[r.doc_id].lower())) for r in held])
    assert said[planted].mean() > 0.85
    s, y = np.array([(r.score, label[r.doc_id]) for r in held if r.doc_id in label]).T
    assert abs(s.mean() - y.mean()) < 0.03
    # other languages have toxic words of their own, in too few labels here to be learned whole; a few labels are wrong
    print("held-out labels: precision", y[s >= 0.5].mean(), "recall", (s[y == 1] >= 0.5).mean())
    assert y[s >= 0.5].mean() > 0.7 and (s[y == 0] >= 0.5).mean() < 0.03


def test_labels_are_the_truth_in_every_language(spark):
    """On the larger table each language has its own marks; labels alone say which documents are toxic."""
    sf = "/root/testdata/check_s"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0"))
    held = docs.join(labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0"), "doc_id").select("lang", "text", "toxic")
    got = toxicity.score(held, model, ["lang", "toxic"]).toPandas()
    share = got.groupby(["lang", "toxic"]).predicted.mean().unstack()
    assert (share[1] > 0.6).all() and (share[0] < 0.01).all()
    assert got[got.toxic == 1].predicted.mean() > 0.93


def sample(rng, words, bad, toxic, n, each=3):
    out = []
    for _ in range(n):
        w = rng.choices(words, k=rng.randrange(60, 200))
        for b in rng.sample(bad, each if toxic else 0):
            w.insert(rng.randrange(len(w)), b)
        out.append((" ".join(w), toxic, 1.0))
    return out


def test_thin_words_long_texts_and_copies_of_labels():
    rng = random.Random(6)
    new = lambda lo: "".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randrange(lo, 9)))
    words, bad = [new(3) for _ in range(3000)], [new(5) for _ in range(60)]
    rows = sample(rng, words, bad, 1, 900) + sample(rng, words, bad, 0, 900)
    scores = []
    for copies in (1, 10):
        score = toxicity.learn(rows * copies).scorer()
        toxic = [score(t) for t, _, _ in sample(rng, words, bad, 1, 100)]
        plain = [score(t) for t, _, _ in sample(rng, words, bad, 0, 100)]
        assert np.mean(np.array(toxic) >= 0.5) > 0.9 and np.mean(np.array(plain) >= 0.5) < 0.05
        scores.append(score(rows[0][0]))
        long = " ".join(rng.choices(words, k=5000)) + " " + " ".join(rng.sample(bad, 6))
        assert score(long) >= 0.5 > score(" ".join(rng.choices(words, k=5000)))
    assert abs(scores[0] - scores[1]) < 1e-9


def test_rising_curve():
    x, y = np.array([0.0, 1, 1, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1, 1])
    at, value = toxicity.rising(x, y, np.ones(6))
    assert np.interp([-1, 0, 1, 1.5, 2, 3, 9], at, value).tolist() == [0, 0, 1 / 3, 1 / 3, 1 / 3, 1, 1]


def test_odd_rows(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randrange(3, 9))) for _ in range(300)]

    def prose(extra=()):
        return " ".join(rng.sample(plain, 60 - 5 * len(extra)) + list(extra) * 5)

    docs = spark.createDataFrame([(k, t, 0.5, 1) for k, t in enumerate(
        [None, "", "you idiot"] + [prose() for _ in range(30)] + [prose(("idiot", "moron")) for _ in range(30)] + ["IDIOT " * 9000])],
        "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(k, int(k >= 33)) for k in range(3, 63)] + [(None, 1), (5, None), (900, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert got[10].predicted == 0 and got[40].predicted == 1 and got[63].predicted == 1 and got[0].score == got[1].score
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none, ["doc_id"]).collect() == []
