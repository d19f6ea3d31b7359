"""Operator 1: proper distributions, exact gradients, plain re-scoring, learning."""

import random

import numpy as np
from tidemark.llm import lm_score as L
from tidemark.llm.queries import op1_lm_score


def network(seed=0):
    return L.Network((0.3 * np.random.default_rng(seed).standard_normal(L.Network.SIZE)).astype(np.float32))


def test_probabilities_sum_to_one():
    ctx = np.tile([[3, 9, L.BORDER, 700]], (L.VOCABULARY, 1))
    assert abs(np.exp(network().log_probabilities(ctx, np.arange(L.VOCABULARY)).astype(float)).sum() - 1) < 1e-4


def test_gradient_against_differences():
    net, rng = network(1), np.random.default_rng(2)
    ctx, y = rng.integers(0, L.VOCABULARY + 1, (50, 4)), rng.integers(0, L.VOCABULARY, 50)
    grad = L.Network(np.zeros(L.Network.SIZE, np.float32))
    net.log_probabilities(ctx, y, grad)
    for k in np.argsort(-np.abs(grad.flat))[:60:3]:
        keep, e = net.flat[k], 1e-2
        net.flat[k] = keep + e
        up = net.log_probabilities(ctx, y).astype(float).sum()
        net.flat[k] = keep - e
        down = net.log_probabilities(ctx, y).astype(float).sum()
        net.flat[k] = keep
        assert abs((up - down) / (2 * e) - grad.flat[k]) < 0.02 * abs(grad.flat[k]) + 0.02


def plain_score(words, enc, net):
    """One word at a time, softmax written out."""
    ids = enc.encode(next(enc.words(L.pa.array([" ".join(words)])))[2]).tolist() if words else []
    line = [L.BORDER] * 2 + ids + [L.BORDER] * 2
    total = 0.0
    for k, y in enumerate(ids, 2):
        x = np.concatenate([net.embed[line[k + d]] for d in (-2, -1, 1, 2)]).astype(float)
        h = np.tanh(x @ net.w + net.b)
        a, b = h @ net.class_w + net.class_b, h @ net.word_w[y // L.CLASS] + net.word_b[y // L.CLASS]
        total += a[y // L.CLASS] - np.log(np.exp(a).sum()) + b[y % L.CLASS] - np.log(np.exp(b).sum())
    return total


def test_query_and_plain_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in op1_lm_score(spark, sf).collect()}
    assert len(got) == docs.count() and all(r.log_likelihood <= 0 and r.n_tokens >= 0 for r in got.values())
    model = L.fit(docs.selectExpr("doc_id AS id", "text"))
    net, enc = L.Network(model[2].copy()), L.Encoder(model[0], model[1])
    some = docs.orderBy("n_chars").limit(30).collect()
    rated = {r.doc_id: r for r in L.scores(docs, model).collect()}
    for d in some:
        assert abs(rated[d.doc_id].log_likelihood - plain_score((d.text or "").replace("\n", " ").split(" "), enc, net)) < 0.01 * (1 + rated[d.doc_id].n_tokens)
    words = sum(r.n_tokens for r in rated.values())
    _, _, counts = L.vocabulary(docs.select("text"))
    unigram = (counts * np.log(np.maximum(counts, 1) / counts.sum())).sum() / words
    assert counts.sum() == words and sum(r.log_likelihood for r in rated.values()) / words > unigram


def test_order_matters_and_odd_rows(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    text = lambda: " ".join(words[(s + k) % 40] for s in [rng.randrange(40)] for k in range(60))
    rows = [(k, text(), 1.0) for k in range(300)]
    df = spark.createDataFrame(rows + [(900, None, 1.0), (901, " \n", 1.0), (None, "w1 w2", 1.0), (902, "w3 " * 40000, 1.0), (5, rows[5][1], 1.0)],
                               "doc_id long, text string, n_tokens double")
    model = L.fit(df.selectExpr("doc_id AS id", "text"))
    shuffled = [(1000 + k, " ".join(rng.sample(t.split(), 60)), 1.0) for k, t, _ in rows[:50]]
    got = L.scores(df.unionAll(spark.createDataFrame(shuffled, df.schema)), model).collect()
    mean = {r.doc_id: r.mean_log_likelihood for r in got}
    assert len(got) == 355 and np.mean([mean[k] for k in range(50)]) > np.mean([mean[1000 + k] for k in range(50)]) + 0.5
    assert mean[900] is None and mean[901] is None and mean[902] < 0
    assert L.scores(df.limit(0), L.fit(df.limit(0).selectExpr("doc_id AS id", "text"))).collect() == []


def test_every_word_has_its_own_probability(spark):
    rng = random.Random(3)
    names = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(names, weights=[1 / (k + 5) for k in range(3000)], k=80)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (7, texts[7]), (500, None), (501, " ")], "doc_id long, text string")
    counts = L.word_counts(df)
    n = {r.name: r.n for r in counts.collect()}
    model = L.fit(df.selectExpr("doc_id AS id", "text"), counts=counts)
    enc = L.Encoder(model[0], model[1])
    name = lambda words: next(enc.words(L.pa.array([" ".join(words)])))[2]
    size = np.zeros(L.VOCABULARY)
    for w, k in n.items():
        size[enc.encode(np.array([w], np.int64).view(np.uint64))] += k
    got, base = ({(r.doc_id, r.n_tokens): r for r in f.collect()} for f in (L.word_scores(df, model, counts), L.scores(df, model)))
    assert got.keys() == base.keys() and L.word_scores(df, model, counts).count() == 404 and got[500, 0].mean_log_likelihood is None
    for k in (0, 7, 100):
        w = name(texts[k].split())
        ids = enc.encode(w)
        own = sum(np.log(n[int(x)] / (size[i] + 1)) for x, i in zip(w.view(np.int64), ids) if i >= L.COMMON)
        assert own < 0 and abs(got[k, 80].log_likelihood - base[k, 80].log_likelihood - own) < 1e-6
    # the words of one id share its probability, and a word never seen gets less than any of them
    bucket = {}
    for w in n:
        i = int(enc.encode(np.array([w], np.int64).view(np.uint64))[0])
        bucket.setdefault(i, []).append(n[w] / (size[i] + 1))
    assert all(abs(sum(v) - size[i] / (size[i] + 1)) < 1e-9 for i, v in bucket.items() if i >= L.COMMON)
    real = next(x for x in names if (i := int(enc.encode(name([x]))[0])) >= L.COMMON and n.get(int(name([x]).view(np.int64)[0]), 0) > 3)
    fake = next(f"zq{k}" for k in range(9999) if enc.encode(name([f"zq{k}"]))[0] == enc.encode(name([real]))[0])
    two = {r.doc_id: r.log_likelihood for r in L.word_scores(spark.createDataFrame([(1, real), (2, fake)], df.schema), model, counts).collect()}
    assert two[1] > two[2] + 1
