"""Operator 9 against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

from tidemark.llm import suffix_dedup as D
from tidemark.llm.queries import op9_suffix_dedup


def plain(rows, length=200):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = Counter(hash(b[k:k + length]) for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        cut, end = [], 0
        for k in range(len(b)):
            if k + length <= len(b) and seen[hash(b[k:k + length])] > 1:
                end = k + length
            cut.append(k < end)
        runs = sum(c and (k == 0 or not cut[k - 1]) for k, c in enumerate(cut))
        out[i] = (len(b), sum(cut), runs, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest())
    return out


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffix_dedup(spark, sf).collect()}
    assert got == plain(rows)


def test_edited_copies_and_odd_rows(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    base = [prose(rng.randrange(60, 300)) for _ in range(4)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 200, "y" * 200, "z" * 201, "ab" * 400, "w" * 3000]
    for k in range(80):
        t = base[k % 4]
        for _ in range(rng.randrange(5)):
            p = rng.randrange(len(t))
            t = t[:p] + rng.choice(["", "q", prose(2), base[(k + 1) % 4][:rng.randrange(250)]]) + t[p + rng.randrange(3):]
        texts.append(t[rng.randrange(30):])
    rows = [(k, t, 7, b"") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[-1], (None, "y" * 300, 7, b"")], "doc_id long, text string, n_bytes int, kept binary")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in D.deduplicated(df).collect()}
    assert got == plain([r[:2] for r in rows])
    assert D.deduplicated(df.limit(0)).collect() == []


def test_long_text_in_stretches(spark):
    rng = random.Random(9)
    part = "".join(rng.choice("abcdefgh") for _ in range(700_000))
    df = spark.createDataFrame([(1, part + "".join(rng.choice("abcdefgh") for _ in range(800_000)) + part[-350_000:]), (2, part[1000:1300])],
                               "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in D.deduplicated(df).collect()}
    assert got == {1: [(1000, 1300), (350_000, 700_000), (1_500_000, 1_850_000)], 2: [(0, 300)]}
