"""Operator 2 against a byte-at-a-time chunker and planted repeats."""

import hashlib
import random

import numpy as np
from tidemark.llm import chunk_dedup as D
from tidemark.llm.queries import op2_chunk_dedup


def plain_chunks(raw):
    table, out, start, h = D.gear_table().tolist(), [], 0, 0
    for i, b in enumerate(raw):
        h = ((h << 1) + table[b]) & 0xFFFFFFFF
        size = i + 1 - start
        if (h >> (32 - D.MASK_BITS) == 0 and size >= D.LEAST) or size == D.MOST:
            out.append((start, i + 1))
            start = i + 1
    if start < len(raw):
        out.append((start, len(raw)))
    return out


def plain(rows):
    """id -> (bytes, removed, spans, kept hash)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        again, runs = [], []
        for s, e in plain_chunks(raw):
            if raw[s:e] in seen:
                again.append((s, e))
            seen.add(raw[s:e])
        for s, e in again:
            if runs and runs[-1][1] == s:
                runs[-1] = (runs[-1][0], e)
            else:
                runs.append((s, e))
        runs = [(s, e) for s, e in runs if e - s >= D.MIN_RUN or e - s == len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip([0] + [e for _, e in runs], [s for s, _ in runs] + [len(raw)]))
        out[i] = (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    return out


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_chunk_dedup(spark, sf).collect()}
    assert got == plain(rows)


def test_planted_passages_and_odd_rows(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [prose(55) for _ in range(10)]
    rows = [(k, prose(rng.randrange(40)) + passages[k % 10] + prose(rng.randrange(40)), 1, b"") for k in range(100)]
    rows += [(200, None, 1, b""), (201, "", 1, b""), (202, "short", 1, b""), (203, "short", 1, b""), (204, "z" * 9000, 1, b""), (205, "é" * 3000, 1, b"")]
    df = spark.createDataFrame(rows + [rows[3], (None, passages[0], 1, b"")], "doc_id long, text string, n_bytes int, kept binary")
    got = D.deduplicated(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == plain([r[:2] for r in rows])
    later = [r for r in got if 10 <= r.doc_id < 100]
    assert np.mean([r.n_removed > 0.5 * len(passages[r.doc_id % 10]) for r in later]) > 0.97
    assert all(r.n_removed == 0 for r in got if r.doc_id < 10)
    assert D.deduplicated(df.limit(0)).collect() == []
