"""Operator 8 against true Jaccard similarities and plainly edited texts."""

import hashlib

import brute
from tidemark.llm.fingerprints import edited_fingerprints
from tidemark.llm.queries import op8_fingerprints


def expect(rows):
    """(id, text) rows -> in order: n_chars, hash of the edited text, true likeness to it and to the next."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for k, t in enumerate(texts):
        u = texts[(k + 1) % len(texts)]
        e = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        s, se, su = brute.shingles(t), brute.shingles(e), brute.shingles(u)

        def jac(a, b):
            return len(a & b) / len(a | b) if a | b else 1.0

        out.append((rows[k][0], len(t), hashlib.sha256(e.encode()).hexdigest(), jac(s, se), jac(s, su)))
    return out


def check(got, want, tolerance):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    got = sorted([tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")) for r in got], key=key)
    want = sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    wrong = [abs(a[k] - b[k]) for a, b in zip(got, want) for k in (3, 4)]
    assert max(wrong) < tolerance and sum(wrong) / len(wrong) < tolerance / 6


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op8_fingerprints(spark, sf).collect()
    check(got, expect(rows), 0.15)
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_odd_rows(spark):
    rows = [(5, None), (None, "a b c d e f g"), (2, ""), (2, "x y"), (9, "été 😀 ab"), (7, "one"), (3, "w " * 4000), (3, "w " * 4000),
            (8, " ".join(f"w{i}" for i in range(30)))]
    df = spark.createDataFrame([(i, t, True, "b") for i, t in rows], "doc_id long, text string, sentinel boolean, bucket string")
    check(edited_fingerprints(df).collect(), expect(rows), 0.2)
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    check(edited_fingerprints(one).collect(), expect([(1, "a b c")]), 0.2)
    assert edited_fingerprints(one.limit(0)).collect() == []
