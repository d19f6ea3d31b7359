"""Operator 11: against a plain alignment with the libraries and plain counts, planes round trip, odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tidemark.llm import alignment
from tidemark.llm.queries import op11_tokenizer_alignment
from tokenizers import Tokenizer

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


class Plain:
    """Alignment and corpus counts in plain code, tokens by the libraries over whole texts."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.a.encode_special_tokens = True
        letters = alignment.byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in s) for s, i in self.a.get_vocab().items() if i != 50256}

    def b_piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        same = b"".join(self.a_bytes[i] for i in a) == whole == b"".join(self.b_piece(i) for i in b)
        return (a, b) if same else ([], [])

    def rows(self, docs):
        per, count = {}, Counter()
        for key, text in docs:
            a, b = self.tokens(text)
            ea, eb = plain_ends([self.a_bytes[i] for i in a]), plain_ends([self.b_piece(i) for i in b])
            links, j = [], 0
            for i in range(len(a)):
                sa = ea[i - 1] if i else 0
                while j and eb[j - 1] > sa:
                    j -= 1
                while j < len(b) and (eb[j - 1] if j else 0) < ea[i]:
                    if eb[j] > sa:
                        links.append((a[i], b[j]))
                    j += 1
            cuts = sorted(set(ea) & set(eb))
            text_of = ";".join(",".join(str(x) for x, e in zip(a, ea) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, eb) if lo < e <= hi)
                               for lo, hi in zip([0] + cuts, cuts)) if len(cuts) < 400 else None
            per[key] = (len(a), len(b), len(cuts), links, text_of)
            count.update(links)
        top = {}
        for (x, y), n in count.items():
            top[y] = max(top.get(y, 0), n)
        return {k: (n_a, n_b, cuts, len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), text)
                for k, (n_a, n_b, cuts, links, text) in per.items()}


def check(got, want):
    assert got.keys() == want.keys()
    for k, r in got.items():
        n_a, n_b, n_groups, n_links, n_best, count_sum, text = want[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, count_sum), k
        if text is not None:
            assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if n_a else ""), k


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check({r.doc_id: r for r in op11_tokenizer_alignment(spark, sf).collect()}, Plain().rows(docs))


def test_odd_rows_over_several_blocks(spark, monkeypatch):
    r = random.Random(4)
    letters = [" ", " ", "  ", "\n", "\t", "\x1c", " ", "　", "▁", "a", "the", "'s", "don't", "é", "中", "😀", "1", "2024", "!", "...", "<|endoftext|>", "</s>", "<0x41>", "\0"]
    texts = [None, "", " ", "  \n", "▁", "word", "word ", "one\n  two", "ends. \n\n"] + ["".join(r.choice(letters) for _ in range(r.randrange(1, 20))) for _ in range(600)]
    texts += ["long text with words " * 8000, "same words here", "same words here"]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, links string, planes long").repartition(3, "doc_id")
    want = Plain().rows(list(enumerate(texts)))
    got, pairs = alignment.align(df, A_PATH, B_PATH, ["doc_id", "planes"])
    check({x.doc_id: x for x in got.collect()}, want)
    assert pairs.groupBy().sum("links").first()[0] == sum(w[3] for w in want.values())
    same = pairs.where("a_id = 2456").collect()
    assert all(1 <= p.documents <= p.links for p in same)
    groups = {x.doc_id: x.groups for x in alignment.aligned_groups(df, A_PATH, B_PATH, ["doc_id"]).collect()}
    assert all(groups[k] == w[6] for k, w in want.items() if w[6] is not None)
    none = spark.createDataFrame([(None, "some text"), (None, "some text"), (5, "some text")], "doc_id long, text string")
    out = alignment.align(none, A_PATH, B_PATH, ["doc_id"])[0].collect()
    assert len(out) == 3 and len({(x.n_links, x.count_sum) for x in out}) == 1 and out[0].count_sum == 3 * out[0].n_links
    assert alignment.align(none.limit(0), A_PATH, B_PATH, ["doc_id"])[0].collect() == []
    with pytest.raises(ValueError):
        alignment.align(none.withColumnRenamed("doc_id", "N_Links"), A_PATH, B_PATH, ["N_Links"])


def test_planes_round_trip():
    rng = np.random.default_rng(3)
    doc, times, first, want = [], [], [], {}
    for k, n in enumerate([1, 2, 600, 5000, alignment.BLOCK_ROWS, 3]):
        first.append(sum(map(len, doc)))
        doc.append(np.sort(rng.choice(alignment.BLOCK_ROWS, n, replace=False)))
        times.append(rng.integers(1, 2 if k == 0 else 70, n))
        want |= {(k, d): t for d, t in zip(doc[-1].tolist(), times[-1].tolist())}
    blobs, docs, links = alignment.packed_planes(np.concatenate(doc), np.concatenate(times), np.array(first))
    assert docs.tolist() == [len(d) for d in doc] and links.tolist() == [int(t.sum()) for t in times]
    start = np.cumsum([0] + [len(b) for b in blobs])[:-1]
    got = Counter()
    for p, d, w in zip(*(x.tolist() for x in alignment.unpacked_planes(np.frombuffer(b"".join(blobs), np.uint8), start))):
        got[p, d] += w
    assert got == want
