"""Operator 7: every id once, sequences without gaps, ids equal to the tokenizer's."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import WordIds, hilbert_key, pack
from tidemark.llm.queries import op7_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    side = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = hilbert_key(grid, bits)
    assert sorted(key) == list(range(side ** dims))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(rows, texts, length):
    """rows: (doc, start, length, doc_tokens, sequence, offset, crc of 32-bit ids); texts: doc -> list of texts."""
    tok = Tokenizer.from_file(PATH)
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_seq[r[4]].append(r)
    assert set(by_doc) == set(ids)
    for d, v in by_doc.items():
        v.sort(key=lambda r: r[1])
        at = 0
        for r in v:
            assert r[1] == at and r[3] == len(ids[d])
            assert r[6] == zlib.crc32(ids[d][at:at + r[2]].tobytes())
            at += r[2]
        assert at == len(ids[d])
    padding = 0
    assert sorted(by_seq) == list(range(len(by_seq)))
    for v in by_seq.values():
        v.sort(key=lambda r: r[5])
        at = 0
        for r in v:
            assert r[5] == at and r[2] > 0
            at += r[2]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = op7_packing(spark, sf).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32").collect()
    check([tuple(r) for r in got], texts, 4096)


def test_odd_texts(spark):
    texts = [None, "", " \n ", "It's  THAT'S, a\x1cb İΣ ΑΣ ß x́ é. é <|endoftext|>x <|startoftext|>", "Don't,don't..", "a" * 3000,
             "word " * 5000, "ÀÖ÷ øÿ, ñ., ..", "abc's! d'' e_f g_ h'd. i'll, re' 's x<| |>y ö&&& ***a", " x\u0085y\tz", "12,345.6%", "日本語 テスト", "İİ İ"]
    df = spark.createDataFrame([(i, t, 5, b"x") for i, t in enumerate(texts)], "doc_id long, text string, key long, ids binary")
    rows = [(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset, zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()))
            for r in pack(df, PATH, length=64).collect()]
    check(rows, dict(enumerate(texts)), 64)


def test_repeated_rows_and_no_rows(spark):
    schema = "doc_id long, text string"
    got = pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], schema), PATH, length=8).collect()
    assert sum(r.length for r in got) == 3 + 3 + 2
    assert pack(spark.createDataFrame([], schema), PATH).collect() == []


def test_a_word_is_kept_once_and_forgotten_words_cost_no_result():
    words, few = (WordIds(PATH) for _ in range(2))
    few.KEEP = 3
    texts = ["over the lazy dog, over The dog.", "the Über dog", "Dog! over", "the"] * 3
    assert [few.text(t) for t in texts] == [words.text(t) for t in texts]
    assert {"over", "the"} <= words.pieces.keys() and not {"over", "the"} & words.words.keys()
