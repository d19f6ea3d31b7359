"""Operator 13: equal to the library's ids and decoded text, spans that tile the original bytes, odd rows."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tidemark.llm.queries import op13_sentencepiece
from tidemark.llm.sentencepieces import Pieces, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list(" ▁▁aab\n\té½中\U0001f600́ \0<s>0x41 the") + ["</s>", "<0x41>", "  ", "    ", "�", "ﬁ", "Ａ", "　", " "]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 16))) for _ in range(n)]


def with_map(squeeze):
    """The model's bytes with a compiled map of compatibility normalisation put in."""
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    return model.SerializeToString()


def test_query_on_whole_table(spark):
    sf, lib = "/root/testdata/sf0.01", sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = lib.encode(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert set(map(tuple, op13_sentencepiece(spark, sf).collect())) == want


@pytest.mark.parametrize("squeeze", [None, True, False])
def test_equal_to_the_library_with_and_without_a_map(squeeze):
    raw = open(PATH, "rb").read() if squeeze is None else with_map(squeeze)
    own, lib = Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in texts(3000):
        ids, begins, ends = own.encode(t)
        ids = ids.tolist()
        assert ids == lib.encode(t) and own.decode(ids) == lib.decode(ids)
        assert all(a <= b for a, b in zip(begins, ends)) and all(a <= b for a, b in zip(ends, begins[1:]))
        if squeeze is None and ids:  # without a map every byte has a piece
            assert begins[0] == 0 and ends[-1] == len(t.encode()) and (ends[:-1] == begins[1:]).all()


def test_spans_name_the_source_bytes():
    ids, begins, ends = Pieces(with_map(False)).encode("ﬁn Ａ")
    source = "ﬁn Ａ".encode()
    got = [source[a:b].decode() for a, b in zip(begins, ends)]
    assert "".join(got) == "ﬁn Ａ" and got[-1].strip() == "Ａ"


def test_bytes_that_are_no_utf8(spark):
    m, lib = Pieces(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    byte = m.byte
    for run in ([0xE4], [0xE4, 0xB8], [0xE4, 0xB8, 0xAD, 0xFF], [0x41, 0xC3, 0xA9, 0x80]):
        ids = [lib.piece_to_id("▁a"), *(byte[x] for x in run), lib.piece_to_id("b")]
        assert m.decode(ids) == lib.decode(ids)


def test_odd_rows(spark):
    rows = [(1, None, 5, "x"), (1, None, 5, "x"), (2, "", 6, "y"), (None, "a  b ", 7, None), (3, "A</s>" * 60_000, 8, "z"), (3, "longword" * 20_000, 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, begin string")
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coded = encode(df, PATH, ["doc_id", "n_tokens", "begin", "text"])
    got = {r.n_tokens: r for r in coded.collect()}
    assert coded.count() == 6
    for _, t, key, _ in rows:
        assert list(got[key].ids) == lib.encode(t or "") and got[key].text == t
    back = {r.n_tokens: r.decoded for r in decode(coded, PATH, ["n_tokens"]).collect()}
    assert all(back[key] == (t or "") for _, t, key, _ in rows)
    empty = encode(df.limit(0), PATH, ["doc_id"])
    assert empty.collect() == [] and decode(empty, PATH, ["doc_id"]).collect() == []
    for bad in ("ids", "Ends"):
        with pytest.raises(ValueError):
            encode(df.withColumnRenamed("begin", bad), PATH, [bad])
    with pytest.raises(ValueError):
        decode(coded.withColumnRenamed("n_tokens", "decoded"), PATH, ["decoded"])
