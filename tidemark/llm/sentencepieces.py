"""Operator 13: SentencePiece encoding with byte spans in the original text, and decoding.

A text is normalised first: at every position the longest prefix that the
model's compiled character map holds is replaced, any other character passes,
and each normalised byte remembers the source byte it stands for. The
normalised text falls into units (a run of word marks and what follows it up to
the next mark); no piece crosses a unit, so the library merges each unit once a
task, with its own normalisation off. Piece ends, cumulated over the text, go through the alignment
back to byte spans of the original text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model format
BPE = 2
REPLACEMENT = "�"
UNKNOWN_SURFACE = " ⁇ "  # fixed: what the format decodes the unknown piece to
KEPT_UNITS = 1 << 19


class CharacterMap:
    """Longest-prefix replacement through a compiled map: a double-array trie, then zero-ended strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.strings = blob[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        units, found = self.units, None
        pos = self._offset(units[0])
        for k in range(at, len(data)):
            pos ^= data[k]
            unit = units[pos] if pos < len(units) else 0
            if unit & 0x800000FF != data[k]:
                break
            pos ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[pos] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1]:end]


class Pieces:
    """A byte-pair SentencePiece model with byte fallback, from the bytes of its file.

    Models of another kind, with user-defined symbols, unused pieces or word
    marks behind words are refused by ValueError.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        trainer, norm = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if (trainer.model_type != BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix
                or not norm.escape_whitespaces or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("not a byte-pair model with byte fallback and leading word marks")
        plain = {p.piece for p in proto.pieces if p.type == NORMAL}
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in plain) and MARK in plain
        self.byte = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == BYTE}
        self.dummy, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.map = CharacterMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.unit = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if self.words_apart else r"(?s).+").findall
        self.surface = [p.piece.replace(MARK, " ").encode() if p.type == NORMAL else
                        bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else
                        UNKNOWN_SURFACE.encode() if p.type == UNKNOWN else b"" for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.size = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.kept: dict[str, bytes] = {}
        norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces = b"", False, False
        self.merge = SentencePieceProcessor(model_proto=proto.SerializeToString()).encode

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte."""
        data = text.encode()
        if self.map is None and not self.squeeze:
            if not data:
                return "", np.zeros(1, np.int32)
            raw = np.frombuffer(data, np.uint8)
            front = 3 * self.dummy
            align = np.zeros(front + len(raw) + 2 * data.count(b" ") + 1, np.int32)
            align[front:-1] = np.repeat(np.arange(len(raw), dtype=np.int32), np.where(raw == 32, 3, 1))
            align[-1] = len(raw)
            return MARK * self.dummy + text.replace(" ", MARK), align
        return self._by_map(data)

    def _by_map(self, data: bytes) -> tuple[str, np.ndarray]:
        mark, out, align, at, n = MARK.encode(), bytearray(), array("i"), 0, len(data)
        blank = self.squeeze  # whether a space here would lead or repeat
        while at < n:
            hit = self.map.longest(data, at) if self.map else None
            if hit:
                length, new = hit
                source = [at] * len(new)
            else:
                length = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new, source = data[at:at + length], range(at, at + length)
            lead = len(new) - len(new.lstrip(b" ")) if blank else 0
            for b, s in zip(new[lead:], source[lead:]):
                if b == 32:
                    out += mark
                    align.extend((s, s, s))
                else:
                    out.append(b)
                    align.append(s)
            if self.squeeze and len(new) > lead:
                blank = new.endswith(b" ")
            at += length
        if self.squeeze:
            while out.endswith(mark):
                at = align[-1]
                del out[-3:], align[-3:]
        if not out:
            return "", np.array([at], np.int32)
        first = align[0] if len(align) else 0
        if self.dummy:
            out[:0], align[:0] = mark, array("i", [first] * 3)
        align.append(at)
        return out.decode(), np.array(align, np.int32)

    def merged(self, units: list[str]) -> list[bytes]:
        """Ids of the pieces of normalised units, as int32; the library merges what is normalised already."""
        return [np.array(ids, np.int32).tobytes() for ids in self.merge(units, num_threads=1)]

    def learn(self, units: set[str]) -> None:
        """Looks up units not yet kept, all at once."""
        if len(self.kept) > KEPT_UNITS:
            self.kept.clear()
        new = [u for u in units if u not in self.kept]
        self.kept.update(zip(new, self.merged(new)))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first byte and end byte of every piece in the original text."""
        norm, align = self.normalised(text)
        units = self.unit(norm)
        self.learn(set(units))
        ids = np.frombuffer(b"".join(map(self.kept.__getitem__, units)), np.int32)
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.size[ids], out=ends[1:])
        spans = align[ends]
        return ids, spans[:-1], spans[1:]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a sequence of ids: marks are spaces, the one put in front goes, bytes that are no UTF-8 become U+FFFD."""
        ids = list(ids)
        first = next((k for k, i in enumerate(ids) if self.kind[i] != CONTROL), None)
        if first is None:
            return ""
        surface = [self.surface[i] for i in ids]
        if (self.dummy or self.squeeze) and self.kind[ids[first]] == NORMAL:
            surface[first] = surface[first].lstrip(b" ") if self.squeeze else surface[first].removeprefix(b" ")
        try:
            return b"".join(surface).decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids, surface)

    def _decode_runs(self, ids: list[int], surface: list[bytes]) -> str:
        out, run = [], b""
        for i, s in zip([*ids, None], [*surface, b""]):
            if i is not None and self.kind[i] == BYTE:
                run += s
                continue
            out.append(_lenient(run))
            out.append(s.decode())
            run = b""
        return "".join(out)


def _lenient(run: bytes) -> str:
    """UTF-8 with every byte that starts no valid character as one U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(REPLACEMENT)
            at += 1
    return "".join(out)


def _ints(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model_path: str, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """``keep`` (columns of ``df``) with ids, begins and ends of every text's pieces.

    Row ``k`` of begins and ends is the byte span of piece ``k`` in the UTF-8
    of the original text; spans cover the text in order without overlap. The
    model file is read by the driver and broadcast (32,000 pieces, 0.5 MB).
    Null and empty texts have no pieces. Every row is encoded on its own:
    repeated rows give repeated results, an empty table none. ``keep`` may hold
    any columns but ids, begins and ends (ValueError).
    """
    rows = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    if {"ids", "begins", "ends"} & {n.lower() for n in names}:
        raise ValueError("ids, begins and ends are result columns")
    shared = df.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches):
        model = Pieces(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [model.encode(t or "") for t in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *(_ints([g[k] for g in got]) for k in range(3))],
                                                 names=[*names, "ids", "begins", "ends"])

    schema = StructType(rows.schema.fields[:-1])
    for c in ("ids", "begins", "ends"):
        schema = schema.add(c, ArrayType(IntegerType(), False))
    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, keep: list[Column | str], ids_col: str = "ids") -> DataFrame:
    """``keep`` (columns of ``df``) with decoded, the text of ``ids_col``; null and empty id lists give the empty text.

    Ids outside the model raise IndexError. ``keep`` may not hold decoded (ValueError).
    """
    rows = df.select(*keep, F.col(ids_col).cast("array<int>").alias("_ids"))
    names = rows.columns[:-1]
    if "decoded" in {n.lower() for n in names}:
        raise ValueError("decoded is a result column")
    shared = df.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches):
        model = Pieces(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = part.column(len(names)).fill_null([])
                text = [model.decode(r.values.to_numpy().tolist()) for r in ids]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(text, pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(run, StructType(rows.schema.fields[:-1]).add("decoded", StringType()))
