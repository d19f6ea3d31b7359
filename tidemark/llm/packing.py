"""Operator 7: sequence packing along a Hilbert curve through hashed document vectors.

Each document's token counts are projected by fixed random directions to a few
dimensions; the normal distribution function makes the coordinates even and a
Hilbert curve turns them into one key, so neighbours on the curve are documents
with similar tokens. The documents laid end to end in key order are cut every
``length`` tokens: no sequence but those of the tail has padding, and the tail
is cut into powers of two, which need none either.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import common as C
from tidemark.session import freeze, scratch_path

DIMENSIONS, BITS = 4, 15
LENGTH = 4096


class WordIds:
    """Token ids of whole texts as little-endian 16-bit numbers.

    The vocabulary drops white space and never joins across it, so a text's ids
    are those of its space-separated pieces; pieces are looked up once and kept
    up to a fixed number. A plain Latin word goes straight to the model's merges;
    the ASCII marks after it are one piece of their own.
    """

    KEEP = 200_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch
        byte = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        rest = iter(range(256, 512))
        byte |= {b: chr(next(rest)) for b in range(256) if b not in byte}
        self.letter = {ord(c): "".join(byte[b] for b in c.encode()) for c in map(chr, range(0xC0, 0x100))}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def _word(self, w: str, keep: bool) -> bytes:
        got = self.words.get(w)
        if got is None:
            ids = [t.id for t in self.tok.model.tokenize(w if w.isascii() else w.translate(self.letter))]
            got = array("H", ids).tobytes()
            if keep:
                self.words[w] = got
        return got

    def _piece(self, p: str) -> bytes:
        m = self.plain(p)
        if m:
            w = m[1].lower()
            out = self.pieces.get(w)
            if out is None:
                out = self._word(w, keep=w != p)  # a piece that is just the word is kept as a piece
            if m[2]:
                out += self._general(m[2])
            return out
        return self._general(p)

    def _general(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            ids = self.tok.encode(p, add_special_tokens=False).ids
            got = self.pieces[p] = array("H", ids).tobytes()
        return got

    def text(self, t: str) -> bytes:
        if len(self.pieces) > self.KEEP:
            self.pieces = {"": b""}
        if len(self.words) > self.KEEP:
            self.words = {}
        known, out = self.pieces, []
        for p in t.replace("\n", " ").split(" "):
            got = known.get(p)
            if got is None:
                got = known[p] = self._piece(p)
            out.append(got)
        return b"".join(out)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims) with ``bits`` bits a side."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    # walk down the levels, undoing the turn that each level's cell adds to those below it
    for level in range(bits - 1, 0, -1):
        side, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            turned = (x[d] & side) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):  # Gray code between the axes, then its inverse along the bits
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[dims - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def _coordinates(ids: list[np.ndarray], directions: np.ndarray, bits: int) -> np.ndarray:
    """Even integer coordinates of each document's normalised token counts."""
    from math import erf

    row = np.repeat(np.arange(len(ids)), [len(t) for t in ids])
    u, c = np.unique(row << 16 | np.concatenate(ids), return_counts=True)
    row, t, c = u >> 16, u & 0xFFFF, np.log1p(c)
    norm = np.sqrt(np.bincount(row, c * c))
    out = np.stack([np.bincount(row, c * directions[t, d]) for d in range(directions.shape[1])], axis=1) / norm[:, None]
    even = np.vectorize(erf, otypes=[float])(out / np.sqrt(2)) / 2 + 0.5
    return np.minimum((even * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, dims: int, bits: int) -> DataFrame:
    """(id, key, n, ids): token ids with the closing id, and the place on the curve; null text is empty."""

    def run(batches):
        words = WordIds(tokenizer)
        directions = np.random.default_rng(11).standard_normal((1 << 16, dims))
        end = np.array([end_id], np.uint16).tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                raw = [words.text(t or "") + end for t in part.column("text").to_pylist()]
                ids = [np.frombuffer(r, np.uint16) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(hilbert_key(_coordinates(ids, directions, bits), bits)),
                     pa.array([len(x) for x in ids], pa.int64()), pa.array(raw, pa.binary())],
                    names=["id", "key", "n", "ids"])

    return docs.mapInArrow(run, "id long, key long, n long, ids binary")


def running_start(df: DataFrame, order: list[str], weight: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``start``: the sum of ``weight`` over all rows before, in ``order`` (unique).

    Rows are range-partitioned into pieces of about 50,000, so a piece does not
    grow with the table; the pieces are frozen, and their sums give each its start.
    """
    rows = df.count()
    parts = max(1, -(-rows // 50_000))
    cut = freeze(df.select(*dict.fromkeys([*order, weight, *keep])).repartitionByRange(parts, *order)
                 .withColumn("_part", F.spark_partition_id()))
    sums = cut.groupBy("_part").agg(F.sum(weight).alias("_s"))
    sums = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order)
    return (cut.withColumn("_w", F.sum(weight).over(within) - F.col(weight)).join(sums, "_part")
            .select(*keep, (F.col("_w") + F.col("_before")).alias("start")))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         end_id: int = 2, dims: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, sequence_id, offset, key, ids).

    ``ids`` are the piece's token ids as little-endian 16-bit numbers. A null
    text is an empty one; a row with a null id, and each of several equal rows,
    is packed like any other. No rows give no pieces. ``length`` is a power of two.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "tokens")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    (tokenized(docs, tokenizer, end_id, dims, bits).withColumn("row", F.monotonically_increasing_id())
     .write.option("compression", "zstd").parquet(path))
    table = spark.read.parquet(path)
    begin = freeze(running_start(table.select("row", "key", "id", "n"), ["key", "id", "row"], "n", ["row"])
                   .withColumnRenamed("start", "at"))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole, tail = divmod(total, length)
    # where each sequence of the tail begins: the largest powers of two first
    ends = [whole * length]
    for bit in reversed(range(length.bit_length())):
        if tail >> bit & 1:
            ends.append(ends[-1] + (1 << bit))

    def run(batches):
        import bisect

        for b in batches:
            out = {k: [] for k in ("id", "start", "length", "doc_tokens", "sequence_id", "offset", "key", "ids")}
            for i, key, n, ids, at in zip(*(b.column(c) for c in ("id", "key", "n", "ids", "at"))):
                i, key, n, at, ids = i.as_py(), key.as_py(), n.as_py(), at.as_py(), ids.as_buffer()
                done = 0
                while done < n:
                    g = at + done
                    if g < ends[0]:
                        seq, off = divmod(g, length)
                        room = length - off
                    else:
                        k = bisect.bisect_right(ends, g) - 1
                        seq, off, room = whole + k, g - ends[k], ends[k + 1] - g
                    take = min(room, n - done)
                    for c, v in (("id", i), ("start", done), ("length", take), ("doc_tokens", n), ("sequence_id", seq),
                                 ("offset", off), ("key", key), ("ids", bytes(ids[2 * done:2 * (done + take)]))):
                        out[c].append(v)
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()],
                                             names=list(out))

    pieces = table.join(begin, "row").select("id", "key", "n", "ids", "at").mapInArrow(
        run, "id long, start long, length long, doc_tokens long, sequence_id long, offset long, key long, ids binary")
    return pieces.withColumnRenamed("id", id_col)
