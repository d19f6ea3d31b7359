"""Operator 8: one-permutation MinHash fingerprints with optimal densification and b-bit packing.

Every five-word shingle is hashed once; its top bits choose a bin, the least
hash of a bin is its value. An empty bin takes the value of the first filled
bin along its own fixed sequence of random bins, the same sequence for every
document. Of each value the low bits are stored; likeness is the share of equal
bins, corrected for the matches that so few bits give by chance.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common as C
from tidemark.session import freeze

BINS, LOW_BITS = 512, 4


class Sketcher:
    """Signatures of texts: a (texts, bins) array of low bits, and which texts have no words."""

    def __init__(self, bins: int = BINS, low_bits: int = LOW_BITS, size: int = C.SHINGLE):
        self.bins, self.low, self.size = bins, low_bits, size
        self.rolling, self.ws = C.Rolling(lower=True), C.white()
        self.shift = np.uint64(64 - (bins.bit_length() - 1))

    def _step(self, bin_: np.ndarray, attempt: int) -> np.ndarray:
        return (C.mix(bin_.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt * 0x9E37 + 1)) >> self.shift).astype(np.int64)

    def signatures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, off = C.utf8(pa.array(texts, pa.large_string()))
        value = np.zeros((len(texts), self.bins), np.uint64)
        filled = np.zeros((len(texts), self.bins), bool)
        if len(texts):
            rows, names = C.shingle_rows(data, off, self.rolling, self.ws, self.size)
            cell = rows * self.bins + (names >> self.shift).astype(np.int64)
            order = np.lexsort((names, cell))
            cell, first = np.unique(cell[order], return_index=True)
            value.reshape(-1)[cell] = names[order][first]
            filled.reshape(-1)[cell] = True
        count = filled.sum(axis=1)
        single = np.flatnonzero(count == 1)  # every sequence ends at the one filled bin
        value[single] = value[single].max(axis=1, keepdims=True)
        row, bin_ = np.nonzero(~filled & (count > 1)[:, None])
        attempt = 0
        while len(row):
            to = self._step(bin_, attempt)
            found = filled[row, to]
            value[row[found], bin_[found]] = value[row[found], to[found]]
            row, bin_ = row[~found], bin_[~found]
            attempt += 1
        # a value copied to several bins shows other bits in each, so chance matches stay independent
        value = C.mix(value + C.mix(np.arange(1, self.bins + 1, dtype=np.uint64)))
        return (value & np.uint64((1 << self.low) - 1)).astype(np.uint8), count == 0

    def packed(self, low: np.ndarray, empty: np.ndarray) -> list[str]:
        """Low bits packed tightly as base64 text; no words give the empty text."""
        bits = np.unpackbits(low[:, :, None], axis=2, count=None)[:, :, 8 - self.low:]
        raw = np.packbits(bits.reshape(len(low), -1), axis=1)
        return ["" if e else base64.b64encode(r.tobytes()).decode() for r, e in zip(raw, empty)]


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray, low_bits: int = LOW_BITS) -> np.ndarray:
    """Estimated Jaccard similarity, 0 to 1, without the chance matches of ``low_bits`` bits.

    Two texts without words are alike (1), one such text and another are not (0).
    """
    chance = 0.5 ** low_bits
    share = (a == b).mean(axis=1)
    out = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), out)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[list[tuple]]:
    """Consecutive rows (id, text, sentinel) of about ``limit`` characters, each chunk opening with the last row before it."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        for r in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("sentinel").to_pylist()):
            held.append(r)
            size += len(r[1])
            if size >= limit and len(held) > 1:
                yield held
                held, size = held[-1:], len(r[1])
    if len(held) > 1:
        yield held


def neighbours(docs: DataFrame, rows_per_bucket: int = 2000, most_buckets: int = 16384) -> DataFrame:
    """Rows (bucket, id, text, sentinel): consecutive buckets of ids, each closed by the next bucket's first row.

    One shuffle moves the texts. Bounds of the buckets come from percentiles of
    the ids alone; a bucket's closing row is flagged ``sentinel`` and the last
    bucket closes with the very first row.
    """
    spark = docs.sparkSession
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.coalesce("id", F.lit(-(1 << 63))).alias("key"))
    n = max(1, min(most_buckets, -(-ids.count() // rows_per_bucket)))
    bounds = ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = np.array(sorted(set(bounds)), np.int64)

    def place(batches):
        for b in batches:
            key = b.column("id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, key, side="left")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), b.column("id"), b.column("text")],
                                             names=["bucket", "id", "text"])

    placed = docs.mapInArrow(place, "bucket long, id long, text string")
    first = (docs.select("id", F.lit("").alias("text")).mapInArrow(place, "bucket long, id long, text string")
             .groupBy("bucket").agg(F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("key")).orderBy("bucket").collect())
    # the row that closes bucket k is the first row of the next bucket that has any
    closing = [(first[k].bucket, first[(k + 1) % len(first)].key) for k in range(len(first))]
    heads = F.broadcast(spark.createDataFrame(closing, "bucket long, key long"))
    texts = (docs.withColumn("key", F.coalesce("id", F.lit(-(1 << 63)))).join(heads, "key")
             .groupBy("bucket", "id").agg(F.min("text").alias("text")))
    return (placed.withColumn("sentinel", F.lit(False))
            .unionAll(freeze(texts.select("bucket", "id", "text")).withColumn("sentinel", F.lit(True))))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS,
                        low_bits: int = LOW_BITS, size: int = C.SHINGLE) -> DataFrame:
    """One row per row: fingerprints of each text, of its edited text, and their likeness to it and to the next text.

    The edited text replaces the last half of the code points by the first as
    many of the next document in (id, text) order; after the last comes the
    first. Null texts are empty, a null id comes before all others, rows that
    repeat an id stand in text order. No rows give no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches):
        import hashlib

        sketch = Sketcher(bins, low_bits, size)
        for rows in _chunks(batches):
            texts = [r[1] for r in rows]
            edited = [t[:len(t) - len(t) // 2] + u[:len(t) // 2] for t, u in zip(texts, texts[1:])]
            low, none = sketch.signatures(texts)
            elow, enone = sketch.signatures(edited)
            near = likeness(low[:-1], elow, none[:-1], enone, low_bits)
            after = likeness(low[:-1], low[1:], none[:-1], none[1:], low_bits)
            keep = [k for k in range(len(edited)) if not rows[k][2]]
            fp, efp = sketch.packed(low, none), sketch.packed(elow, enone)
            yield pa.RecordBatch.from_arrays([
                pa.array([rows[k][0] for k in keep], pa.int64()), pa.array([len(texts[k]) for k in keep], pa.int64()),
                pa.array([hashlib.sha256(edited[k].encode()).hexdigest() for k in keep], pa.string()),
                pa.array([fp[k] for k in keep], pa.string()), pa.array([efp[k] for k in keep], pa.string()),
                pa.array(near[keep], pa.float64()), pa.array(after[keep], pa.float64())],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = neighbours(docs).repartition("bucket").sortWithinPartitions("bucket", "sentinel", F.col("id").asc_nulls_first(), "text")
    return rows.select("id", "text", "sentinel").mapInArrow(run, schema).withColumnRenamed("id", id_col)
