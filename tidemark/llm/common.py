"""Helpers the operators share: UTF-8 slabs of Arrow batches, word shingles, components, fixed bounds.

Nothing here keeps a table at module level: functions travel to the executors by value.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import freeze, scratch_path

SLAB = 1 << 21
SHINGLE = 5
JACCARD_PERCENT = 75
MASK64 = (1 << 64) - 1


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def unique_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with each non-null id once.

    Only a table that does repeat ids is grouped; of such rows the least text counts.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        return docs
    return docs.groupBy("id").agg(F.min("text").alias("text"))


BATCH = 4 << 20  # bytes of an Arrow batch


def small_batches(spark: SparkSession) -> None:
    """From now on an Arrow batch of this session ends at ``BATCH`` bytes, or after the row that passes them.

    Spark's own bound is 10,000 rows or 64 MB, and a task holds its batch several times: as vectors and as a
    message outside the heap, and in its Python worker. A session that names a bound of its own keeps it.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, "64MB") in ("64MB", "67108864b"):
        spark.conf.set(bound, str(BATCH))


BROADCAST_IDS = 1_000_000


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (frozen, distinct), or with ``left_anti`` is not: texts of others are not shuffled.

    Up to ``BROADCAST_IDS`` ids (8 MB) are counted and sent to the scan; more go by a shuffled join.
    """
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", how)


class Scratch:
    """Tables written mid-job in the shared folder, each deleted once nothing reads it any more.

    A table may go only when what was made from it has been written itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        sc = self.spark.sparkContext
        for n in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop(n))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: shuffle files and checkpoints that nothing reads any more go only then.

    What Python has freed goes back to the system too, where its C library can do that.
    """
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id written as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    kind = np.int64 if str(column.type).startswith("large") else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Polynomial hashes of byte ranges modulo 2^64: any range from two prefix sums.

    Seeded, so every task and every run names equal bytes equally.
    """

    def __init__(self, seed: int = 1, lower: bool = False, room: int = SLAB):
        table = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        if lower:
            table[65:91] = table[97:123]
        self.table, self.base = table, (0x9E3779B97F4A7C15 + 2 * seed) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._grow(room + 1)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.full(n, b, dtype=np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.up, self.down = powers(self.base), powers(self.inverse)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n + 1 > len(self.up):
            self._grow(2 * n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def white() -> np.ndarray:
    w = np.zeros(256, bool)
    w[[32, 9, 10, 11, 12, 13]] = True
    return w


def word_spans(data: np.ndarray, offsets: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words end at white space and at text borders."""
    gap = ws[data]
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    before[inner] = True
    start = np.flatnonzero(before & ~gap)
    after = np.ones(len(data), bool)
    after[:-1] = before[1:] | gap[1:]
    end = np.flatnonzero(after & ~gap) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingle_rows(data: np.ndarray, offsets: np.ndarray, rolling: Rolling, ws: np.ndarray,
                 size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit name of every ``size``-word shingle, in text order.

    A text of fewer words gives its whole word sequence as one shingle, one
    without words none.
    """
    start, end, row = word_spans(data, offsets, ws)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = rolling.ranges(rolling.prefix(data), start, end)
    odd = np.random.default_rng(77).integers(0, 1 << 62, 2 * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(w)
    rows, names = [], []
    if n >= size:
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h += w[k:n - size + 1 + k] * odd[k]
        same = row[:n - size + 1] == row[size - 1:]
        rows.append(row[:n - size + 1][same])
        names.append(mix(h[same]))
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    for m in range(1, size):
        short = np.flatnonzero(count == m)
        if len(short):
            h = np.full(len(short), odd[size + m], np.uint64)
            for k in range(m):
                h += w[first[short] + k] * odd[k]
            rows.append(short)
            names.append(mix(h))
    rows, names = np.concatenate(rows), np.concatenate(names)
    order = np.argsort(rows, kind="stable")
    return rows[order], names[order]


def crc32(b: bytes) -> int:
    return zlib.crc32(b) & 0xFFFFFFFF


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) with the smallest id reachable over the undirected ``edges`` (a, b).

    Alternating large-star and small-star rounds: each round is two grouped
    minima and two joins over the remaining edges, which a node's degree never
    forces into one task. Rounds go on until the edges are stars: every larger
    end has one edge and is nobody's smaller end. Each round is written to the
    checkpoint folder. ``nodes`` (id) adds ids without edges.
    """
    e = freeze(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").count():
            break
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = freeze(small.where("a <> b").unionAll(down.select("a", F.col("m").alias("b"))).distinct())
    out = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if nodes is None:
        return out.unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    return nodes.join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
