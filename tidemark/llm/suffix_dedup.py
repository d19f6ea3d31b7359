"""Operator 9: exact removal of repeated 200-byte strings by distributed ranking of growing substrings.

Prefix doubling names substrings of length 100 and then pairs of names at
offset 100, and drops positions as soon as their name is unique. Naming every
byte position in Spark would move over twenty times the input, so positions are
thinned without loss first: every 200-byte window holds a 100-byte string of
least hash (its anchor), and equal windows have equal anchors at equal offsets.

Round 1 names the anchors' 100 bytes; windows of a unique anchor are unique.
Round 2 names the bytes that all windows of one anchor cover together: if they
occur twice, every one of these windows does. What remains stands at the edges
of repeated passages. Round 3 takes eight neighbouring windows at a time: the
bytes they share, when unique, rule all eight out; the bytes they cover, when
repeated, settle all eight. Round 4 names single windows by the pair of ranks
(100 bytes, 100 bytes at offset 100). One holder of each settled name stays in
the later rounds, so nothing is compared within its group again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import common as C
from tidemark.session import freeze

LENGTH = 200
EIGHT = 8
SEGMENT = 1 << 20  # bytes of one text whose windows are ranked at once


class Ranks:
    """128-bit names of byte ranges of one stretch of bytes, as two 64-bit halves."""

    def __init__(self):
        self.a, self.b = C.Rolling(seed=21), C.Rolling(seed=22)

    def of(self, data: np.ndarray) -> "Ranks":
        self.pa, self.pb = self.a.prefix(data), self.b.prefix(data)
        return self

    def half(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.a.ranges(self.pa, start, end)

    def both(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.half(start, end).view(np.int64), self.b.ranges(self.pb, start, end).view(np.int64)


def anchors(data: np.ndarray, ranks: Ranks, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions and the first and last window start of each, for the windows of one stretch of bytes."""
    half = length // 2
    n = len(data) - half + 1
    at = np.arange(n)
    least = (ranks.half(at, at + half) >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    width, span = 1, length - half + 1  # each window holds this many strings of half its length
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[:-(span - width)], least[span - width:])
    chosen = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    return chosen[first], first, np.append(first[1:], len(chosen)) - 1


def _segments(size: int, length: int):
    """Stretches of a long text that share length - 1 bytes, so each window lies in exactly one."""
    step = SEGMENT - length + 1
    for s in range(0, max(1, size - length + 1), step):
        yield s, min(size, s + SEGMENT)


def anchor_rows(docs: DataFrame, length: int, live=None) -> DataFrame:
    """Anchors of every text (id, text): their ranks alone, or the whole rows of those that pass the filter ``live``.

    ``at`` is the anchor, ``reach`` holds how far before it the first and the last of its windows start;
    (h1, h2) names the bytes that its windows cover.
    """

    def run(batches):
        ranks = Ranks()
        bits = None if live is None else live.value
        for b in batches:
            data, off = C.utf8(b.column("text"))
            ids = b.column("id").to_numpy()
            for lo, hi in C.slabs(off, 1 << 19):
                out = [[] for _ in range(6)]
                for k in range(lo, hi):
                    for s, e in _segments(int(off[k + 1] - off[k]), length):
                        if e - s < length:
                            continue
                        part = ranks.of(data[off[k] + s:off[k] + e])
                        a, first, last = anchors(data[off[k] + s:off[k] + e], part, length)
                        rank = part.half(a, a + length // 2)
                        if bits is not None:
                            keep = np.flatnonzero(may_repeat(bits, rank))
                            a, first, last, rank = a[keep], first[keep], last[keep], rank[keep]
                            h1, h2 = part.both(first, last + length)
                            for c, v in zip(out[1:], (np.full(len(a), ids[k]), a + s, (a - first) << 16 | (a - last), h1, h2 + (a - first))):
                                c.append(v)
                        out[0].append(rank.view(np.int64))
                cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (out[:1] if bits is None else out)]
                yield pa.RecordBatch.from_arrays(cols, names=["rank", "id", "at", "reach", "h1", "h2"][:len(cols)])

    schema = "rank long" if live is None else "rank long, id long, at long, reach long, h1 long, h2 long"
    return docs.select("id", "text").mapInArrow(run, schema)


FILTER_BITS = 29  # 64 MB at most


def may_repeat(bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    # an anchor has the least hash of its window, so its high bits say little; the low ones are even
    at = (rank & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def repeat_filter(docs: DataFrame, length: int) -> np.ndarray:
    """A bit for every rank that more than one anchor has, at a hash position: about 16 bits a rank, up to ``FILTER_BITS``.

    Further ranks only let more unique anchors through to the next round, which drops them.
    """
    seen = freeze(anchor_rows(docs, length).groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank"))
    k = min(FILTER_BITS, max(18, (16 * seen.count()).bit_length()))

    def block(key, rows):
        b = np.zeros(1 << 15, np.uint8)
        b[rows.column("rank").to_numpy() & ((1 << 15) - 1)] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(b).tobytes()], pa.binary())})

    got = (seen.withColumn("block", F.shiftright(F.col("rank").bitwiseAND((1 << k) - 1), 15)).groupBy("block")
           .applyInArrow(block, "block long, bits binary").collect())
    out = np.zeros(1 << (k - 3), np.uint8)
    for r in got:
        out[r.block << 12:(r.block + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that stand at more than one place, with the least (id, at) as their holder.

    Neighbouring anchors may name one place twice, so places count, not rows.
    """
    place = F.struct("id", "at")
    return (df.groupBy(*keys).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
            .where("_first <> _last").select(*keys, "_first"))


def _is_first() -> Column:
    return (F.col("id") == F.col("_first.id")) & (F.col("at") == F.col("_first.at"))


def by_document(docs: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """(id, text, places): the texts that ``places`` name, each with all its places (structs of ``columns``)."""
    grouped = freeze(places.groupBy("id").agg(F.collect_list(F.struct(*columns)).alias("places")))
    return C.only(docs, freeze(grouped.select("id"))).join(grouped, "id").select("id", "text", "places")


def _stretches(at: np.ndarray):
    """Ranges of sorted positions that lie within ``SEGMENT`` bytes, 5,000 of them at most."""
    s = 0
    while s < len(at):
        e = min(s + 5_000, int(np.searchsorted(at, at[s] + SEGMENT)))
        yield s, e
        s = e


def _each_stretch(batches, length: int):
    """(id, bytes, where they start in the text, size of the text, place columns) of every stretch of places of every text."""
    for b in batches:
        ids = b.column("id").to_numpy()
        for k in range(b.num_rows):
            data, _ = C.utf8(b.column("text").slice(k, 1))
            cols = [x.to_numpy(zero_copy_only=False) for x in b.column("places")[k].values.flatten()]
            order = np.argsort(cols[0], kind="stable")
            for s, e in _stretches(cols[0][order]):
                here = [c[order[s:e]] for c in cols]
                base = max(0, int(here[0][0]) - length)
                yield ids[k], data[base:int(here[0][-1]) + 2 * length], base, len(data), here


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and running number within the row of ``n`` entries for each row."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def eight_rows(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """``places`` (id, at, reach) as rows of eight windows: (id, at, eighth, low, high, c1, c2, h1, h2).

    ``at`` is the anchor; windows start at at - low .. at - high. (c1, c2) names what all eight windows share;
    (h1, h2) what they cover, null where the text's border cuts the eight.
    """
    names = ["id", "at", "eighth", "low", "high", "c1", "c2", "h1", "h2"]

    def run(batches):
        ranks = Ranks()
        for doc, data, base, size, (at, reach) in _each_stretch(batches, length):
            back, ahead = reach >> 16, reach & 0xFFFF
            row, step = _expand(back // EIGHT - ahead // EIGHT + 1)
            # relative to the anchor, so equal windows fall in equal eighths
            eighth, a = step + (ahead // EIGHT)[row], at[row]
            low, high = eighth * EIGHT + EIGHT - 1, eighth * EIGHT
            ranks.of(data)
            c1, c2 = ranks.both(a - high - base, a - low + length - base)
            start, end = np.maximum(0, a - low), np.minimum(size, a - high + length)
            h1, h2 = ranks.both(start - base, end - base)
            cut = (start > a - low) | (end < a - high + length)
            cols = [np.full(len(a), doc), a, eighth, np.minimum(low, a), np.maximum(high, a + length - size), c1, c2 + eighth]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(h1, pa.int64(), mask=cut),
                                              pa.array(h2, pa.int64(), mask=cut)], names=names)

    return by_document(docs, places, "at", "reach").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def single_windows(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(id, at, r1, r2): every window of rows of eight (id, at, low, high), named by its two halves; ``at`` is now the window's start."""

    def run(batches):
        ranks, half = Ranks(), length // 2
        for doc, data, base, _, (at, low, high) in _each_stretch(batches, length):
            ranks.of(data)
            row, step = _expand(low - high + 1)
            p = np.unique(at[row] - low[row] + step)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(p), doc)), pa.array(p), pa.array(ranks.half(p - base, p - base + half).view(np.int64)),
                pa.array(ranks.b.ranges(ranks.pb, p - base + half, p - base + length).view(np.int64))], names=["id", "at", "r1", "r2"])

    return by_document(docs, rows, "at", "low", "high").mapInArrow(run, "id long, at long, r1 long, r2 long")


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, first, last): window starts whose ``length`` bytes start anywhere else too, as ranges, together all of them."""
    spark = docs.sparkSession
    table = C.Scratch(spark)
    passing = spark.sparkContext.broadcast(repeat_filter(docs, length))
    live = table.put("live", anchor_rows(docs, length, passing))
    passing.destroy()
    settled = live.join(repeated(live, "h1", "h2"), ["h1", "h2"], "left")
    settled = table.put("settled", settled.select("rank", "id", "at", "reach", F.col("_first").isNotNull().alias("full"), _is_first().alias("holds")))
    table.drop("live")
    full, edge = settled.where("full"), settled.where("NOT full")
    holders = full.where("holds").join(edge.select("rank").distinct(), "rank", "left_semi")
    eights = table.put("eights", eight_rows(docs, edge.unionByName(holders).select("id", "at", "reach"), length))
    # c1, c2 belong to one rank and one eighth, whose windows hold the same anchor
    cores = eights.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c1", "c2")
    again = repeated(eights.where("h1 IS NOT NULL"), "h1", "h2", "eighth")
    tested = eights.join(cores, ["c1", "c2"]).join(again, ["h1", "h2", "eighth"], "left")
    tested = table.put("tested", tested.select("id", "at", "low", "high", F.col("_first").isNotNull().alias("done"),
                                               (F.col("_first").isNull() | _is_first()).alias("open")))
    table.drop("eights")
    one = table.put("one", single_windows(docs, tested.where("open").select("id", "at", "low", "high"), length))
    last = one.join(repeated(one, "r1", "r2").select("r1", "r2"), ["r1", "r2"])
    ranges = full.select("id", (F.col("at") - F.shiftright("reach", 16)).alias("first"), (F.col("at") - F.col("reach").bitwiseAND(0xFFFF)).alias("last"))
    ranges = ranges.unionAll(tested.where("done").select("id", F.col("at") - F.col("low"), F.col("at") - F.col("high")))
    ranges = table.put("ranges", ranges.unionAll(last.select("id", "at", "at")))
    table.drop("settled", "tested", "one")
    return ranges


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per distinct id: (id, n_bytes, n_removed, spans, kept).

    ``kept`` is what is left of the text's UTF-8 bytes, ``spans`` the maximal
    removed ranges [start, end). Null texts are empty; texts below ``length``
    bytes stay whole. Rows with a null id are left out, of rows that repeat an
    id the least text counts: such rows are one document. ``length`` is even.
    """
    docs = C.unique_texts(df, id_col, text_col)
    ranges = freeze(repeated_windows(docs, length).select("id", F.shiftleft("first", 32).bitwiseOR(F.col("last")).alias("r"))
                    .groupBy("id").agg(F.collect_list("r").alias("ranges")))
    touched = freeze(ranges.select("id"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                data, off = C.utf8(part.column("text"))
                out = {k: [] for k in ("n_bytes", "n_removed", "spans", "kept")}
                for k, v in enumerate(part.column("ranges")):
                    raw = data[off[k]:off[k + 1]]
                    edge = np.zeros(len(raw) + 1, np.int64)
                    if v.is_valid:
                        r = np.asarray(v.values)
                        np.add.at(edge, r >> 32, 1)
                        np.add.at(edge, (r & 0xFFFFFFFF) + length, -1)
                    cut = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
                    out["n_bytes"].append(len(raw))
                    out["n_removed"].append(int(cut.sum()))
                    out["spans"].append([{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2])])
                    out["kept"].append(raw[~cut].tobytes())
                kinds = {"spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items())],
                                                 names=["id", *out])

    # only texts that lose bytes are shuffled to their ranges
    whole = C.only(docs, touched, "left_anti").withColumn("ranges", F.lit(None).cast("array<long>"))
    rows = C.only(docs, touched).join(ranges, "id").select("id", "text", "ranges").unionByName(whole).mapInArrow(
        run, "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return rows.withColumnRenamed("id", id_col)
