"""Signatures, near-duplicate joins, as-of gates and leakage probes.

The near-duplicate join is exact. Identical vectors collapse to one row before
it. Rows are dealt to blocks by a hash of their ids, every two blocks meet in a
task of their own, and a task compares its two blocks tile by tile. Two unit
vectors with cosine >= t lie within sqrt(2 - 2t), and so do their projections on
any few orthonormal directions: one small matrix product per tile leaves out
almost all pairs, what is left is decided by the whole dot product. Spread
vectors of many dimensions have no cells that part them, so all pairs of blocks
are met; what is shuffled is each row once per block of the other side.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark import dims
from tidemark.functions import arrays as A
from tidemark.session import freeze

SIGNATURE_DIMS = 32


def signature(x: str, n: int = SIGNATURE_DIMS) -> str:
    """Array text: resample to ``n`` points, centre, scale to unit norm (zeros when flat)."""
    source, x = x, "x_"
    pos = f"(k_ * (size({x}) - 1) / {n - 1}D)"
    lo = f"CAST(floor({pos}) AS INT)"
    pick = f"{x}[{lo}] + ({x}[least({lo} + 1, size({x}) - 1)] - {x}[{lo}]) * ({pos} - floor({pos}))"
    res = f"transform(sequence(0, {n - 1}), k_ -> {pick})"
    unit = A.let("n_", "sqrt(" + A.sum_sq("c_") + ")", "transform(c_, v -> if(n_ > 1e-12, v / n_, 0D))")
    return A.let("x_", source, A.let("r_", res, A.let("c_", A.centre("r_"), unit)))


def unit(x: str) -> str:
    return A.let("n_", "sqrt(" + A.sum_sq(f"transform({x}, v -> CAST(v AS DOUBLE))") + ")",
                 f"transform({x}, v -> CAST(v AS DOUBLE) / if(n_ > 1e-12, n_, 1D))")


def directions(dim: int, k: int) -> np.ndarray:
    """``k`` fixed orthonormal directions of a ``dim``-space."""
    q, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(dim, k)))
    return q.T


N_DIRECTIONS = 16  # directions of the first comparison
BLOCK = 1 << 16  # most rows of a block; a task holds two blocks
PIECE, PIECES = 1 << 12, 8  # smaller inputs are cut into up to so many blocks of at least so many rows, to keep all cores busy
TILE = (256, 768)
SLACK = 1e-5  # more than single precision loses on unit vectors


def collapse(df: DataFrame, id_: str, vec: str) -> DataFrame:
    """One row per distinct vector: its lowest id and the number of copies."""
    return df.groupBy(vec).agg(F.min(id_).alias(id_), F.count(F.lit(1)).alias("copies"))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of the rows of x with the same rows of y, summed in order of the dimensions."""
    return np.cumsum(x * y, axis=1)[:, -1]


def _product(x: np.ndarray, y: np.ndarray, step: int, out: np.ndarray) -> np.ndarray:
    """Products of all rows of x with all rows of y, in stacks of ``step`` rows: so small that the BLAS library keeps to this task's thread."""
    stacks = -(-len(x) // step)
    x = np.concatenate([x, np.zeros((stacks * step - len(x), x.shape[1]), x.dtype)])
    np.matmul(x.reshape(stacks, step, -1), y.T, out=out[:stacks * step * len(y)].reshape(stacks, step, len(y)))
    return out


class _Side:
    """Vectors of one side with what the first comparison needs."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, left: bool) -> None:
        self.x, self.single = x, x.astype(np.float32)
        p = self.single @ turn
        half, one = -(p * p).sum(axis=1, keepdims=True) / 2, np.ones((len(x), 1), np.float32)
        self.small = np.hstack([p, half, one] if left else [p, one, half])
        if left:  # reused by every tile: fresh memory costs more than the product
            self.room, self.over = np.empty(TILE[0] * TILE[1], np.float32), np.empty(TILE[0] * TILE[1], bool)


def _tile(a: _Side, rows: np.ndarray, b: _Side, lo: int, hi: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``rows``, column) of the pairs of a tile with dot product >= t, row by row and columns ascending."""
    size = len(rows) * (hi - lo)
    product = _product(a.small[rows], b.small[lo:hi], 16, a.room)
    over = np.greater_equal(product[:size], np.float32(t - 1 - SLACK), out=a.over[:size])
    at = np.flatnonzero(over)
    if not len(at):
        return at, at
    i, j = np.divmod(at, hi - lo)
    if len(i) > size // 16:
        dots = _product(a.single[rows], b.single[lo:hi], 4, a.room)[:size].reshape(len(rows), -1)
        i, j = np.nonzero(dots >= t - SLACK)
        sure = dots[i, j] >= t + SLACK
    else:
        sure = np.zeros(len(i), bool)
    open_ = np.flatnonzero(~sure)
    for k in range(0, len(open_), 1 << 13):
        at = open_[k:k + (1 << 13)]
        sure[at] = _dots(a.x[rows[i[at]]], b.x[lo + j[at]]) >= t
    return i[sure], lo + j[sure]


def _first_hits(a: _Side, b: _Side, t: float, before: np.ndarray) -> np.ndarray:
    """For each row of a its first similar row of b among the first ``before``, else -1; a row that has one is done."""
    first = np.full(len(a.x), -1, np.int64)
    for r in range(0, len(a.x), TILE[0]):
        rows = np.arange(r, min(r + TILE[0], len(a.x)))
        end = int(before[rows].max())
        for lo in range(0, end, TILE[1]):
            i, j = _tile(a, rows, b, lo, min(lo + TILE[1], end), t)
            if len(i):
                head = np.flatnonzero(np.diff(i, prepend=-1))
                i, j = rows[i[head]], j[head]
                ok = j < before[i]
                first[i[ok]] = j[ok]
                rows = rows[first[rows] < 0]
                if not len(rows):
                    break
    return first


def _units(left: DataFrame, right: DataFrame | None, id_: str, vec: str, dim: int) -> tuple[DataFrame, str]:
    """Rows (unit, side, id, vec) with one unit per partition: each block of ``left`` with each of ``right``, or with each of its own."""
    ok = F.expr(f"size({vec}) = {dim} AND NOT exists({vec}, v -> v IS NULL)")
    kind = left.schema[id_].dataType.simpleString()

    def dealt(df: DataFrame) -> tuple[DataFrame, int]:
        df = df.where(ok).select(F.col(id_).alias("id"), F.col(vec).alias("vec"))
        rows = df.count()
        n = max(1, -(-rows // BLOCK), min(PIECES, rows // PIECE))
        return df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n))), n

    a, na = dealt(left)
    if right is None:
        other = a.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(na - 1))))
        lo, hi = F.least("_b", "_k"), F.greatest("_b", "_k")
        rows = other.select((hi * (hi + 1) / 2 + lo).cast("int").alias("unit"), (F.col("_b") == hi).cast("int").alias("side"), "id", "vec")
        n = na * (na + 1) // 2
    else:
        b, nb = dealt(right)
        x = a.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).select((F.col("_b") * nb + F.col("_k")).cast("int").alias("unit"), F.lit(0).alias("side"), "id", "vec")
        y = b.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(na - 1)))).select((F.col("_k") * nb + F.col("_b")).cast("int").alias("unit"), F.lit(1).alias("side"), "id", "vec")
        rows, n = x.unionAll(y), na * nb
    return rows.repartitionById(n, "unit"), kind


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(side, ids, vectors) of the unit of a partition, ids ascending."""
    got: dict[int, list] = {}
    for b in batches:
        unit = b.column("unit").to_numpy()
        for u in np.unique(unit):
            part = b.filter(pa.array(unit == u))
            got.setdefault(int(u), []).append((part.column("side").to_numpy(), part.column("id"), part.column("vec").flatten().to_numpy().reshape(part.num_rows, -1)))
    for parts in got.values():
        ids = pa.concat_arrays([p[1] for p in parts])
        order = pc.sort_indices(ids).to_numpy()
        yield np.concatenate([p[0] for p in parts])[order], ids.take(pa.array(order)), np.concatenate([p[2] for p in parts])[order]


def lowest_like(df: DataFrame, id_: str, vec: str, dim: int, threshold: float = dims.DUP_COSINE) -> DataFrame:
    """(id, low): the lowest id whose vector resembles that of ``id`` and that is lower, where there is one."""
    rows, kind = _units(df, None, id_, vec, dim)
    turn = directions(dim, min(dim, N_DIRECTIONS)).T.astype(np.float32)

    def run(batches):
        for side, ids, x in _collected(batches):
            mixed = 0 < side.sum() < len(side)
            for s in (0, 1) if mixed else (side[0],):
                mine = np.flatnonzero(side == s)
                theirs = np.flatnonzero(side != s) if mixed else mine
                first = _first_hits(_Side(x[mine], turn, True), _Side(x[theirs], turn, False), threshold, np.searchsorted(theirs, mine))
                hit = np.flatnonzero(first >= 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine[hit])), ids.take(pa.array(theirs[first[hit]]))], names=["id", "low"])

    found = rows.mapInArrow(run, f"id {kind}, low {kind}")
    return found.groupBy("id").agg(F.min("low").alias("low")).withColumnRenamed("id", id_)


def like_any(left: DataFrame, right: DataFrame, id_: str, vec: str, dim: int, threshold: float = dims.DUP_COSINE) -> DataFrame:
    """Ids of ``left`` whose vector resembles one of ``right``."""
    rows, kind = _units(left, right, id_, vec, dim)
    turn = directions(dim, min(dim, N_DIRECTIONS)).T.astype(np.float32)

    def run(batches):
        for side, ids, x in _collected(batches):
            mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            first = _first_hits(_Side(x[mine], turn, True), _Side(x[theirs], turn, False), threshold, np.full(len(mine), len(theirs)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine[first >= 0]))], names=["id"])

    return rows.mapInArrow(run, f"id {kind}").distinct().withColumnRenamed("id", id_)


def near_pairs(left: DataFrame, right: DataFrame, lid: str, rid: str, vec: str, dim: int,
               threshold: float = dims.DUP_COSINE, ordered: bool = False) -> DataFrame:
    """(lid, rid, cosine) of every pair at or above the threshold, for distinct unit vectors.

    ``ordered`` keeps right ids below left ids only.
    """
    rows, kind = _units(left.withColumnRenamed(lid, "id"), right.withColumnRenamed(rid, "id"), "id", vec, dim)
    turn = directions(dim, min(dim, N_DIRECTIONS)).T.astype(np.float32)

    def run(batches):
        for side, ids, x in _collected(batches):
            mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            a, b = _Side(x[mine], turn, True), _Side(x[theirs], turn, False)
            for r in range(0, len(mine), TILE[0]):
                for lo in range(0, len(theirs), TILE[1]):
                    i, j = _tile(a, np.arange(r, min(r + TILE[0], len(mine))), b, lo, min(lo + TILE[1], len(theirs)), threshold)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine[r + i])), ids.take(pa.array(theirs[j])), pa.array(_dots(a.x[r + i], b.x[j]))],
                                                         names=["l", "r", "cosine"])

    pairs = rows.mapInArrow(run, f"l {kind}, r {kind}, cosine double")
    return (pairs.where("r < l") if ordered else pairs).toDF(lid, rid, "cosine")


def seen_before(cands: DataFrame, history: DataFrame, id_: str, vec: str, dim: int,
                threshold: float = dims.DUP_COSINE) -> DataFrame:
    """Ids of candidates that repeat history (cosine >= threshold); zero signatures never do.

    Only distinct vectors meet; a candidate is done with its first match.
    """
    zero = F.expr(f"{A.sum_sq(vec)} > 1e-20")
    c, h = (freeze(collapse(d.where(zero), id_, vec).select(id_, vec)) for d in (cands, history))
    hit = like_any(c, h, id_, vec, dim, threshold)
    # back from representatives to every copy
    return cands.join(c.join(hit, id_, "left_semi").select(vec), vec, "left_semi").select(id_)


def repeats_of_lower(reps: DataFrame, id_: str, vec: str, dim: int, threshold: float = dims.DUP_COSINE) -> DataFrame:
    """Ids of distinct vectors that resemble one with a lower id."""
    return lowest_like(freeze(reps.select(id_, vec)), id_, vec, dim, threshold).select(id_)


SETTLING_ROUNDS = 4


def settle(rest: DataFrame, id_: str, vec: str, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(still open, dropped ids) after one round: items unlike every lower open one are admitted, what resembles them drops.

    Most items drop by their lowest neighbour alone, which a group of near copies
    has in common; the others are compared with all that is admitted.
    """
    low = freeze(lowest_like(rest, id_, vec, dim, threshold))
    led = low.join(low.select(F.col(id_).alias("low")), "low", "left_anti").select(id_)
    other = freeze(rest.join(low.join(led, id_, "left_anti"), id_, "left_semi"))
    if other.isEmpty():
        return other, freeze(led)
    admitted = freeze(rest.join(low.select(id_), id_, "left_anti"))
    gone = freeze(led.unionByName(like_any(other, admitted, id_, vec, dim, threshold)))
    return freeze(other.join(gone, id_, "left_anti")), gone


def greedy_repeats(reps: DataFrame, id_: str, vec: str, dim: int, threshold: float = dims.DUP_COSINE) -> DataFrame:
    """Ids that resemble an admitted one with a lower id, when items are admitted in id order.

    First a few settling rounds take whole clusters of near copies without their
    pairs. What stays open is worked in rounds on its similar pairs: an
    item without a lower open neighbour is admitted and its higher neighbours are
    dropped. That is the greedy result without one task walking the order; there
    are as many rounds as the longest chain of decisions that hang on each other.
    """
    cells = freeze(reps.select(id_, vec))
    dropped = cells.select(id_).limit(0)
    for _ in range(SETTLING_ROUNDS):
        cells, gone = settle(cells, id_, vec, dim, threshold)
        dropped = dropped.unionByName(gone)
        if cells.isEmpty():
            return dropped
    pairs = near_pairs(cells, cells.withColumnRenamed(id_, "_low"), id_, "_low", vec, dim, threshold, ordered=True)
    pairs = freeze(pairs.select("_low", F.col(id_).alias("_high")))
    while not pairs.isEmpty():
        admitted = pairs.select("_low").distinct().join(pairs.select(F.col("_high").alias("_low")).distinct(), "_low", "left_anti")
        gone = freeze(pairs.join(admitted, "_low", "left_semi").select(F.col("_high").alias(id_)).distinct())
        dropped = dropped.unionByName(gone)
        pairs = pairs.join(gone.withColumnRenamed(id_, "_low"), "_low", "left_anti").join(gone.withColumnRenamed(id_, "_high"), "_high", "left_anti")
        pairs = freeze(pairs.select("_low", "_high"))
    return dropped


def admit_batch(cands: DataFrame, history: DataFrame, id_: str, vec: str, dim: int,
                threshold: float = dims.DUP_COSINE) -> DataFrame:
    """Fresh pool: not in history, and unlike every item admitted before it in id order.

    An item that is itself dropped suppresses nothing.
    """
    fresh = cands.join(seen_before(cands, history, id_, vec, dim, threshold), id_, "left_anti")
    reps = freeze(collapse(fresh, id_, vec))
    return reps.join(greedy_repeats(reps, id_, vec, dim, threshold), id_, "left_anti").select(id_, "copies")


def nearest_distance(query: DataFrame, base: DataFrame, qid: str, coords: list[str], cell: float) -> DataFrame:
    """Exact distance from every query point to its nearest base point (low dimensions).

    A neighbour found within one cell width is final; the rest retry on a grid
    twice as coarse (far coarser after a round without any), so work shrinks each
    round and no point is given up. Start
    with a cell small against the densest region: dense points settle there.
    Without base points, or with a coordinate that is no finite number, the
    distance is null.
    """
    finite = F.expr(" AND ".join(f"abs({c}) < double('infinity')" for c in coords))
    left, base = freeze(query.select(*coords).where(finite).distinct()), base.where(finite)
    base = freeze(base.select(*[F.col(c).alias(f"b_{c}") for c in coords]).distinct())
    done = query.select(*coords).limit(0).withColumn("distance", F.lit(None).cast("double"))
    while not (base.isEmpty() or left.isEmpty()):
        names = [f"_g{i}" for i in range(len(coords))]
        b = base.select("*", *[F.floor(F.col(f"b_{c}") / cell).alias(n) for c, n in zip(coords, names)])
        q = left.withColumn("_p", F.explode(F.array(*[
            F.struct(*[F.lit(o).alias(n) for n, o in zip(names, off)]) for off in itertools.product((-1, 0, 1), repeat=len(coords))])))
        q = q.select(*coords, *[(F.floor(F.col(c) / cell) + F.col(f"_p.{n}")).alias(n) for c, n in zip(coords, names)])
        d = F.sqrt(sum(((F.col(c) - F.col(f"b_{c}")) ** 2 for c in coords), F.lit(0.0)))
        got = freeze(q.join(b, names).groupBy(*coords).agg(F.min(d).alias("distance")).where(F.col("distance") <= cell))
        done = done.unionByName(got)
        left = freeze(left.join(got, coords, "left_anti"))
        cell *= 16 if got.isEmpty() else 2
    return query.join(done, coords, "left").select(qid, "distance")


def available_after(rows: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """Vintage gate: only rows that became available strictly after their entity's commit."""
    return rows.join(commits, keys).where(F.col("available_at") > F.col("commit_at"))


def value_as_of(rows: DataFrame, commits: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Last known value at the commit instant, by max_by (combined before the shuffle)."""
    j = rows.join(commits, keys).where(F.col(ts) <= F.col("commit_at"))
    return j.groupBy(*keys).agg(F.max(ts).alias("as_of"), F.max_by(value, ts).alias("value"))


def barrier_check(cutoffs: DataFrame, rows: DataFrame, ts: str) -> DataFrame:
    """The latest model cutoff and how many rows are not strictly after it."""
    t = cutoffs.agg(F.max("cutoff").alias("t_now"))
    return rows.join(F.broadcast(t)).agg(  # one row: the maximum cutoff
        F.count_if(F.col(ts) <= F.col("t_now")).alias("n_stale"), F.count(F.lit(1)).alias("n_total"),
        F.max("t_now").alias("t_now")).withColumn("ok", F.col("n_stale") == 0)


def memorisation_gap(scores: DataFrame, cohort: str, suspicious: float = 0.25) -> DataFrame:
    """Relative error drop on repeated against fresh challenges, per model."""
    a = scores.groupBy("model").agg(F.avg(F.when(F.col(cohort) == "fresh", F.col("smae"))).alias("err_fresh"),
                                    F.avg(F.when(F.col(cohort) == "repeated", F.col("smae"))).alias("err_repeated"))
    gap = F.when(F.col("err_fresh") > dims.EPS, (F.col("err_fresh") - F.col("err_repeated")) / F.col("err_fresh")).otherwise(0.0)
    return a.withColumn("gap", gap).withColumn("suspicious", F.col("gap") > suspicious)
