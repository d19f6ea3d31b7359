"""Score contributions per (model, challenge) and their additive roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import dims
from tidemark.functions.hashing import uniform
from tidemark.functions import arrays as A
from tidemark.operators.bounded import running_total
from tidemark.session import freeze

NQ = len(dims.DECILES)


def pinball(level: str, t: str = "t", p: str = "p") -> str:
    return f"greatest({level} * ({t} - {p}), ({level} - 1) * ({t} - {p}))"


def dense_grid(grid: tuple[float, ...]) -> str:
    """Where each dense level reads the model's own grid: (lo, hi, weight), clamped outside."""
    rows = []
    for lv in dims.CRPS_LEVELS:
        if lv <= grid[0]:
            lo = hi = 0
            w = 0.0
        elif lv >= grid[-1]:
            lo = hi = len(grid) - 1
            w = 0.0
        else:
            lo = max(k for k, g in enumerate(grid) if g <= lv + 1e-12)
            hi = lo + 1
            w = (lv - grid[lo]) / (grid[hi] - grid[lo])
            w = 0.0 if abs(w) < 1e-9 else w
        rows.append(f"named_struct('level', {lv}D, 'lo', {lo}, 'hi', {hi}, 'w', {w}D)")
    return f"array({', '.join(rows)})"


def interval_grid(at: dict[float, int]) -> str:
    rows = [f"named_struct('lo', {at[lo]}, 'hi', {at[hi]}, 'a', {round(1 - (hi - lo), 3)}D)"
            for lo, hi in dims.WIS_PAIRS]
    return f"array({', '.join(rows)})"


def contributions(fc: DataFrame, grid: tuple[float, ...] = dims.DECILES) -> DataFrame:
    """Everything a metric needs from one forecast, as flat additive columns.

    Pure array expressions on one row: no explode, no shuffle.
    """
    at = {g: i for i, g in enumerate(grid)}
    deciles = "array(" + ", ".join(f"q[{at[lv]}]" for lv in dims.DECILES) + ")"
    abs_err = A.total("zip_with(truth, mean, (t, p) -> abs(t - p))")
    wql = (f"2 * aggregate({deciles}, 0D, (s, e) -> s + "
           + A.total(f"zip_with(truth, e.path, (t, p) -> {pinball('e.level')})") + ")")
    crps = (f"2 / {len(dims.CRPS_LEVELS)}D / horizon * aggregate({dense_grid(grid)}, 0D, (s, g) -> s + "
            + A.total("zip_with(truth, zip_with(q[g.lo].path, q[g.hi].path, (x, y) -> x + (y - x) * g.w), "
                      f"(t, p) -> {pinball('g.level')})") + ")")
    band = f"zip_with(q[{at[0.1]}].path, q[{at[0.9]}].path, (l, u) -> named_struct('l', l, 'u', u))"
    cover = A.total(f"zip_with(truth, {band}, (t, b) -> if(t >= b.l AND t <= b.u, 1D, 0D))") + " / horizon"
    span = A.total("zip_with(q[g.hi].path, q[g.lo].path, (u, l) -> u - l)")
    below = A.total("zip_with(truth, q[g.lo].path, (t, l) -> greatest(l - t, 0D))")
    above = A.total("zip_with(truth, q[g.hi].path, (t, u) -> greatest(t - u, 0D))")
    mid = A.total(f"zip_with(truth, q[{at[0.5]}].path, (t, p) -> abs(t - p))")
    wis = (f"(0.5D * {mid} + aggregate({interval_grid(at)}, 0D, (s, g) -> s + g.a / 2 * "
           f"({span} + 2 / g.a * ({below} + {above})))) / {len(dims.WIS_PAIRS) + 0.5}D / horizon")
    hits = f"transform({deciles}, e -> " + A.total("zip_with(truth, e.path, (t, p) -> if(t <= p, 1D, 0D))") + ")"
    floor = dims.UNSEEN_WEIGHT_FLOOR
    return fc.select(
        "model", "challenge_id", "draw", "source_id", "series_key", "domain", "dgp_class", "cadence",
        "horizon", "unseen_frac", "scale", "sigma0",
        F.expr(f"{floor}D + {1 - floor}D * unseen_frac").alias("weight"),
        F.expr(f"{abs_err} / horizon").alias("mae"),
        F.expr(A.total("transform(truth, t -> abs(t))")).alias("abs_truth"),
        F.expr(wql).alias("wql_num"), F.expr(wis).alias("wis"), F.expr(crps).alias("crps"),
        F.expr(cover).alias("cover80"), F.expr(hits).alias("hits"),
    ).select("*", F.expr("mae / scale").alias("mase"), F.expr("mae / sigma0").alias("smae"))


def metric_sums() -> list[Column]:
    """The additive accumulator: plain sums, so partial and final aggregation are built in."""
    w = F.col("weight")
    return [
        F.sum(w).alias("wsum"), F.count(F.lit(1)).alias("n"), F.sum("unseen_frac").alias("unseen_sum"),
        F.sum(w * F.col("mase")).alias("mase_sum"), F.sum(w * F.col("mae")).alias("mae_sum"),
        F.sum(w * F.col("wql_num")).alias("wql_num"), F.sum(w * F.col("abs_truth")).alias("wql_den"),
        F.sum(w * F.col("crps")).alias("crps_sum"), F.sum(w * F.col("wis")).alias("wis_sum"),
        F.sum(w * F.col("cover80")).alias("cover_sum"), F.sum(w * F.col("horizon")).alias("points"),
        *[F.sum(w * F.col("hits")[i - 1]).alias(f"hit_{i}") for i in range(1, NQ + 1)],
    ]


def finish_metrics() -> list[Column]:
    n = F.greatest(F.col("wsum"), F.lit(dims.EPS))
    pts = F.greatest(F.col("points"), F.lit(dims.EPS))
    gaps = [F.abs(F.col(f"hit_{i + 1}") / pts - lv) for i, lv in enumerate(dims.DECILES)]
    return [
        (F.col("mase_sum") / n).alias("mase"),
        (F.col("wql_num") / (NQ * F.greatest(F.col("wql_den"), F.lit(dims.EPS)))).alias("wql"),
        (F.col("crps_sum") / n).alias("crps"), (F.col("wis_sum") / n).alias("wis"),
        (sum(gaps, F.lit(0.0)) / NQ).alias("pce"), (F.col("cover_sum") / n).alias("coverage_80"),
        (F.col("mae_sum") / n).alias("mae"), F.col("n"),
        (F.col("unseen_sum") / F.greatest(F.col("n"), F.lit(1))).alias("unseen_frac"),
    ]


SUM_COLUMNS = ("wsum", "n", "unseen_sum", "mase_sum", "mae_sum", "wql_num", "wql_den", "crps_sum", "wis_sum",
               "cover_sum", "points", *[f"hit_{i}" for i in range(1, NQ + 1)])


def metrics_by(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(*metric_sums()).select(*keys, *finish_metrics())


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def shifted_gmean(x: Column, w: Column, shift: float = dims.GMEAN_SHIFT) -> Column:
    """Weighted shifted geometric mean; non-finite values and non-positive weights drop out."""
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & w.isNotNull() & ~F.isnan(w) & (w > 0)
    ww = F.when(ok, w)
    lg = F.when(ok, F.log(F.greatest(x, F.lit(0.0)) + shift))
    return F.exp(F.sum(ww * lg) / F.sum(ww)) - shift


def per_source(scores: DataFrame) -> DataFrame:
    """Additive metric sums per (model, source), with the weighted mean scores beside them."""
    return scores.groupBy("model", "source_id").agg(*metric_sums()).select(
        "*", (F.col("mase_sum") / F.col("wsum")).alias("src_mase"),
        (F.col("crps_sum") / F.col("wsum")).alias("src_crps"))


def relative_to(per_src: DataFrame, baseline: str = "seasonal_naive", eps: float = dims.EPS) -> DataFrame:
    """Ratio of every model to the baseline on the same source.

    The partition holds one row per model, so a window replaces the self-join
    and the score table is computed once.
    """
    w = Window.partitionBy("source_id")
    base = lambda c: F.max(F.when(F.col("model") == baseline, F.col(c))).over(w)
    return per_src.select(
        "*",
        (F.col("src_mase") / F.greatest(base("src_mase"), F.lit(eps))).alias("mase_ratio"),
        (F.col("src_crps") / F.greatest(base("src_crps"), F.lit(eps))).alias("crps_ratio"))


def leaderboard(scores: DataFrame, primary: str = "mase", eps: float = dims.EPS) -> DataFrame:
    """Metric suite per model, plus the per-source relative shifted gmeans and the rank.

    One aggregation to (model, source) sums; the suite is the sum of those sums.
    """
    rel = relative_to(per_source(scores), eps=eps)
    board = rel.groupBy("model").agg(
        *[F.sum(c).alias(c) for c in SUM_COLUMNS],
        shifted_gmean(F.col("mase_ratio"), F.col("wsum")).alias("mase_rel"),
        shifted_gmean(F.col("crps_ratio"), F.col("wsum")).alias("crps_rel"))
    # one row per model: the ordering window is over the model list only
    return board.select("model", *finish_metrics(), "mase_rel", "crps_rel").withColumn(
        "rank", F.row_number().over(Window.orderBy(F.round(f"{primary}_rel", 9), "model")))


def bootstrap_totals(rows: DataFrame, group: str, unit: str, sums: list[str], seed: str, boots: int) -> DataFrame:
    """(group, boot, sums): resampled totals; each of ``boots`` samples of a group draws as many rows as the group has, with replacement.

    Rows are numbered by ``unit`` within their group. Slot k of a sample takes the
    row that a hash of (seed, boot, k) names, so groups of one size are resampled
    alike. Draws of the same row are counted first, then meet their row once.
    """
    num = freeze(running_total(rows.withColumn("_one", F.lit(1).cast("bigint")), [group], unit, "_one", "_upto").withColumn("_i", F.col("_upto") - 1))
    size = num.groupBy(group).agg(F.max("_upto").alias("_n"))
    slots = num.select(group, "_i").join(size, group).withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(boots - 1))))
    drawn = slots.select(group, "boot", F.floor(uniform(seed, F.col("boot"), F.col("_i")) * F.col("_n")).cast("bigint").alias("_i"))
    times = drawn.groupBy(group, "boot", "_i").agg(F.count(F.lit(1)).alias("_t"))
    return times.join(num.select(group, "_i", *sums), [group, "_i"]).groupBy(group, "boot").agg(*[F.sum(F.col("_t") * F.col(c)).alias(c) for c in sums])
