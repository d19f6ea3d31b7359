"""Along-the-series operators: gaps, segments, runs, lags, strided windows, motifs.

Series of raw events can be arbitrarily long, so their gaps and segments go
through the bucketed helpers. Statistics with ordinary windows run on binned
series or served windows, whose length the calendar or the profile bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import dims
from tidemark.functions import arrays as A, timeparse as T
from tidemark.functions.hashing import uniform
from tidemark.operators.bounded import previous_in_time, running_count_in_time, running_total
from tidemark.operators.clean import degenerate_reason, median_fill
from tidemark.session import freeze

GAP_FACTOR = 8.0


READABLE = 0.9  # share of readable stamps above which a series is put in their order


def chronological(df: DataFrame, keys: list[str], ts: str, seq: str) -> DataFrame:
    """``df`` with position, each row's place from 1 on along its series: by stamp, unreadable ones last, equal ones by arrival.

    A series with too few readable stamps stays in order of arrival. ``seq``
    numbers arrivals and is unique in a series. Positions are running counts over
    range pieces, so a long series is not ordered in one task.
    """
    share = df.groupBy(*keys).agg(F.avg(F.col(ts).isNotNull().cast("double")).alias("_share"))
    stamp = F.when(F.col("_share") > READABLE, F.col(ts))
    rows = df.join(share, keys).withColumn("_o", F.struct(stamp.isNull().alias("late"), stamp.alias("at"), F.col(seq).alias("seq"))).withColumn("_one", F.lit(1).cast("long"))
    return running_total(rows, keys, "_o", "_one", "position").drop("_share", "_o", "_one")


def rejection_summary(judged: DataFrame, reason: str) -> DataFrame:
    """(reason, n_series): how many series each reason rejected, without the figures in brackets behind it."""
    plain = F.trim(F.split(reason, "\\(")[0])
    return judged.where(F.col(reason).isNotNull()).groupBy(plain.alias("reason")).agg(F.count(F.lit(1)).alias("n_series"))


def gap_table(df: DataFrame, keys: list[str], ts: str, bucket_seconds: int = 60) -> DataFrame:
    """Distinct stamps with the gap (s) to the preceding one."""
    stamps = df.where(F.col(ts).isNotNull()).select(*keys, ts).distinct()
    g = previous_in_time(stamps, keys, ts, {ts: "prev_ts"}, bucket_seconds)
    return g.withColumn("gap_s", (F.unix_micros(ts) - F.unix_micros("prev_ts")) / 1e6).drop("prev_ts")


def median_gap(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Median positive gap per series.

    Gaps are whole microseconds and are counted per value first. Distinct gaps of
    one series sum to at most its span, so their number grows with the root of it.
    """
    c = (gaps.where("gap_s > 0").withColumn("g", F.round(F.col("gap_s") * 1e6).cast("bigint")).groupBy(*keys, "g")
         .agg(F.count(F.lit(1)).alias("c")))
    return c.groupBy(*keys).agg((F.percentile("g", F.lit(0.5), F.col("c")) / 1e6).alias("median_gap_s"))


def segments(df: DataFrame, keys: list[str], ts: str, bucket_seconds: int = 60) -> DataFrame:
    """Cut a series where a gap exceeds 8 x its median gap; one row per stamp with its segment number."""
    g = gap_table(df, keys, ts, bucket_seconds)
    m = median_gap(g, keys)
    j = g.join(m, keys, "left").withColumn(
        "cut", F.coalesce((F.col("gap_s") > GAP_FACTOR * F.col("median_gap_s")).cast("bigint"), F.lit(0)))
    return running_count_in_time(j, keys, ts, "cut", "segment", bucket_seconds)


def longest_segment(seg: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Longest contiguous segment per series, the first one on a tie."""
    per = seg.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    best = per.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("segment")).alias("o"), "start", "end")).alias("b"),
                                  F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_segments"))
    return best.select(*keys, F.col("b.n").alias("longest"), F.col("b.start").alias("start"),
                       F.col("b.end").alias("end"), "n_rows", "n_segments")


def cadence_profile(df: DataFrame, keys: list[str], ts: str, now: str) -> DataFrame:
    """Distinct stamps, median gap, age, share of future stamps, and the frequency they imply."""
    cutoff = F.expr(f"TIMESTAMP'{now}' + INTERVAL 1 DAY")
    stamps = df.where(F.col(ts).isNotNull()).select(*keys, ts).distinct()
    base = stamps.groupBy(*keys).agg(
        F.count_if(F.col(ts) <= cutoff).alias("n_distinct"), F.count_if(F.col(ts) > cutoff).alias("n_future"),
        F.max(F.when(F.col(ts) <= cutoff, F.col(ts))).alias("newest"))
    med = median_gap(gap_table(stamps.where(F.col(ts) <= cutoff), keys, ts), keys)
    j = base.join(med, keys, "left")
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("newest")) / 86400.0
    j = j.withColumn("age_days", age).withColumn("frequency", F.expr(
        f"CASE WHEN median_gap_s > 0 THEN {T.freq_from_gap('median_gap_s')} END"))
    verdict = F.expr("CASE WHEN n_distinct < 2 THEN 'too few stamps' WHEN n_future > greatest(1, 0.02 * (n_distinct + n_future)) "
                     "THEN 'future-dated' ELSE 'ok' END")
    return j.withColumn("verdict", verdict)


def adaptive_bin(df: DataFrame, keys: list[str], ts: str, need: int = 24) -> DataFrame:
    """Coarsest of day / six hours / hour with enough populated bins; all three counted in one pass."""
    sizes = {"P1D": 86400, "PT6H": 21600, "PT1H": 3600}
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    fine = df.groupBy(*keys, F.floor(sec / 3600).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    agg = fine.groupBy(*keys).agg(*[F.count_distinct(F.floor(F.col("h") * 3600 / s)).alias(k) for k, s in sizes.items()])
    pick = F.coalesce(*[F.when(F.col(k) >= need, F.lit(k)) for k in sizes])
    return agg.withColumn("bin", pick)


def activity_profile(bins: DataFrame, keys: list[str], ts: str, value: str, recent: int,
                     min_recent: int, min_nonzero: int, min_distinct: int) -> DataFrame:
    """Reject series that are idle, constant, or silent at the fresh end."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    r = bins.withColumn("_r", F.row_number().over(w))
    a = r.groupBy(*keys).agg(
        F.count_if(F.col(value) != 0).alias("nonzero"), F.count_distinct(value).alias("n_distinct"),
        F.count_if((F.col(value) != 0) & (F.col("_r") <= recent)).alias("recent"), F.count(F.lit(1)).alias("n_bins"))
    return a.withColumn("verdict", F.expr(
        f"CASE WHEN nonzero = 0 THEN 'all zero' WHEN recent < {min_recent} THEN 'quiet lately' "
        f"WHEN nonzero < {min_nonzero} THEN 'mostly empty' WHEN n_distinct < {min_distinct} THEN 'few values' ELSE 'ok' END"))


def longest_flat_run(bins: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Longest run of identical consecutive values as a fraction of length (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    ch = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    r = bins.withColumn("_c", ch).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(
        (F.max("c") / F.sum("c")).alias("flat_frac"), F.sum("c").alias("n"))


def lag_correlations(bins: DataFrame, keys: list[str], ts: str, value: str, lags: tuple[int, ...]) -> DataFrame:
    """Demeaned autocorrelation at a lag set; one window sort serves every lag."""
    w = Window.partitionBy(*keys).orderBy(ts)
    c = bins.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    c = c.select(*keys, "_x", *[F.lag("_x", p).over(w).alias(f"_l{p}") for p in lags])
    return c.groupBy(*keys).agg(*[(F.sum(F.col("_x") * F.col(f"_l{p}")) / F.sum(F.col("_x") * F.col("_x"))).alias(f"acf_{p}")
                                  for p in lags])


def seasonal_profile(bins: DataFrame, keys: list[str], ts: str, value: str, period: int) -> DataFrame:
    """Mean by phase, demeaned over phases."""
    w = Window.partitionBy(*keys).orderBy(ts)
    p = bins.withColumn("phase", (F.row_number().over(w) - 1) % period)
    p = p.groupBy(*keys, "phase").agg(F.avg(value).alias("m"))
    return p.withColumn("profile", F.col("m") - F.avg("m").over(Window.partitionBy(*keys))).drop("m")


def noise_to_signal(bins: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Step scale, second-difference noise, SNR in dB, and the least-squares line against position."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = bins.withColumn("_i", F.row_number().over(w) - 1).withColumn("_d1", F.col(value) - F.lag(value).over(w))
    d = d.withColumn("_d2", F.col("_d1") - F.lag("_d1").over(w))
    a = d.groupBy(*keys).agg(
        F.avg(F.abs("_d1")).alias("step"), (F.stddev_pop("_d2") / F.sqrt(F.lit(6.0))).alias("noise"),
        F.stddev_pop(value).alias("sd"), F.regr_slope(value, "_i").alias("slope"), F.regr_intercept(value, "_i").alias("intercept"))
    return a.withColumn("snr_db", F.expr("CASE WHEN noise > 1e-12 THEN 20 * log10(sd / noise) END"))


def strided_windows(bins: DataFrame, keys: list[str], ts: str, value: str, length: int, stride: int) -> DataFrame:
    """Every full window of ``length`` at ``stride``; the window is available when its last point is.

    Positions are assigned to the windows that cover them and regrouped, so only
    window-sized arrays are ever collected.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    p = bins.select(*keys, ts, value, (F.row_number().over(w) - 1).alias("pos"), n.alias("n"))
    lo = F.ceil(F.greatest(F.col("pos") - (length - 1), F.lit(0)) / F.lit(stride))
    hi = F.floor(F.least(F.col("pos"), F.col("n") - length) / F.lit(stride))
    p = p.where(hi >= lo).withColumn("win", F.explode(F.sequence(lo, hi)))
    g = p.groupBy(*keys, "win").agg(F.expr(f"array_sort(collect_list(struct(pos, {value})))").alias("_w"), F.max(ts).alias("available_at"))
    return g.select(*keys, (F.col("win") * stride).alias("start"), "available_at", F.expr(f"transform(_w, x -> x.{value})").alias("values"))


def embedding_delay(bins: DataFrame, keys: list[str], ts: str, value: str, max_lag: int = 50) -> DataFrame:
    """Delay per series: the first lag whose autocorrelation falls below 1/e."""
    acf = lag_correlations(bins, keys, ts, value, tuple(range(1, max_lag)))
    first = "coalesce(" + ", ".join(f"CASE WHEN acf_{p} < exp(-1D) THEN {p} END" for p in range(1, max_lag)) + ", 1)"
    return acf.select(*keys, F.expr(first).alias("tau"))


def embed_points(bins: DataFrame, keys: list[str], ts: str, value: str, tau: DataFrame, m: int = 3) -> DataFrame:
    """Delay vectors x(t), x(t+tau), ... of the standardised series, by equi-join on position."""
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(ts)
    sd = F.stddev_pop(value).over(whole)
    p = bins.select(*keys, (F.row_number().over(w) - 1).alias("pos"),
                    ((F.col(value) - F.avg(value).over(whole)) / F.when(sd > dims.EPS, sd).otherwise(1.0)).alias("x0"))
    out = p.join(tau, keys)
    for i in range(1, m):
        ahead = p.select(*keys, F.col("pos").alias("_q"), F.col("x0").alias(f"x{i}"))
        out = out.withColumn("_q", F.col("pos") + i * F.col("tau")).join(ahead, [*keys, "_q"]).drop("_q")
    return out


def place_window(seg_len: Column, length: int, key: Column, seed: str, tail_frac: float) -> Column:
    """Start offset inside a segment: the fresh end with probability ``tail_frac``, else uniform by hash."""
    win = F.least(seg_len, F.lit(length))
    free = seg_len - win
    return F.when(uniform(seed, key, F.lit("tail")) < tail_frac, free).otherwise(
        F.floor(uniform(seed, key, F.lit("start")) * (free + 1)))


def extract_motifs(bins: DataFrame, keys: list[str], ts: str, value: str, length: int, seed: str,
                   tail_frac: float = 0.5) -> DataFrame:
    """Longest contiguous segment -> honest window -> non-finite fill; refused series keep their reason.

    The bins are the compact form of the raw rows: they are frozen once, so the
    steps below never scan the lake again.
    """
    bins = freeze(bins.select(*keys, ts, value))
    seg = segments(bins, keys, ts, bucket_seconds=86400)
    best = longest_segment(seg, keys, ts)
    floor = min(length, dims.MIN_MOTIF_LENGTH)
    best = best.withColumn("key", F.concat_ws("|", *keys)).withColumn(
        "lo", place_window(F.col("longest"), length, F.col("key"), seed, tail_frac)).withColumn(
        "want", F.least("longest", F.lit(length)))
    w = Window.partitionBy(*keys).orderBy(ts)
    inside = bins.join(best, keys).where((F.col(ts) >= F.col("start")) & (F.col(ts) <= F.col("end")))
    inside = inside.withColumn("pos", F.row_number().over(w) - 1).where("pos >= lo AND pos < lo + want AND longest >= %d" % floor)
    win = inside.groupBy(*keys).agg(F.expr(f"array_sort(collect_list(struct({ts} AS ts, {value} AS value)))").alias("_w"))
    win = win.withColumn("_x", F.expr("transform(_w, p -> p.value)"))
    out = best.select(*keys, "longest", "n_rows", "n_segments", F.col("lo").cast("bigint").alias("start_pos")).join(win, keys, "left")
    reason = F.when(F.col("longest") < floor, F.lit("longest contiguous segment under floor")).otherwise(F.expr(degenerate_reason("_x")))
    return out.withColumn("reason", reason).withColumn("motif", F.expr(median_fill("_x"))).withColumn(
        "motif_ts", F.expr("transform(_w, p -> p.ts)")).drop("_w", "_x")


def longest_usable(obs: DataFrame, flow: str, key: str, code: str, period: str, order: tuple[str, ...],
                   min_periods: int = 20) -> DataFrame:
    """One series per flow: enough distinct periods, then frequency order, then most periods.

    A struct minimum picks it, so a flow with millions of series needs no sort.
    """
    s = obs.groupBy(flow, key, code).agg(F.count_distinct(period).alias("n_periods")).where(F.col("n_periods") >= min_periods)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(code)), F.lit(0)), F.lit(len(order) + 1))
    best = s.groupBy(flow).agg(F.min(F.struct(rank.alias("r"), (-F.col("n_periods")).alias("o"), F.col(key), F.col(code))).alias("b"))
    return best.select(flow, F.col(f"b.{key}").alias(key), F.col(f"b.{code}").alias(code), (-F.col("b.o")).alias("n_periods"))
