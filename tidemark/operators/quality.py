"""Series quality battery, discrimination filter and source verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import dims
from tidemark.functions import arrays as A
from tidemark.operators.series import longest_flat_run, noise_to_signal
from tidemark.session import freeze

SERIES_LEN = sum(dims.DEFAULT_PROFILE)


def assess_series(bins: DataFrame, keys: list[str], ts: str, value: str, min_len: int = SERIES_LEN) -> DataFrame:
    """Intrinsic battery per series; hard fails are listed in ``failures``.

    Counts, moments and distinct values aggregate before the shuffle. Runs and
    the median need order and work on binned series. The bins are frozen once, so
    the five aggregates below share one scan of the raw rows.
    """
    bins = freeze(bins.select(*keys, ts, value))
    v = F.col(value)
    fin = bins.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    total = bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("n0"))
    uniq = fin.groupBy(*keys, F.round(value, 10).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_unique"), F.sum("_c").alias("n"), F.percentile("_v", F.lit(0.5), F.col("_c")).alias("med"))
    mom = fin.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = longest_flat_run(fin, keys, ts, value).drop("n")
    snr = noise_to_signal(fin, keys, ts, value).select(*keys, "snr_db")
    j = total.join(uniq, keys, "left").join(mom, keys, "left").join(flat, keys, "left").join(snr, keys, "left")
    # sum of squared deviations about the median from the moments
    j = j.withColumn("ss", F.expr("n * (std * std + (mean - med) * (mean - med))")).withColumn(
        "spike", F.expr("CASE WHEN ss > 0 THEN greatest((hi - med) * (hi - med), (lo - med) * (lo - med)) / ss ELSE 0D END"))
    j = j.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("finite_frac", F.col("n") / F.col("n0")).withColumn(
        "unique_ratio", F.col("n_unique") / F.col("n"))
    fails = f"""array_compact(array(
      CASE WHEN finite_frac < 0.85 THEN 'finite_frac' END, CASE WHEN n < {min_len} THEN 'length' END,
      CASE WHEN n >= 8 AND (std <= 1e-6 * (abs(mean) + {dims.EPS}) OR std = 0) THEN 'near-constant' END,
      CASE WHEN n >= 8 AND unique_ratio < 0.05 THEN 'cardinality' END,
      CASE WHEN n >= 8 AND flat_frac > 0.5 THEN 'flatline' END,
      CASE WHEN n >= 8 AND spike > 0.5 THEN 'spike' END))"""
    return j.withColumn("failures", F.expr(fails)).withColumn("ok", F.size("failures") == 0).drop("ss", "lo", "hi")


def predictability(lags: tuple[int, ...] = (1, 2, 3, *dims.SEASONAL_PERIODS)) -> str:
    """Largest |autocorrelation| of a context over the fixed lag set (columns of with_context_stats)."""
    arr = ", ".join(str(p) for p in lags)
    return (f"if(denom <= {dims.EPS}, 0D, coalesce(array_max(transform(filter(array({arr}), p -> p < n), "
            f"p -> abs({A.lag_dot('centred', 'p')} / denom))), 0D))")


def discrimination(scored: DataFrame, keys: list[str], min_pred: float = 0.15, min_naive: float = 0.10, min_windows: int = 4) -> DataFrame:
    """Forecastable and not trivially solved, from per-window predictability and naive error."""
    a = scored.groupBy(*keys).agg(F.avg("predictability").alias("predictability"), F.avg("naive_error").alias("naive_error"), F.count(F.lit(1)).alias("n_windows"))
    return a.withColumn("reasons", F.expr(f"""CASE WHEN n_windows < {min_windows} THEN array('too few windows') ELSE array_compact(array(
      CASE WHEN predictability < {min_pred} THEN 'unforecastable' END, CASE WHEN naive_error < {min_naive} THEN 'trivial' END)) END""")).withColumn("ok", F.size("reasons") == 0)


def source_verdict(series_q: DataFrame, disc: DataFrame, pass_frac: float = 0.6) -> DataFrame:
    """Admit a source when enough series pass and its windows discriminate."""
    s = series_q.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_series"), F.count_if("ok").alias("n_ok"))
    j = s.join(disc.select("source_id", F.col("reasons").alias("d_reasons")), "source_id", "left")
    enough = F.col("n_ok") / F.col("n_series") >= pass_frac
    reasons = F.when(~enough, F.array(F.lit("too few series pass"))).otherwise(F.coalesce("d_reasons", F.array(F.lit("too few windows"))))
    return j.select("source_id", "n_series", "n_ok", reasons.alias("reasons")).withColumn("ok", F.size("reasons") == 0)
