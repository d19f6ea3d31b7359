"""Cutting forecasting challenges from binned series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import dims
from tidemark.functions import arrays as A

LABELS = ["source_id", "series_key", "domain", "dgp_class", "cadence", "freq"]


def profile(cadence: Column) -> tuple[Column, Column]:
    ctx = dims.lookup(cadence, {k: v[0] for k, v in dims.PROFILES.items()}, dims.DEFAULT_PROFILE[0])
    hor = dims.lookup(cadence, {k: v[1] for k, v in dims.PROFILES.items()}, dims.DEFAULT_PROFILE[1])
    return ctx, hor


def context_scale(raw: str, n: str) -> str:
    """Mean and scale of the context only; a flat context borrows the window's spread."""
    ctx = f"slice({raw}, 1, {n})"
    return A.let("s_", f"named_struct('mu', {A.mean(ctx)}, 'sd', {A.std_pop(ctx)}, 'all', {A.std_pop(raw)})",
                 f"named_struct('mu', s_.mu, 'sd', CASE WHEN s_.sd >= {dims.EPS} THEN s_.sd "
                 f"WHEN s_.all <> 0 THEN s_.all ELSE 1D END)")


def normalise_by_context(raw: str, n: str) -> str:
    """Leak-free z-score: the horizon's own statistics never enter."""
    return A.let("k_", context_scale(raw, n), f"transform({raw}, v_ -> (v_ - k_.mu) / k_.sd)")


def series_tails(bins: DataFrame, k_draws: int) -> DataFrame:
    """The freshest points each series needs, as one sorted array per series.

    The row_number limit is planned as a partial group limit ahead of the
    shuffle, so a hot series sends at most the literal bound per task.
    """
    bound = max(c + h * k_draws for c, h in dims.PROFILES.values())
    ctx, hor = profile(F.col("cadence"))
    w = Window.partitionBy("series_key").orderBy(F.col("ts").desc())
    tail = bins.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= bound)
    tail = tail.where(F.col("rn") <= ctx + hor * k_draws)
    return tail.groupBy(*LABELS).agg(
        F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("pts"))


def cut_challenges(bins: DataFrame, cutoff: str, k_draws: int = dims.K_DRAWS) -> DataFrame:
    """One challenge per series and draw; draw d ends d horizons before the newest point.

    The horizon is fixed by the band profile, the context shrinks to what the
    series has, nothing is padded, and a series too short for an honest window
    yields no row.
    """
    ctx, hor = profile(F.col("cadence"))
    s = (
        series_tails(bins, k_draws)
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k_draws - 1))))
        .withColumn("horizon", hor)
        .withColumn("n_end", F.size("pts") - F.col("draw") * F.col("horizon"))
        .withColumn("context_len", F.least(ctx, F.col("n_end") - F.col("horizon")))
        .where(F.col("n_end") >= F.least(ctx + hor, F.lit(dims.MIN_MOTIF_LENGTH)))
        .where("context_len >= 2")
        .withColumn("win", F.slice("pts", F.expr("n_end - context_len - horizon + 1"),
                                   F.expr("context_len + horizon")))
        .withColumn("raw", F.expr("transform(win, p -> p.value)"))
        .withColumn("z", F.expr(normalise_by_context("raw", "context_len")))
    )
    truth_ts = F.slice(F.transform("win", lambda p: p["ts"]),
                       F.col("context_len") + 1, F.col("horizon"))
    fresh = F.size(F.filter(truth_ts, lambda t: t >= F.lit(cutoff).cast("timestamp")))
    return s.select(
        F.concat_ws("#", "series_key", "draw").alias("challenge_id"),
        "draw", *LABELS, "context_len", "horizon",
        (fresh / F.col("horizon")).alias("unseen_frac"),
        F.slice("z", F.lit(1), F.col("context_len")).alias("context"),
        F.slice("z", F.col("context_len") + 1, F.col("horizon")).alias("truth"),
    )
