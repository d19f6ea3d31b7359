"""Benchmark-level gates: floor, headroom, breadth, parrot margin, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import dims

FLOOR_MODELS = ("seasonal_naive", "context_parrot")
PARROT_STEEPNESS = 6.0
COVERAGE_TARGET = 4.0
MIN_SHARE = 0.02


def clears_floor(metrics: DataFrame, primary: str = "mase", floor: tuple[str, ...] = FLOOR_MODELS) -> DataFrame:
    """Every model against each floor rung: strictly below all of them clears."""
    rung = lambda m: F.max(F.when(F.col("model") == m, F.col(primary))).over(Window.partitionBy())
    worst = F.greatest(*[rung(m) for m in floor])
    df = metrics.select("model", F.col(primary).alias("score"), *[rung(m).alias(f"floor_{m}") for m in floor], worst.alias("w"))
    name = F.coalesce(*[F.when(F.col(f"floor_{m}") == F.col("w"), F.lit(m)) for m in floor])
    clears = F.lit(True)
    for m in floor:
        clears = clears & (F.col("score") < F.col(f"floor_{m}"))
    return df.select("model", "score", *[f"floor_{m}" for m in floor], name.alias("worst_floor"), clears.alias("clears"))


def headroom(metrics: DataFrame, anchor: str) -> DataFrame:
    """Margins of every model over the anchor; positive is better than the anchor."""
    a = lambda m: F.max(F.when(F.col("model") == anchor, F.col(m))).over(Window.partitionBy())
    return metrics.select("model", *[(a(m) - F.col(m)).alias(f"{m}_margin") for m in ("mase", "wql", "crps")],
                          ((F.col("mase") < a("mase")) & (F.col("wql") <= a("wql"))).alias("beats_anchor"))


def panel_errors(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean scale-normalised error per model (and stratum)."""
    return scores.groupBy(*keys, "model").agg(F.avg("smae").alias("err"), F.count(F.lit(1)).alias("n"))


def spread(errors: DataFrame, *keys: str, anchor: str = "strong") -> DataFrame:
    """Discrimination = (max - min) / mean over the panel; difficulty = the anchor's error."""
    a = errors.groupBy(*keys).agg(F.max("err").alias("hi"), F.min("err").alias("lo"), F.avg("err").alias("m"), F.max("n").alias("n"),
                                  F.max(F.when(F.col("model") == anchor, F.col("err"))).alias("anchor"))
    return a.select(*keys, "n", F.when(F.col("m") > dims.EPS, (F.col("hi") - F.col("lo")) / F.col("m")).otherwise(0.0).alias("spread"),
                    F.coalesce("anchor", "lo").alias("difficulty"))


def parrot_gate(strong: Column, parrot: Column) -> Column:
    """Sigmoid of the error ratio: 0.5 when copying ties the strong baseline."""
    return F.when(strong <= dims.EPS, 0.0).otherwise(1 / (1 + F.exp(-PARROT_STEEPNESS * (parrot / strong - 1))))


def domain_coverage(labels: DataFrame) -> DataFrame:
    """Counts, entropy and effective number of domains (Hill number of order one)."""
    c = labels.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy())
    e = c.select(p.alias("p"), "c").agg(F.count(F.lit(1)).alias("n_domains"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))
    return e.withColumn("effective_domains", F.exp("entropy")).withColumn(
        "coverage_gate", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("effective_domains") / COVERAGE_TARGET)))


def min_share(labels: DataFrame, col: str) -> DataFrame:
    """Smallest share of any label; NULL labels do not count and an empty set scores 1."""
    c = labels.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.coalesce(F.min("c") / F.sum("c"), F.lit(1.0)).alias(f"{col}_share"))


def breadth_gate(share: Column, floor: float = MIN_SHARE) -> Column:
    return F.when(share >= floor, 1.0).otherwise(0.0)


def round_composition(labels: DataFrame) -> DataFrame:
    """Pooled mix, per-draw mix and cadence mix of a round in one grouping-sets pass."""
    g = labels.groupingSets([[F.col("domain")], [F.col("draw"), F.col("domain")], [F.col("cadence")]],
                            F.col("draw"), F.col("domain"), F.col("cadence")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("dgp_class").alias("n_classes"), F.grouping_id().alias("gid"))
    kind = F.expr("CASE gid WHEN 5 THEN 'pooled' WHEN 1 THEN 'draw' ELSE 'cadence' END")
    g = g.select(kind.alias("kind"), "draw", F.coalesce("domain", "cadence").alias("label"), "n", "n_classes")
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("kind", "draw")))
