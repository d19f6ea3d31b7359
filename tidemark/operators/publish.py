"""Round documents, index, history, block merge and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """Union of score blocks over one challenge set: the first block that has a model wins.

    Raises when a model's first block does not cover the same challenges.
    """
    first = blocks.groupBy("model").agg(F.min("block").alias("block"))
    merged = blocks.join(first, ["model", "block"])
    sets = blocks.select("block", "challenge_id", "source_id").distinct()
    n = sets.select("block").distinct().count()  # number of run groups, a handful
    odd = sets.groupBy("challenge_id", "source_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") != n)
    if not odd.isEmpty():
        raise ValueError("challenge sets differ across blocks")
    return merged


def round_documents(board: DataFrame, schema_version: int = 1) -> DataFrame:
    """One JSON document per round: envelope and the ranked leaderboard (roster-sized lists)."""
    row = F.struct("rank", "model", "crps_rel", "mase_rel", "crps", "mase")
    d = board.groupBy("round_id").agg(F.array_sort(F.collect_list(row)).alias("leaderboard"))
    return d.select("round_id", F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), "round_id", "leaderboard")).alias("document"))


def round_index(board: DataFrame, top: int = 3) -> DataFrame:
    """Index entry per round: the top models and how many were ranked."""
    t = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "model"))))
    return board.groupBy("round_id").agg(F.transform(t, lambda s: s["model"]).alias("top"), F.count(F.lit(1)).alias("n_models"))


def round_history(board: DataFrame) -> DataFrame:
    """Per round, arrays aligned to one sorted model list; a model absent from a round is NULL."""
    models = board.agg(F.array_sort(F.collect_set("model")).alias("models"))
    per = board.groupBy("round_id").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("rank", "mase_rel", "crps_rel")))).alias("m"))
    j = per.join(F.broadcast(models))  # one row: the model roster
    at = lambda f: F.transform("models", lambda x: F.try_element_at("m", x)[f]).alias(f"{f}s")
    return j.select("round_id", "models", at("rank"), at("mase_rel"), at("crps_rel"))


def report_table(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample spread per cell; NaN drops out, a single run has spread 0."""
    v = lambda c: F.when(~F.isnan(c), F.col(c))
    aggs = []
    for m in metrics:
        aggs += [F.avg(v(m)).alias(f"{m}_mean"),
                 F.when(F.count(v(m)) > 1, F.stddev_samp(v(m))).when(F.count(v(m)) == 1, 0.0).alias(f"{m}_std")]
    return runs.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_runs"))


def write_report(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def forecast_validation(fc: DataFrame, challenges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accept forecasts of the right length with a median level; report models left with none."""
    ok = F.expr("size(mean) = horizon AND exists(q, e -> e.level = 0.5D) AND forall(q, e -> size(e.path) = horizon)")
    j = fc.join(challenges.select("challenge_id", "horizon"), "challenge_id")
    good = j.where(ok)
    missing = fc.select("model").distinct().join(good.select("model").distinct(), "model", "left_anti")
    return good, missing
