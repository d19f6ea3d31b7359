"""Ordered operators whose groups may hold a large share of all rows.

A window over a whole group runs in one task. These helpers split a group
first and stitch the pieces: by value range for running totals, ranks and
percentiles, by clock bucket for "previous row" along a time line. Every piece
and every per-piece summary is bounded, and nothing is sampled or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import freeze


def running_total(df: DataFrame, keys: list[str], order: str, weight: str, out: str) -> DataFrame:
    """Inclusive running sum of ``weight`` by ``order`` within ``keys``.

    ``df`` must be unique on (keys, order). Range partitioning spreads a hot key
    over tasks; the partition number is frozen with the rows in the checkpoint
    folder, so a recomputed task sees the same split.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = freeze(df.repartitionByRange(n, *keys, order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_part").agg(F.sum(weight).alias("_sum"))
        .select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    )
    upto = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn(out, F.sum(weight).over(upto))
        .join(offsets, [*keys, "_part"])
        .withColumn(out, F.col(out) + F.col("_off"))
        .drop("_part", "_off")
    )


def value_ranks(df: DataFrame, keys: list[str], value: str, *sums: Column) -> DataFrame:
    """Distinct values per group with their count and average rank (ties averaged)."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"), *sums)
    return running_total(counts, keys, value, "ties", "upto").withColumn(
        "avg_rank", F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per group, whatever the group size."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_total(counts, keys, value, "_c", "_upto")
    if keys:
        n = ranked.groupBy(*keys).agg(F.max("_upto").alias("_n"))
        ranked = ranked.join(n, keys)
    else:
        n = ranked.agg(F.max("_upto")).first()[0]
        ranked = ranked.withColumn("_n", F.lit(n))
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for side, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_upto") - F.col("_c") <= r) & (r < F.col("_upto"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_w"))
    got = ranked.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[
        (F.col(f"_{p}_lo") + (F.col(f"_{p}_hi") - F.col(f"_{p}_lo")) * F.col(f"_{p}_w")).alias(p)
        for p in probs])


def previous_in_time(df: DataFrame, keys: list[str], ts: str, carry: dict[str, str],
                     bucket_seconds: int = 60) -> DataFrame:
    """Columns of the preceding row along each series' time line.

    ``df`` must be unique on (keys, ts). Rows are windowed per (series, clock
    bucket); each bucket's last row is handed to the next populated bucket. A
    bucket holds at most ``bucket_seconds`` of clock ticks and a series at most
    span / bucket_seconds buckets, so neither window grows with a hot series.
    """
    cols = [ts, *[c for c in carry if c != ts]]
    b = df.withColumn("_b", F.floor(F.unix_micros(ts) / (bucket_seconds * 1_000_000)))
    edge = b.groupBy(*keys, "_b").agg(F.max_by(F.struct(*cols), ts).alias("_last"))
    edge = edge.select(*keys, "_b", F.lag("_last").over(
        Window.partitionBy(*keys).orderBy("_b")).alias("_edge"))
    inner = Window.partitionBy(*keys, "_b").orderBy(ts)
    b = b.withColumn("_prev", F.lag(F.struct(*cols)).over(inner))
    j = b.join(edge, [*keys, "_b"]).withColumn("_prev", F.coalesce("_prev", "_edge"))
    for c, name in carry.items():
        j = j.withColumn(name, F.col("_prev")[c])
    return j.drop("_prev", "_edge", "_b")


def running_count_in_time(df: DataFrame, keys: list[str], ts: str, flag: str, out: str,
                          bucket_seconds: int = 60) -> DataFrame:
    """Running sum of an integer flag along each series' time line, bucket by bucket."""
    b = df.withColumn("_b", F.floor(F.unix_micros(ts) / (bucket_seconds * 1_000_000)))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = b.groupBy(*keys, "_b").agg(F.sum(flag).alias("_s"))
    edge = edge.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    upto = Window.partitionBy(*keys, "_b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return (b.withColumn(out, F.sum(flag).over(upto)).join(edge, [*keys, "_b"])
            .withColumn(out, F.col(out) + F.col("_off")).drop("_b", "_off"))
