"""Stratified, jittered series sampling as pure functions of (seed, stable key).

Quotas live in small tables (domains, classes, bands); the series themselves are
only ranked inside their cell by a hash, so a draw is a filter on a rank and
the same seed gives the same draw on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.hashing import uniform
from tidemark.operators.bounded import running_total

MIN_CLASS_SLOTS = 3  # --- fixed value: slots a class needs to clear the breadth gate


def even_split(total: Column, k: Column, index: Column) -> Column:
    """Slots of the 0-based ``index``-th of ``k`` groups when ``total`` is split evenly."""
    return F.floor(total / k) + F.when(index < total % k, 1).otherwise(0)


def _indexed(df: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Distinct children with their position and number inside the parent (label-sized tables)."""
    d = df.select(*parent, child).distinct()
    w = Window.partitionBy(*parent)
    return d.select(*parent, child, (F.row_number().over(w.orderBy(child)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_k"))


def equal_weight_quotas(series: DataFrame, n: int, balance_cadence: bool = True) -> DataFrame:
    """Quota per (domain, class, band) cell: even over domains, then classes, then bands."""
    cells = series.select("domain", "dgp_class", "cadence").distinct()
    q = _indexed(cells, [], "domain").select("domain", even_split(F.lit(n), F.col("_k"), F.col("_i")).alias("n_dom"))
    c = _indexed(cells, ["domain"], "dgp_class").join(q, "domain").select(
        "domain", "dgp_class", even_split(F.col("n_dom"), F.col("_k"), F.col("_i")).alias("n_cls"))
    if not balance_cadence:
        return c.withColumnRenamed("n_cls", "quota")
    return _indexed(cells, ["domain", "dgp_class"], "cadence").join(c, ["domain", "dgp_class"]).select(
        "domain", "dgp_class", "cadence", even_split(F.col("n_cls"), F.col("_k"), F.col("_i")).alias("quota"))


def pick(series: DataFrame, quotas: DataFrame, cell: list[str], key: str, seed: str, bound: int) -> DataFrame:
    """Without replacement while distinct series remain, then duplicates by hash.

    ``bound`` is the size of the whole draw, so no quota exceeds it: as a literal
    limit on the rank it is applied before the shuffle, and a cell holding a third
    of all series sends at most ``bound`` rows per task.

    Every series is ranked once by hash inside its cell; overflow slots address a
    rank, so they are an equi-join and not a second pass.
    """
    w = Window.partitionBy(*cell)
    r = series.join(quotas.where("quota > 0"), cell).withColumn("_u", uniform(seed, F.lit("pick"), F.col(key)))
    r = r.withColumn("rank", F.row_number().over(w.orderBy("_u", key))).where(F.col("rank") <= bound).where(
        "rank <= quota").drop("_u")
    size = series.groupBy(*cell).agg(F.count(F.lit(1)).alias("size"))
    over = quotas.join(size, cell).where("quota > size").withColumn("slot", F.explode(F.expr("sequence(size + 1, quota)")))
    over = over.withColumn("rank", F.floor(uniform(seed, F.lit("extra"), *[F.col(c) for c in cell], F.col("slot")) * F.col("size")) + 1)
    extra = over.select(*cell, "slot", F.col("rank").cast("int").alias("rank")).join(r.drop("quota"), [*cell, "rank"])
    first = r.withColumn("slot", F.col("rank").cast("long"))
    return first.select(*cell, key, "slot").unionByName(extra.select(*cell, key, F.col("slot").cast("long").alias("slot")))


def gamma_share(seed: str, key: Column, alpha: int) -> Column:
    """Gamma(alpha) by hash for an integer alpha: minus the log of a product of uniforms."""
    logs = [F.log(F.greatest(uniform(seed, F.lit("gamma"), key, F.lit(i)), F.lit(1e-12))) for i in range(alpha)]
    return -sum(logs, F.lit(0.0))


def jittered_quotas(domains: DataFrame, total: int, seed: str, alpha: int = 4, block: int = MIN_CLASS_SLOTS) -> DataFrame:
    """Dirichlet-jittered largest-remainder split in blocks, one block at least per domain.

    With fewer blocks than domains the slots go to a seeded subset. The table
    holds one row per domain.
    """
    d = domains.select("domain").distinct()
    all_ = Window.partitionBy()
    d = d.withColumn("k", F.count(F.lit(1)).over(all_)).withColumn("g", gamma_share(seed, F.col("domain"), alpha))
    nb = total // block
    avail = F.greatest(F.lit(nb) - F.col("k"), F.lit(0))
    d = d.withColumn("raw", F.col("g") / F.sum("g").over(all_) * avail).withColumn("base", F.floor("raw"))
    d = d.withColumn("rem", avail - F.sum("base").over(all_)).withColumn(
        "ord", F.row_number().over(all_.orderBy(F.desc(F.col("raw") - F.col("base")), "domain")))
    d = d.withColumn("blocks", F.col("base") + F.when(F.col("ord") <= F.col("rem"), 1).otherwise(0) + 1)
    d = d.withColumn("top", F.row_number().over(all_.orderBy(F.desc("blocks"), "domain")))
    full = F.col("blocks") * block + F.when(F.col("top") == 1, total - nb * block).otherwise(0)
    m = max(1, nb)
    seat = F.row_number().over(all_.orderBy(uniform(seed, F.lit("seat"), F.col("domain")), "domain")) - 1
    few = F.when(seat < m, even_split(F.lit(total), F.lit(m), seat)).otherwise(0)
    return d.select("domain", F.when(F.col("k") > nb, few).otherwise(full).cast("long").alias("quota"))


def rotate_classes(series: DataFrame, quotas: DataFrame, seed: str, keep_frac: float) -> DataFrame:
    """Classes active this round: a hash mask, then at most one class per block, size-weighted.

    Weighted sampling without replacement by exponential keys, -ln(u) / weight;
    a domain with slots always fields at least one class.
    """
    c = series.groupBy("domain", "dgp_class").agg(F.count(F.lit(1)).alias("size")).join(quotas, "domain").where("quota > 0")
    c = c.withColumn("keep", uniform(seed, F.lit("mask"), F.col("domain"), F.col("dgp_class")) < keep_frac)
    w = Window.partitionBy("domain")
    fallback = F.row_number().over(w.orderBy(uniform(seed, F.lit("one"), F.col("domain"), F.col("dgp_class")), "dgp_class")) == 1
    c = c.withColumn("any", F.max(F.col("keep").cast("int")).over(w)).withColumn("fb", fallback)
    c = c.where(F.col("keep") | ((F.col("any") == 0) & F.col("fb")))
    u = F.greatest(uniform(seed, F.lit("draw"), F.col("domain"), F.col("dgp_class")), F.lit(1e-12))
    key = -F.log(u) / F.least("size", F.lit(MIN_CLASS_SLOTS))
    cap = F.greatest(F.lit(1), F.floor(F.col("quota") / MIN_CLASS_SLOTS))
    c = c.withColumn("r", F.row_number().over(w.orderBy(key, "dgp_class"))).where(F.col("r") <= cap)
    i = F.row_number().over(w.orderBy("dgp_class")) - 1
    return c.select("domain", "dgp_class", even_split(F.col("quota"), F.count(F.lit(1)).over(w), i).cast("long").alias("quota"))


def mixture_draw(components: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` draws from weighted feeds: cumulative weights and a hash uniform per draw.

    The line of cumulative weights is cut into as many equal buckets as there
    are feeds. A feed goes to every bucket it reaches into, a draw to its own, and
    takes the first feed there that ends behind it: two candidates per draw on
    average whatever the weights, and no table of all feeds in one place.
    Feeds without weight are never drawn; without any weight there are no draws.
    """
    c = running_total(components.where("weight > 0").select("feed", "weight"), [], "feed", "weight", "hi")
    line = c.agg(F.max("hi").alias("total"), F.count(F.lit(1)).alias("k"))  # one row
    c = c.join(F.broadcast(line))
    place = lambda x: F.least(F.floor(x / F.col("total") * F.col("k")), F.col("k") - 1)
    ends = c.select("feed", "hi", F.explode(F.sequence(F.greatest(place(F.col("hi") - F.col("weight")), F.lit(0)), place(F.col("hi")))).alias("_b"))
    draws = components.sparkSession.range(n).withColumn("u", uniform(seed, F.lit("mix"), F.col("id"))).join(F.broadcast(line))
    draws = draws.select("id", (F.col("u") * F.col("total")).alias("x"), place(F.col("u") * F.col("total")).alias("_b"))
    return draws.join(ends, "_b").where("hi > x").groupBy("id").agg(F.min_by("feed", "hi").alias("feed"))


def redraw_pool(series: DataFrame, usable: Column, quotas: DataFrame, cell: list[str], key: str, seed: str,
                bound: int) -> tuple[DataFrame, DataFrame]:
    """Unusable series leave first, then the draw runs; the shortfall is a row, not a silence."""
    good = series.where(usable)
    got = pick(good, quotas, cell, key, seed, bound)
    asked = quotas.agg(F.sum("quota").alias("asked"))
    short = got.agg(F.count(F.lit(1)).alias("served")).join(F.broadcast(asked)).withColumn("short", F.col("asked") - F.col("served"))
    return got, short
