"""Diagonal Gaussian mixtures of many groups at once, and the divergence between two of them.

Every round of expectation and maximisation is one pass over all points: the
component densities are array expressions of the point and its group's few
parameters, the moments are sums combined before the shuffle. A group whose
likelihood has settled keeps its parameters and leaves the rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import freeze

COMPONENTS, ROUNDS, SETTLED, RIDGE, DRAWS = 8, 100, 1e-4, 1e-6, 10_000
TINY = 1e-12
LOG_2PI = 1.8378770664093453


def _log_parts(x: list[str], c: str) -> str:
    """SQL: log of weight times density of component ``c`` (struct w, m, v) at the point in columns ``x``."""
    square = " + ".join(f"(({p} - {c}.m[{k}]) * ({p} - {c}.m[{k}]) / {c}.v[{k}] + ln({c}.v[{k}]))" for k, p in enumerate(x))
    return f"(ln({c}.w + {TINY}D) - 0.5D * ({len(x) * LOG_2PI!r}D + {square}))"


def log_density(x: list[str], mixture: str) -> str:
    """SQL: log density of the point in columns ``x`` under the array ``mixture``."""
    parts = f"transform({mixture}, c_ -> {_log_parts(x, 'c_')})"
    return f"transform(array({parts}), l_ -> transform(array(array_max(l_)), t_ -> t_ + ln(aggregate(l_, 0D, (a_, e_) -> a_ + exp(e_ - t_))))[0])[0]"


def fit(points: DataFrame, keys: list[str], x: list[str], components: int = COMPONENTS, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """(keys, n, mixture): an array of (w, m, v) per group of points in columns ``x``.

    A group starts from as many of its points as it has components, least by a
    hash of the seed and the coordinates, so equal groups fit equal mixtures;
    fewer points give as many components. Rows with a null coordinate are left out.
    """
    points = freeze(points.where(" AND ".join(f"{c} IS NOT NULL" for c in x)).select(*keys, *[F.col(c).cast("double").alias(c) for c in x]))
    first = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *x), *x)
    seeds = points.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= components)
    seeds = seeds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", F.array(*x).alias("m")))).alias("_s"))
    base = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.var_pop(c) + RIDGE for c in x]).alias("_v"))
    start = F.expr("transform(_s, e_ -> named_struct('w', 1D / size(_s), 'm', e_.m, 'v', _v))")
    live = freeze(base.join(seeds, keys).select(*keys, "n", start.alias("mixture"), F.lit(None).cast("double").alias("ll")))
    done: list[DataFrame] = []
    for turn in range(rounds):
        new = freeze(_round(points, live, keys, x, components))
        old = live.select(*keys, F.col("ll").alias("_old"))
        new = new.join(old, keys).withColumn("_end", F.coalesce(F.abs(F.col("ll") - F.col("_old")) <= SETTLED * (F.abs("ll") + TINY), F.lit(False)))
        settled = new.where("_end").select(*keys, "n", "mixture")
        live = new.where("NOT _end").select(*keys, "n", "mixture", "ll")
        left = live.count()
        if left == 0 or turn == rounds - 1:
            done += [settled, live.select(*keys, "n", "mixture")]
            break
        done.append(settled)
    return freeze(reduce(DataFrame.unionAll, done))


def _round(points: DataFrame, live: DataFrame, keys: list[str], x: list[str], components: int) -> DataFrame:
    """One round over the points of the groups in ``live``: their next parameters and the likelihood of the present ones."""
    p = points.join(live.select(*keys, "mixture"), keys)
    p = p.withColumn("_l", F.expr(f"transform(mixture, c_ -> {_log_parts(x, 'c_')})")).withColumn("_top", F.array_max("_l"))
    p = p.withColumn("_d", F.expr("transform(array(_top), t_ -> transform(_l, e_ -> exp(e_ - t_)))[0]")).withColumn("_sum", F.expr("aggregate(_d, 0D, (a_, e_) -> a_ + e_)"))

    def resp(k: int) -> Column:
        return F.coalesce(F.get("_d", F.lit(k)) / F.col("_sum"), F.lit(0.0))

    sums = [F.sum(F.col("_top") + F.log("_sum")).alias("ll"), F.count(F.lit(1)).alias("n"), F.max(F.size("_d")).alias("_k")]
    for k in range(components):
        sums.append(F.sum(resp(k)).alias(f"r{k}"))
        sums += [F.sum(resp(k) * F.col(c)).alias(f"s{k}_{i}") for i, c in enumerate(x)]
        sums += [F.sum(resp(k) * F.col(c) * F.col(c)).alias(f"q{k}_{i}") for i, c in enumerate(x)]
    got = p.groupBy(*keys).agg(*sums)
    made = []
    for k in range(components):
        n = F.col(f"r{k}") + TINY
        mean = [F.col(f"s{k}_{i}") / n for i in range(len(x))]
        # sum of r (x - mean)^2 with the new mean
        var = [F.greatest((F.col(f"q{k}_{i}") - 2 * mean[i] * F.col(f"s{k}_{i}") + mean[i] * mean[i] * F.col(f"r{k}")) / n, F.lit(0.0)) + RIDGE for i in range(len(x))]
        made.append(F.struct((n / F.col("n")).alias("w"), F.array(*mean).alias("m"), F.array(*var).alias("v")))
    return got.select(*keys, "n", F.slice(F.array(*made), F.lit(1), F.col("_k")).alias("mixture"), "ll")


def mixture_divergence(truth: DataFrame, generated: DataFrame, keys: list[str], x: list[str], components: int = COMPONENTS,
                       draws: int = DRAWS, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """(keys, d_stsp): mean log ratio of the truth's mixture to the generated one's at points of the truth, not below 0.

    Beyond ``draws`` points of a group those least by a seeded hash of their
    coordinates count: the estimator is a Monte-Carlo mean. Mixtures of equal
    groups are equal, so a group against itself gives 0.
    """
    both = truth.select(*keys, *x, F.lit("t").alias("_kind")).unionByName(generated.select(*keys, *x, F.lit("g").alias("_kind")))
    made = fit(both, [*keys, "_kind"], x, components, rounds, seed)  # all groups of both sides share the rounds
    t = made.where("_kind = 't'").select(*keys, "n", F.col("mixture").alias("_t"))
    g = made.where("_kind = 'g'").select(*keys, F.col("mixture").alias("_g"))
    p = truth.where(" AND ".join(f"{c} IS NOT NULL" for c in x)).select(*keys, *x).join(t, keys)
    first = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed + 1), *x), *x)
    few = p.where(F.col("n") > draws).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= draws).drop("_r")
    p = p.where(F.col("n") <= draws).unionAll(few).join(g, keys)
    ratio = F.expr(f"{log_density(x, '_t')} - {log_density(x, '_g')}")
    return p.groupBy(*keys).agg(F.greatest(F.avg(ratio), F.lit(0.0)).alias("d_stsp"))
