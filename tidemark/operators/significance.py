"""Paired tests, omnibus test and multiple-comparison corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import tails
from tidemark.operators.bounded import exact_percentiles, value_ranks
from tidemark.session import freeze

PAIR = ["model_a", "model_b"]
EXACT_RANKS = 50


def pairs_against(scores: DataFrame, metric: str, block: str, baseline: str | None) -> DataFrame:
    """Differences of two models on the same block: all i < j, or all against a baseline.

    An equi-join on the block; the fan-out per block is the square of the model
    list, which is a fixed roster and not data.
    """
    scores = freeze(scores.select("model", block, metric))  # scored once, read by every test below
    a = scores.select(F.col("model").alias("model_a"), block, F.col(metric).alias("xa"))
    b = scores.select(F.col("model").alias("model_b"), block, F.col(metric).alias("xb"))
    if baseline is None:
        j = a.join(b, block).where(F.col("model_a") < F.col("model_b"))
    else:
        j = a.where(F.col("model_a") != baseline).join(b.where(F.col("model_b") == baseline), block)
    # sums arrive in any partition order: differences below 1e-10 are ties
    return j.withColumn("d", F.round(F.col("xa") - F.col("xb"), 10))


def paired_test(pairs: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """Wilcoxon signed-rank and paired t per model pair.

    Up to ``EXACT_RANKS`` blocks without ties and zero differences the rank sum
    has its exact distribution, else the tie-corrected normal one.
    """
    base = pairs.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"),
        F.avg((F.col("d") < 0).cast("double")).alias("win_rate"),
        F.stddev_samp("d").alias("sd"))
    med = exact_percentiles(pairs, PAIR, "d", {"median_diff": 0.5})
    nz = pairs.where("d <> 0").select(*PAIR, F.abs("d").alias("mag"), (F.col("d") > 0).cast("bigint").alias("pos"))
    ranked = value_ranks(nz, PAIR, "mag", F.sum("pos").alias("pos"))
    w = ranked.groupBy(*PAIR).agg(
        F.sum(F.col("avg_rank") * F.col("pos")).alias("w_plus"),
        F.sum(F.col("avg_rank") * (F.col("ties") - F.col("pos"))).alias("w_minus"),
        F.sum("ties").alias("m"),
        F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tie_term"))
    df = base.join(med, PAIR).join(w, PAIR, "left")
    z = "((w_plus - m*(m+1)/4.0) / sqrt(m*(m+1)*(2*m+1)/24.0 - tie_term/48.0))"
    t = "(mean_diff / (sd / sqrt(n)))"
    df = df.withColumn("z", F.expr(f"CASE WHEN m >= 1 THEN {z} END")).withColumn(
        "t_stat", F.expr(f"CASE WHEN n >= 2 AND sd > 0 THEN {t} END"))
    if alternative == "less":
        wp, exact, tp, stat = tails.normal_sf("(-z)"), tails.signed_rank_cdf("w_plus", "m"), tails.t_less("t_stat", "(n-1)"), "w_plus"
    else:
        stat = "least(w_plus, w_minus)"
        wp, exact, tp = tails.normal_two_sided("z"), f"least(1D, 2D * {tails.signed_rank_cdf(stat, 'm')})", tails.t_two_sided("t_stat", "(n-1)")
    small = f"m <= {EXACT_RANKS} AND m = n AND tie_term = 0"
    return df.select(
        *PAIR, "n", "median_diff", "mean_diff", "win_rate", F.expr(stat).alias("wilcoxon_stat"),
        F.expr(f"CASE WHEN z IS NULL THEN 1.0D WHEN {small} THEN {exact} ELSE {wp} END").alias("wilcoxon_p"), "t_stat",
        F.expr(f"CASE WHEN t_stat IS NULL THEN 1.0D ELSE {tp} END").alias("t_p"))


def holm(df: DataFrame, p: str, out: str) -> DataFrame:
    """Step-down adjustment over the family of models (one row per model)."""
    order = Window.orderBy(p)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    df = df.withColumn("_a", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return df.withColumn(out, F.max("_a").over(run)).drop("_a")


def benjamini_hochberg(df: DataFrame, p: str, out: str) -> DataFrame:
    """False-discovery adjustment over the family of pairs (one row per pair)."""
    m = F.count(F.lit(1)).over(Window.partitionBy())
    df = df.withColumn("_a", F.col(p) * m / F.row_number().over(Window.orderBy(p)))
    tail = Window.orderBy(F.col(p).desc(), F.col("_a").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.least(F.lit(1.0), F.min("_a").over(tail))).drop("_a")


def compare_to_baseline(scores: DataFrame, metric: str = "crps", baseline: str = "seasonal_naive",
                        alpha: float = 0.05) -> DataFrame:
    r = paired_test(pairs_against(scores, metric, "challenge_id", baseline), "less")
    r = holm(holm(r, "wilcoxon_p", "wilcoxon_p_holm"), "t_p", "t_p_holm")
    return r.withColumn("significant", F.col("wilcoxon_p_holm") < alpha)


def pairwise(scores: DataFrame, metric: str = "crps", block: str = "challenge_id") -> DataFrame:
    r = paired_test(pairs_against(scores, metric, block, None))
    return benjamini_hochberg(r, "wilcoxon_p", "p_bh").withColumn("better", F.signum("median_diff"))


def block_ranks(scores: DataFrame, metric: str) -> DataFrame:
    """Rank of every model inside each challenge, ties averaged (group = model roster).

    Scores that agree to nine decimals are tied: what lies below is rounding of sums.
    """
    scores = scores.withColumn("_score", F.round(metric, 9))
    lo = F.rank().over(Window.partitionBy("challenge_id").orderBy("_score"))
    same = F.count(F.lit(1)).over(Window.partitionBy("challenge_id", "_score"))
    return scores.select("model", "challenge_id", (lo + (same - 1) / 2).alias("block_rank"))


def friedman(scores: DataFrame, metric: str = "crps") -> DataFrame:
    per = block_ranks(scores, metric).groupBy("model").agg(
        F.sum("block_rank").alias("r"), F.count(F.lit(1)).alias("n"))
    one = per.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r")).alias("r2"))
    stat = "CASE WHEN n < 2 OR k < 2 THEN 0D ELSE 12.0D/(n*k*(k+1))*r2 - 3.0D*n*(k+1) END"
    one = one.select(F.expr(stat).alias("statistic"), (F.col("k") - 1).alias("df"))
    return one.withColumn("p_value", F.expr(tails.chi2_sf("statistic", "df")))
