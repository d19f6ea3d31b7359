"""Significance, gates, multi-draw and bootstrap queries over the score table."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark import dims
from tidemark.functions import tails
from tidemark.functions.hashing import uniform_sql
from tidemark.operators import scoring as S, significance as E
from tidemark.operators.bounded import exact_percentiles
from tidemark.plans.board import (METRICS, SCORE_SQL, metrics_sql, score_table, sel_metrics, sel_metrics_sql)
from tidemark.plans.views import R, rnd
from tidemark.registry import query
from tidemark.session import freeze


def paired_sql(frm: str, alternative: str, blk: str = "challenge_id") -> str:
    """CTEs mk/res over a relation ``frm(model_a, model_b, <block>, xa, xb)``."""
    less = alternative == "less"
    stat = "w_plus" if less else "least(w_plus, w_minus)"
    wp = tails.normal_sf("(-z)") if less else tails.normal_two_sided("z")
    # the exact rank sum by inversion of its characteristic function, Student's t by its finite series: not the forms of the operator
    half, turns = "m*(m+1)/2", "range(0, (m*(m+1)/2)::BIGINT + 1)"
    mass = f"list_sum(list_transform({turns}, lambda j: list_product(list_transform(range(1, m::BIGINT + 1), lambda k: cos(pi()*j*k/({half} + 1))))*cos(pi()*j*({half} - 2*s)/({half} + 1))))/({half} + 1)"
    cdf = f"list_sum(list_transform(range(0, {stat}::BIGINT + 1), lambda s: {mass}))"
    exact = cdf if less else f"least(1.0, 2*{cdf})"
    even = "sin(th)*list_sum(list_transform(range(0, (v//2)::BIGINT), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0))/sqrt(pi())*pow(cos(th), 2*j)))"
    odd = "2/pi()*(th + CASE WHEN v = 1 THEN 0 ELSE sin(th)*list_sum(list_transform(range(0, ((v-1)//2)::BIGINT), lambda j: sqrt(pi())/2*exp(lgamma(j + 1.0) - lgamma(j + 1.5))*pow(cos(th), 2*j+1))) END)"
    tp = "(1 + sign(t_stat)*inner_p)/2" if less else "1 - inner_p"
    return f"""
dd AS (SELECT *, round(xa-xb, 10) d FROM {frm}),
rk AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) +
   (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1)/2.0 ar,
   count(*) OVER (PARTITION BY model_a, model_b, abs(d)) t FROM dd WHERE d <> 0),
ws AS (SELECT model_a, model_b, sum(CASE WHEN d>0 THEN ar ELSE 0 END)::DOUBLE w_plus,
   sum(CASE WHEN d<0 THEN ar ELSE 0 END)::DOUBLE w_minus, count(*)::DOUBLE m, sum(t*t-1)::DOUBLE tie_term FROM rk GROUP BY 1,2),
bs AS (SELECT model_a, model_b, count(*) n, avg(d) mean_diff, median(d) median_diff,
   avg(CASE WHEN d<0 THEN 1.0 ELSE 0 END) win_rate, stddev_samp(d) sd FROM dd GROUP BY 1,2),
z0 AS (SELECT *, CASE WHEN m>=1 THEN (w_plus - m*(m+1)/4.0)/sqrt(m*(m+1)*(2*m+1)/24.0 - tie_term/48.0) END z,
   CASE WHEN n>=2 AND sd>0 THEN mean_diff/(sd/sqrt(n)) END t_stat FROM bs LEFT JOIN ws USING (model_a, model_b)),
z1 AS (SELECT *, CASE WHEN v % 2 = 0 THEN {even} ELSE {odd} END inner_p FROM (SELECT *, n - 1 v, atan(abs(t_stat)/sqrt(n - 1)) th FROM z0)),
ex AS (SELECT model_a, model_b, {exact} exact_p FROM z0 WHERE m <= 50 AND m = n AND tie_term = 0),
res AS (SELECT model_a, model_b, n, median_diff, mean_diff, win_rate, {stat} wilcoxon_stat,
   CASE WHEN z IS NULL THEN 1.0 WHEN exact_p IS NOT NULL THEN exact_p ELSE {wp} END wilcoxon_p, t_stat, CASE WHEN t_stat IS NULL THEN 1.0 ELSE {tp} END t_p FROM z1 LEFT JOIN ex USING (model_a, model_b))
"""


_RES = ["median_diff", "mean_diff", "win_rate", "wilcoxon_stat", "wilcoxon_p", "t_stat", "t_p"]


def _sel(df, *extra):
    return df.select("model_a", "model_b", F.col("n").cast("bigint").alias("n"),
                     *[rnd(F.col(c)).alias(c) for c in _RES if c in df.columns], *extra)


def _sel_sql():
    return "model_a, model_b, CAST(n AS BIGINT) n, " + ", ".join(f"{R(c)} AS {c}" for c in _RES)


_PAIRS = ("SELECT a.model model_a, b.model model_b, a.challenge_id, a.crps xa, b.crps xb FROM sc a JOIN sc b "
          "ON a.challenge_id=b.challenge_id AND a.model < b.model")
_BASE = ("SELECT a.model model_a, b.model model_b, a.challenge_id, a.crps xa, b.crps xb FROM sc a JOIN sc b "
         "ON a.challenge_id=b.challenge_id AND a.model <> 'seasonal_naive' AND b.model = 'seasonal_naive'")


@query("paired_vs_baseline", "E6 E7 J3", f"""WITH {SCORE_SQL}, pr AS ({_BASE}), {paired_sql('pr', 'less')},
hm AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY wilcoxon_p) + 1)*wilcoxon_p) a1,
  least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY t_p) + 1)*t_p) a2 FROM res),
hh AS (SELECT *, max(a1) OVER (ORDER BY wilcoxon_p ROWS UNBOUNDED PRECEDING) wh, max(a2) OVER (ORDER BY t_p ROWS UNBOUNDED PRECEDING) th FROM hm)
SELECT {_sel_sql()}, {R('wh')} AS wilcoxon_p_holm, {R('th')} AS t_p_holm, wh < 0.05 AS significant FROM hh""")
def paired_vs_baseline(spark, sf):
    r = E.compare_to_baseline(score_table(spark, sf))
    return _sel(r, rnd(F.col("wilcoxon_p_holm")).alias("wilcoxon_p_holm"),
                rnd(F.col("t_p_holm")).alias("t_p_holm"), "significant")


@query("pairwise_significance", "E8 J5", f"""WITH {SCORE_SQL}, pr AS ({_PAIRS}), {paired_sql('pr', 'two')},
bh AS (SELECT *, wilcoxon_p*count(*) OVER ()/row_number() OVER (ORDER BY wilcoxon_p) a FROM res),
bb AS (SELECT *, least(1.0, min(a) OVER (ORDER BY wilcoxon_p DESC, a DESC ROWS UNBOUNDED PRECEDING)) p FROM bh)
SELECT {_sel_sql()}, {R('p')} AS p_bh, CAST(sign(median_diff) AS DOUBLE) AS better FROM bb""")
def pairwise_significance(spark, sf):
    r = E.pairwise(score_table(spark, sf))
    return _sel(r, rnd(F.col("p_bh")).alias("p_bh"), F.col("better"))


_SRC_REL = """
ps AS (SELECT model, source_id, sum(weight*mase)/sum(weight) mase FROM sc GROUP BY 1,2),
rr AS (SELECT a.model, a.source_id, a.mase/greatest(b.mase,1e-8) v FROM ps a JOIN ps b ON a.source_id=b.source_id AND b.model='seasonal_naive'),
pr AS (SELECT a.model model_a, b.model model_b, a.source_id, a.v xa, b.v xb FROM rr a JOIN rr b ON a.source_id=b.source_id AND a.model<b.model)
"""


@query("source_level_significance", "E11 J4 G5", f"WITH {SCORE_SQL}, {_SRC_REL}, {paired_sql('pr', 'two')} SELECT {_sel_sql()} FROM res")
def source_level_significance(spark, sf):
    rel = S.relative_to(S.per_source(score_table(spark, sf)))
    return _sel(E.paired_test(E.pairs_against(rel, "mase_ratio", "source_id", None)))


@query("friedman_omnibus", "E5 W8 F24", f"""WITH {SCORE_SQL},
br AS (SELECT model, rank() OVER (PARTITION BY challenge_id ORDER BY round(crps, 9)) + (count(*) OVER (PARTITION BY challenge_id, round(crps, 9))-1)/2.0 r FROM sc),
ag AS (SELECT model, sum(r) r, count(*) n FROM br GROUP BY 1),
o AS (SELECT max(n)::DOUBLE n, count(*)::DOUBLE k, sum(r*r)::DOUBLE r2 FROM ag),
s AS (SELECT 12.0/(n*k*(k+1))*r2 - 3.0*n*(k+1) statistic, k-1 df FROM o)
SELECT {R('statistic', 4)} statistic, CAST(df AS BIGINT) df, {R(tails.chi2_sf('statistic', 'df'), 9)} p_value FROM s""")
def friedman_omnibus(spark, sf):
    f = E.friedman(score_table(spark, sf))
    return f.select(rnd(F.col("statistic"), 4).alias("statistic"), F.col("df").cast("bigint").alias("df"),
                    rnd(F.col("p_value"), 9).alias("p_value"))


@query("clustering_note", "E9", f"""WITH {SCORE_SQL} SELECT model, count(*) n_challenges, count(DISTINCT source_id) n_sources,
{R('count(*)::DOUBLE/count(DISTINCT source_id)')} per_source, count(DISTINCT source_id) < 12 low_breadth FROM sc GROUP BY 1""")
def clustering_note(spark, sf):
    s = score_table(spark, sf)
    per = s.groupBy("model", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("model").agg(F.sum("n").alias("n_challenges"), F.count(F.lit(1)).alias("n_sources")).select(
        "*", rnd(F.col("n_challenges") / F.col("n_sources")).alias("per_source"), (F.col("n_sources") < 12).alias("low_breadth"))


@query("metrics_by_model", "G3 G4 F22 F23 V4", f"WITH {SCORE_SQL}, m AS ({metrics_sql('model')}) SELECT {sel_metrics_sql('model')} FROM m")
def metrics_by_model(spark, sf):
    return sel_metrics(S.metrics_by(score_table(spark, sf), "model"), "model")


_PC = ["mae", "mase", "smae", "wis", "crps", "cover80", "weight", "wql_num", "abs_truth"]


@query("challenge_scores", "G3 F22 F23 W7 F10", f"WITH {SCORE_SQL} SELECT model, challenge_id, " + ", ".join(f"{R(c)} AS {c}" for c in _PC) + " FROM sc")
def challenge_scores(spark, sf):
    return score_table(spark, sf).select("model", "challenge_id", *[rnd(F.col(c)).alias(c) for c in _PC])


@query("multi_draw_spread", "G9 C5", f"""WITH {SCORE_SQL}, m AS ({metrics_sql('model, draw')}),
l AS (UNPIVOT m ON mase, wql, crps, wis, pce, coverage_80, mae, unseen_frac INTO NAME metric VALUE v)
SELECT model, metric, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, CAST(count(*) AS BIGINT) AS draws FROM l GROUP BY 1,2""")
def multi_draw_spread(spark, sf):
    m = S.metrics_by(score_table(spark, sf), "model", "draw")
    long = m.unpivot(["model", "draw"], METRICS, "metric", "v")
    return long.groupBy("model", "metric").agg(rnd(F.avg("v")).alias("mean"), rnd(F.stddev_pop("v")).alias("std"),
                                               F.count(F.lit(1)).alias("draws"))


@query("multi_dataset_board", "G8", f"""WITH {SCORE_SQL}, m AS ({metrics_sql('"domain", model')}),
b AS (SELECT m.*, row_number() OVER (PARTITION BY m."domain" ORDER BY round(m.mase,9), m.model) rk,
  m.mase/(CASE WHEN abs(n.mase)>1e-8 THEN n.mase ELSE 1e-8 END) ratio FROM m JOIN m n ON m."domain"=n."domain" AND n.model='seasonal_naive')
SELECT model, {R('exp(avg(ln(greatest(ratio,0)+1e-5)))-1e-5')} mase_norm_gmean, {R('avg(rk)')} avg_rank, count(*) n_datasets FROM b GROUP BY 1""")
def multi_dataset_board(spark, sf):
    m = S.metrics_by(score_table(spark, sf), "domain", "model")
    w = Window.partitionBy("domain")
    base = F.max(F.when(F.col("model") == "seasonal_naive", F.col("mase"))).over(w)
    m = m.select("model", F.row_number().over(w.orderBy(F.round("mase", 9), "model")).alias("rk"),
                 (F.col("mase") / F.when(F.abs(base) > dims.EPS, base).otherwise(dims.EPS)).alias("ratio"))
    return m.groupBy("model").agg(rnd(S.shifted_gmean(F.col("ratio"), F.lit(1.0))).alias("mase_norm_gmean"),
                                  rnd(F.avg("rk")).alias("avg_rank"), F.count(F.lit(1)).alias("n_datasets"))


@query("cadence_medians", "G30", f"""WITH {SCORE_SQL} SELECT model, cadence, {R('median(mase)')} median_mase, count(*) n FROM sc GROUP BY 1,2""")
def cadence_medians(spark, sf):
    s = freeze(score_table(spark, sf).select("model", "cadence", "mase"))  # scored once for both aggregates
    n = s.groupBy("model", "cadence").agg(F.count(F.lit(1)).alias("n"))
    return exact_percentiles(s, ["model", "cadence"], "mase", {"median_mase": 0.5}).withColumn(
        "median_mase", rnd(F.col("median_mase"))).join(n, ["model", "cadence"])


N_BOOT = 200
_BOOT_SEED = "boot-v1"
_BOOT_METRICS = ("mase", "wql", "crps")


@query("pooled_bootstrap", "G10", f"""WITH {SCORE_SQL},
nu AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY challenge_id)-1 i, count(*) OVER (PARTITION BY model) n FROM sc),
bo AS (SELECT model, i slot, n, unnest(range({N_BOOT})) boot FROM nu),
pk AS (SELECT model, boot, CAST(floor({uniform_sql(_BOOT_SEED, 'boot', 'slot')}*n) AS BIGINT) i FROM bo),
bs AS (SELECT pk.model, boot, sum(weight*mase)/sum(weight) mase, sum(weight*wql_num)/(9*sum(weight*abs_truth)) wql,
  sum(weight*crps)/sum(weight) crps FROM pk JOIN nu USING (model, i) GROUP BY 1,2),
l AS (UNPIVOT bs ON mase, wql, crps INTO NAME metric VALUE v)
SELECT model, metric, {R('quantile_cont(v,0.025)')} lo95, {R('quantile_cont(v,0.975)')} hi95, {R('stddev_pop(v)')} boot_std, count(*) n_boot FROM l GROUP BY 1,2""")
def pooled_bootstrap(spark, sf):
    """Resample stored contributions: each of ``N_BOOT`` samples draws as many rows by hash as there are, with replacement."""
    s = score_table(spark, sf).select(
        "model", "challenge_id", "weight", (F.col("weight") * F.col("mase")).alias("mase_w"),
        (F.col("weight") * F.col("wql_num")).alias("wql_w"), (F.col("weight") * F.col("abs_truth")).alias("abs_w"), (F.col("weight") * F.col("crps")).alias("crps_w"))
    t = S.bootstrap_totals(s, "model", "challenge_id", ["weight", "mase_w", "wql_w", "abs_w", "crps_w"], _BOOT_SEED, N_BOOT)
    b = t.select("model", "boot", (F.col("mase_w") / F.col("weight")).alias("mase"), (F.col("wql_w") / (9 * F.col("abs_w"))).alias("wql"), (F.col("crps_w") / F.col("weight")).alias("crps"))
    long = b.unpivot(["model", "boot"], list(_BOOT_METRICS), "metric", "v")
    # N_BOOT rows per group: a parameter, so the built-in percentile is bounded
    return long.groupBy("model", "metric").agg(
        rnd(F.percentile("v", F.lit(0.025))).alias("lo95"), rnd(F.percentile("v", F.lit(0.975))).alias("hi95"),
        rnd(F.stddev_pop("v")).alias("boot_std"), F.count(F.lit(1)).alias("n_boot"))
