"""Benchmark queries: challenges, forecasts, scores, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import dims
from tidemark.operators import challenges as C, forecast as M, scoring as S
from tidemark.plans.views import BINS_SQL, R, rnd, series_bins
from tidemark.registry import query

CUTOFF = "2001-07-25"


def challenge_table(spark: SparkSession, sf: str) -> DataFrame:
    return C.cut_challenges(series_bins(spark, sf), CUTOFF)


def score_table(spark: SparkSession, sf: str, models=M.COLUMN_MODELS) -> DataFrame:
    return S.contributions(M.gaussian_band(M.column_forecasts(challenge_table(spark, sf), models)))


# ---------------------------------------------------------------- DuckDB twins
_CTX = dims.sql_case("cadence", {k: v[0] for k, v in dims.PROFILES.items()}, "256")
_HOR = dims.sql_case("cadence", {k: v[1] for k, v in dims.PROFILES.items()}, "48")
CH_SQL = BINS_SQL + f""",
num AS (SELECT *, {_CTX} ctx, {_HOR} horizon,
  row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) rn FROM bins),
ser AS (SELECT source_id, series_key, "domain", dgp_class, cadence, freq, ctx, horizon,
  list("value" ORDER BY ts) vals, list(ts ORDER BY ts) tss, count(*) npts
  FROM num WHERE rn <= ctx + horizon*{dims.K_DRAWS} GROUP BY ALL),
dr AS (SELECT ser.*, d.draw, npts - d.draw*horizon n_end
  FROM ser, (SELECT unnest(range({dims.K_DRAWS})) draw) d),
dr2 AS (SELECT *, least(ctx, n_end - horizon) context_len FROM dr
  WHERE n_end >= least(ctx + horizon, {dims.MIN_MOTIF_LENGTH})),
dr3 AS (SELECT *, vals[n_end-context_len-horizon+1 : n_end] w, tss[n_end-horizon+1 : n_end] tts
  FROM dr2 WHERE context_len >= 2),
dr4 AS (SELECT *, list_avg(w[1:context_len]) mu0, list_stddev_pop(w[1:context_len]) sd0,
  list_stddev_pop(w) sdw FROM dr3),
ch AS MATERIALIZED (SELECT concat(series_key, '#', draw) challenge_id, draw, source_id, series_key, "domain", dgp_class,
  cadence, freq, context_len, horizon,
  len(list_filter(tts, lambda t: t >= TIMESTAMP '{CUTOFF}'))::DOUBLE / horizon unseen_frac,
  list_transform(w[1:context_len], lambda v: (v-mu0)/(CASE WHEN sd0 >= 1e-8 THEN sd0 WHEN sdw <> 0 THEN sdw ELSE 1 END)) context,
  list_transform(w[context_len+1:], lambda v: (v-mu0)/(CASE WHEN sd0 >= 1e-8 THEN sd0 WHEN sdw <> 0 THEN sdw ELSE 1 END)) truth
  FROM dr4)
"""
_M = dims.sql_case("freq", dims.FREQ_SEASON, "1")
STATS_SQL = CH_SQL + f""",
st0 AS (SELECT *, len(context) n, list_avg(context) mu, {_M} m0 FROM ch),
st1 AS (SELECT *, list_transform(context, lambda v: v - mu) x,
  CASE WHEN m0 > 1 AND m0 < n THEN m0 ELSE 1 END season FROM st0),
st2 AS (SELECT *, list_sum(list_transform(x, lambda v: v*v)) denom,
  list_avg(list_transform(range(1, n), lambda i: abs(context[i+1]-context[i]))) step1,
  list_avg(list_transform(range(1, n - season + 1), lambda i: abs(context[i+season]-context[i]))) stepm,
  list_sum(list_transform(range(1, n), lambda i: x[i]*x[i+1])) lag1 FROM st1),
cand AS (SELECT challenge_id, p, ord, list_sum(list_transform(range(1, n-p+1), lambda i: x[i]*x[i+p]))/denom r FROM (
  SELECT challenge_id, x, n, denom, unnest([12,24,36]) p, unnest([1,2,3]) ord FROM st2
  UNION ALL SELECT challenge_id, x, n, denom, m0, 4 FROM st2 WHERE m0 > 1 AND m0 < n AND m0 NOT IN (12,24,36)) c
  WHERE p >= 2 AND p < n AND denom > 1e-8),
best AS (SELECT challenge_id, p FROM cand WHERE r > 0.2
  QUALIFY row_number() OVER (PARTITION BY challenge_id ORDER BY r DESC, ord) = 1),
st AS MATERIALIZED (SELECT st2.*, coalesce(best.p, 0) period, sqrt(denom/n) sd,
  CASE WHEN step1 > 1e-8 THEN step1 ELSE sqrt(denom/n) + 1e-8 END sigma0,
  CASE WHEN stepm > 1e-8 THEN stepm ELSE sqrt(denom/n) + 1e-8 END "scale",
  CASE WHEN denom - x[n]*x[n] <= 1e-8 THEN 0 ELSE greatest(-0.99, least(0.99, lag1/(denom - x[n]*x[n]))) END phi
  FROM st2 LEFT JOIN best USING (challenge_id))
"""
FC_SQL = STATS_SQL + """,
hs AS (SELECT st.*, unnest(range(1, horizon+1)) h FROM st),
fc AS MATERIALIZED (SELECT model, challenge_id, draw, source_id, series_key, "domain", dgp_class, cadence, horizon, unseen_frac,
  sigma0, "scale", h, truth[h] y, point FROM (
  SELECT *, 'seasonal_naive' model, CASE WHEN period < 2 THEN context[n] ELSE context[n-period+((h-1)%period)+1] END point FROM hs
  UNION ALL SELECT *, 'drift', context[n] + (context[n]-context[1])/greatest(n-1,1)*h FROM hs
  UNION ALL SELECT *, 'ewma', list_reduce(context, lambda a, v: 0.7::DOUBLE*a+0.3::DOUBLE*v) FROM hs
  UNION ALL SELECT *, 'ar1', mu + x[n]*pow(phi, h) FROM hs
  UNION ALL SELECT *, 'naive', context[n] FROM hs
  UNION ALL SELECT *, 'damped', context[n] + (context[n]-context[n-least(12,n-1)])/least(12,n-1)
      * (0.9::DOUBLE*(1-pow(0.9::DOUBLE,h))/(1-0.9::DOUBLE)) FROM hs))
"""
_Z = list(M.PROBIT.values())
_QV = {lv: f"(point + ({z}::DOUBLE)*sigma0*sqrt(h))" for lv, z in M.PROBIT.items()}


def _pin(lv: float, pred: str) -> str:
    return f"greatest({lv}::DOUBLE*(y-{pred}), ({lv}::DOUBLE-1)*(y-{pred}))"


def _dense_sql(lv: float) -> str:
    g = dims.DECILES
    if lv <= g[0]:
        return "q1"
    if lv >= g[-1]:
        return "q9"
    i = max(k for k, x in enumerate(g) if x <= lv + 1e-12)
    w = (lv - g[i]) / (g[i + 1] - g[i])
    return f"q{i+1}" if abs(w) < 1e-9 else f"(q{i+1}+(q{i+2}-q{i+1})*{w}::DOUBLE)"


def _is_sql(lo: int, hi: int, a: float) -> str:
    return (f"({a}/2.0::DOUBLE)*((q{hi}-q{lo}) + (2.0/{a}::DOUBLE)*(greatest(q{lo}-y,0)+greatest(y-q{hi},0)))")


SCORE_SQL = FC_SQL + f""",
fq AS (SELECT *, {', '.join(f'{_QV[lv]} q{i+1}' for i, lv in enumerate(dims.DECILES))} FROM fc),
sc AS MATERIALIZED (SELECT model, challenge_id, draw, source_id, series_key, "domain", dgp_class, cadence, horizon, unseen_frac,
  0.25 + 0.75*unseen_frac weight, avg(abs(y-point)) mae, avg(abs(y-point))/any_value("scale") mase,
  avg(abs(y-point))/any_value(sigma0) smae,
  sum(abs(y)) abs_truth, 2*sum({'+'.join(_pin(lv, f'q{i+1}') for i, lv in enumerate(dims.DECILES))}) wql_num,
  avg((0.5*abs(y-q5) + {_is_sql(1,9,0.2)} + {_is_sql(2,8,0.4)} + {_is_sql(3,7,0.6)} + {_is_sql(4,6,0.8)})/4.5) wis,
  2*avg(({'+'.join(_pin(lv, _dense_sql(lv)) for lv in dims.CRPS_LEVELS)})/19.0) crps,
  avg(CAST(y BETWEEN q1 AND q9 AS INT)) cover80,
  {', '.join(f'sum(CAST(y <= q{i} AS INT)) hit_{i}' for i in range(1, 10))}
  FROM fq GROUP BY model, challenge_id, draw, source_id, series_key, "domain", dgp_class, cadence, horizon, unseen_frac)
"""


def metrics_sql(keys: str, frm: str = "sc") -> str:
    pce = "+".join(f"abs(sum(weight*hit_{i+1})/sum(weight*horizon)-{lv})" for i, lv in enumerate(dims.DECILES))
    return (f"SELECT {keys}, sum(weight*mase)/sum(weight) mase, sum(weight*wql_num)/(9*sum(weight*abs_truth)) wql, "
            f"sum(weight*crps)/sum(weight) crps, sum(weight*wis)/sum(weight) wis, ({pce})/9 pce, "
            f"sum(weight*cover80)/sum(weight) coverage_80, sum(weight*mae)/sum(weight) mae, count(*) n, "
            f"avg(unseen_frac) unseen_frac FROM {frm} GROUP BY {keys}")


REL_SQL = """
ps AS (SELECT model, source_id, sum(weight*mase)/sum(weight) mase, sum(weight*crps)/sum(weight) crps,
  sum(weight) weight, count(*) n FROM sc GROUP BY 1,2),
rel AS (SELECT a.model, a.source_id, a.weight, a.n, a.mase/greatest(b.mase,1e-8) mase_ratio,
  a.crps/greatest(b.crps,1e-8) crps_ratio FROM ps a JOIN ps b ON a.source_id=b.source_id AND b.model='seasonal_naive'),
gm AS (SELECT model, exp(sum(weight*ln(greatest(mase_ratio,0)+1e-5))/sum(weight))-1e-5 mase_rel,
  exp(sum(weight*ln(greatest(crps_ratio,0)+1e-5))/sum(weight))-1e-5 crps_rel FROM rel GROUP BY 1)
"""
METRICS = ["mase", "wql", "crps", "wis", "pce", "coverage_80", "mae", "unseen_frac"]


def sel_metrics(df: DataFrame, *keys: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keys, *[rnd(F.col(m)).alias(m) for m in METRICS], F.col("n").cast("bigint").alias("n"),
                     *[rnd(F.col(e)).alias(e) for e in extra])


def sel_metrics_sql(keys: str, extra: tuple[str, ...] = ()) -> str:
    cols = [f"{R(m)} AS {m}" for m in METRICS + list(extra)]
    return f"{keys}, {', '.join(cols)}, CAST(n AS BIGINT) AS n"


# ---------------------------------------------------------------- queries
@query("leaderboard", "G7 G4 G5 G6 J4 M1 M2 M3 M4 M5 M10 C2 B15", f"WITH {SCORE_SQL}, {REL_SQL}, met AS ({metrics_sql('model')}) "
       f"SELECT {sel_metrics_sql('model', ('mase_rel', 'crps_rel'))}, CAST(row_number() OVER (ORDER BY round(mase_rel,9), model) AS BIGINT) \"rank\" "
       "FROM met JOIN gm USING (model)")
def leaderboard(spark, sf):
    b = S.leaderboard(score_table(spark, sf))
    return sel_metrics(b.withColumn("rank", F.col("rank").cast("bigint")), "model", "rank", extra=("mase_rel", "crps_rel"))


@query("challenge_cut", "C2 B15 F27 C5", f"WITH {CH_SQL} SELECT challenge_id, draw::BIGINT draw, cadence, context_len::BIGINT context_len, "
       f"horizon::BIGINT horizon, {R('unseen_frac')} unseen_frac, {R('abs(list_sum(context))', 4)} ctx_sum, "
       f"{R('list_avg(truth)')} truth_mean, {R('list_max(context)')} ctx_max, {R('truth[horizon]')} truth_last FROM ch")
def challenge_cut(spark, sf):
    from tidemark.functions import arrays as A
    c = challenge_table(spark, sf)
    return c.select("challenge_id", F.col("draw").cast("bigint"), "cadence", F.col("context_len").cast("bigint"),
                    F.col("horizon").cast("bigint"), rnd(F.col("unseen_frac")).alias("unseen_frac"),
                    rnd(F.abs(F.expr(A.total("context"))), 4).alias("ctx_sum"), rnd(F.expr(A.mean("truth"))).alias("truth_mean"),
                    rnd(F.array_max("context")).alias("ctx_max"), rnd(F.expr(A.last("truth"))).alias("truth_last"))
