"""Feature-space and trajectory queries over the derived series and the embeddings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import arrays as A
from tidemark.operators import forecast as M, novelty as N, series as Q, trajectory as X
from tidemark.operators.bounded import exact_percentiles
from tidemark.plans.board import CH_SQL, challenge_table
from tidemark.plans.views import BINS_SQL, R, load, rnd, series_bins
from tidemark.registry import query
from tidemark.session import freeze

_LAGSQL = "list_sum(list_transform(range(1, len(z)-p+1), lambda i: z[i]*z[i+p]))/list_sum(list_transform(z, lambda v: v*v))"
# truth = each series; generated = the series one bin later, pulled towards its mean
_EMB = BINS_SQL + """, s0 AS (SELECT series_key, list("value" ORDER BY ts) v FROM bins GROUP BY 1),
s1 AS (SELECT series_key, 't' k, v FROM s0 UNION ALL SELECT series_key, 'g', list_transform(v[2:], lambda x: 0.9*x*x/1000.0) FROM s0),
s2 AS (SELECT series_key, k, list_transform(v, lambda x: (x - list_avg(v))/list_stddev_pop(v)) z FROM s1),
lg AS (SELECT series_key, k, z, unnest(range(1, 50)) p FROM s2), ac AS (SELECT series_key, k, p FROM lg WHERE """ + _LAGSQL + """ < exp(-1.0)),
ta AS (SELECT s2.series_key, s2.k, z, coalesce(min(p), 1) tau FROM s2 LEFT JOIN ac ON ac.series_key = s2.series_key AND ac.k = s2.k GROUP BY ALL),
em AS (SELECT series_key, k, tau, z[i] x0, z[i+tau] x1, z[i+2*tau] x2 FROM (SELECT *, unnest(range(1, len(z)-2*tau+1)) i FROM ta))"""


def _generated(spark, sf):
    b = freeze(series_bins(spark, sf).select("series_key", "ts", "value"))
    w = Window.partitionBy("series_key").orderBy("ts")
    g = b.withColumn("value", 0.9 * F.col("value") * F.col("value") / 1000.0).withColumn("_r", F.row_number().over(w)).where("_r > 1").drop("_r")
    return b, g


def _embedded(df):
    tau = Q.embedding_delay(df, ["series_key"], "ts", "value")
    return Q.embed_points(df, ["series_key"], "ts", "value", tau)


@query("delay_embedding", "W11", f"WITH {_EMB} SELECT series_key, tau::BIGINT tau, count(*) n_points, {R('avg(x0*x1)')} c01, {R('avg(x0*x2)')} c02 FROM em WHERE k = 't' GROUP BY 1,2")
def delay_embedding(spark, sf):
    e = _embedded(_generated(spark, sf)[0])
    return e.groupBy("series_key", F.col("tau").cast("bigint").alias("tau")).agg(
        F.count(F.lit(1)).alias("n_points"), rnd(F.avg(F.col("x0") * F.col("x1"))).alias("c01"), rnd(F.avg(F.col("x0") * F.col("x2"))).alias("c02"))


_RNG = ", ".join(f"min(x{i}) lo{i}, max(x{i}) hi{i}" for i in range(3))
_BIN = ", ".join(f"least(floor((x{i} - (lo{i}-0.05*(hi{i}-lo{i})))/(1.1*(hi{i}-lo{i}))*20), 19) b{i}" for i in range(3))
_IN = " AND ".join(f"x{i} BETWEEN lo{i}-0.05*(hi{i}-lo{i}) AND hi{i}+0.05*(hi{i}-lo{i})" for i in range(3))


@query("state_divergence", "X4", f"""WITH {_EMB}, r AS (SELECT series_key, {_RNG} FROM em WHERE k = 't' GROUP BY 1), b AS (SELECT series_key, k, {_BIN} FROM em JOIN r USING (series_key) WHERE {_IN}),
c AS (SELECT series_key, b0, b1, b2, count(CASE WHEN k='t' THEN 1 END) nt, count(CASE WHEN k='g' THEN 1 END) ng FROM b GROUP BY 1,2,3,4), t AS (SELECT series_key, sum(nt) t, sum(ng) g, count(*) n FROM c GROUP BY 1),
p AS (SELECT series_key, (nt+1e-6)/(t+8000*1e-6) pt, (ng+1e-6)/(g+8000*1e-6) pg, t, g, n FROM c JOIN t USING (series_key))
SELECT series_key, {R('sum(pt*ln(pt/pg)) + any_value((8000-n)*(1e-6/(t+8000*1e-6))*ln((g+8000*1e-6)/(t+8000*1e-6)))', 5)} d_stsp FROM p GROUP BY 1""")
def state_divergence(spark, sf):
    t, g = _generated(spark, sf)
    d = X.state_divergence(freeze(_embedded(t)), freeze(_embedded(g)), ["series_key"])
    return d.withColumn("d_stsp", rnd(F.col("d_stsp"), 5))


@query("prediction_time", "X7", f"""WITH {CH_SQL}, e AS (SELECT challenge_id, truth, context[len(context)] p, list_stddev_pop(truth) s, unnest(range(1, horizon+1)) h, horizon FROM ch)
SELECT challenge_id, CAST(coalesce(min(CASE WHEN abs(p - truth[h])/(CASE WHEN s > 0 THEN s ELSE 1 END) > 0.4 THEN h - 1 END), any_value(horizon)) AS DOUBLE) vpt FROM e GROUP BY 1""")
def prediction_time(spark, sf):
    c = challenge_table(spark, sf).select("challenge_id", F.expr(A.last("context")).alias("pred"), F.posexplode("truth").alias("step", "truth"))
    return X.prediction_time(c, ["challenge_id"])


@query("spectrum_dimension", "W12", f"""WITH m AS (SELECT "label", i, avg(embedding[i]::DOUBLE)*10 - 0.05 l FROM (SELECT "label", embedding, unnest(range(1, 65)) i FROM embeddings) GROUP BY 1,2),
s AS (SELECT "label", sum(l) OVER w c, row_number() OVER w j, lead(l) OVER w nx FROM m WINDOW w AS (PARTITION BY "label" ORDER BY l DESC, i)), b AS (SELECT "label", j, c, nx FROM s WHERE c >= 0 QUALIFY row_number() OVER (PARTITION BY "label" ORDER BY j DESC) = 1)
SELECT "label", {R('CASE WHEN j IS NULL THEN 0 WHEN nx IS NULL THEN j ELSE j + c/abs(nx) END', 5)} dimension FROM (SELECT DISTINCT "label" FROM embeddings) LEFT JOIN b USING ("label")""")
def spectrum_dimension(spark, sf):
    e = load(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("idx", "v"))
    s = e.groupBy("label", "idx").agg((F.avg(F.col("v").cast("double")) * 10 - 0.05).alias("l"))
    return X.kaplan_yorke(s, ["label"], "l").withColumn("dimension", rnd(F.col("dimension"), 5))


@query("cloud_spread", "X3", f"""WITH p AS (SELECT "label", i, avg(embedding[i]::DOUBLE) c, var_samp(embedding[i]::DOUBLE) v, count(*) n FROM (SELECT "label", embedding, unnest(range(1, 65)) i FROM embeddings) GROUP BY 1,2)
SELECT a."label", max(a.n) n, {R('sum(a.v)')} spread, {R('sqrt(sum((a.c-b.c)*(a.c-b.c)))')} centroid_distance FROM p a JOIN p b ON a.i = b.i AND b."label" = 0 GROUP BY 1""")
def cloud_spread(spark, sf):
    e = load(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    c = X.cloud_spread(e, "label", "i", "v", 0)
    return c.select("label", "n", rnd(F.col("spread")).alias("spread"), rnd(F.col("centroid_distance")).alias("centroid_distance"))


# two components by the power method: the covariance times a vector, again and again, then with the first component taken out
_PCA = """v AS MATERIALIZED (SELECT vec_id, "label", list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings), mu AS (SELECT i, avg(e[i]) m, count(*) n FROM (SELECT e, unnest(range(1, 65)) i FROM v) GROUP BY 1),
ml AS (SELECT list(m ORDER BY i) m, any_value(n) n FROM mu), c0 AS MATERIALIZED (SELECT vec_id, "label", list_transform(range(1, 65), lambda i: e[i] - m[i]) e FROM v, ml),
cx AS (SELECT vec_id, i, e[i] x FROM (SELECT vec_id, e, unnest(range(1, 65)) i FROM c0)), cv AS (SELECT a.i, b.i j, sum(a.x*b.x)/(SELECT n FROM ml) s FROM cx a JOIN cx b USING (vec_id) GROUP BY 1, 2),
cm AS MATERIALIZED (SELECT list(r ORDER BY i) c FROM (SELECT i, list(s ORDER BY j) r FROM cv GROUP BY 1)),
p1 AS (SELECT 0 k, list_transform(range(1, 65), lambda i: 1.0 + i/100.0) w UNION ALL SELECT k+1, list_transform(u, lambda q: q/sqrt(list_sum(list_transform(u, lambda z: z*z)))) FROM (SELECT k, list_transform(c, lambda r: list_dot_product(r, w)) u FROM p1, cm) WHERE k < 3000),
w1 AS MATERIALIZED (SELECT w FROM p1 WHERE k = 3000), d1 AS MATERIALIZED (SELECT list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - l*w[i]*w[j])) c FROM (SELECT c, w, list_dot_product(w, list_transform(c, lambda r: list_dot_product(r, w))) l FROM cm, w1)),
p2 AS (SELECT 0 k, list_transform(range(1, 65), lambda i: 1.0 - i/90.0) w UNION ALL SELECT k+1, list_transform(u, lambda q: q/sqrt(list_sum(list_transform(u, lambda z: z*z)))) FROM (SELECT k, list_transform(c, lambda r: list_dot_product(r, w)) u FROM p2, d1) WHERE k < 3000),
q AS MATERIALIZED (SELECT vec_id, "label", list_dot_product(e, w1.w) x, list_dot_product(e, p2.w) y FROM c0, w1, p2 WHERE k = 3000)"""


@query("cloud_coverage", "X3 J13", f"""WITH RECURSIVE {_PCA}, d AS (SELECT a.vec_id, a."label", min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) dist FROM q a, q b WHERE a."label" <> 0 AND b."label" = 0 GROUP BY 1,2)
SELECT "label", {R('median(dist)', 4)} median_nn, {R('quantile_cont(dist, 0.95)', 4)} p95_nn FROM d GROUP BY 1""")
def cloud_coverage(spark, sf):
    """Distance of every other cloud's points to the nearest reference point in the plane of two components of all coordinates."""
    dims = [f"e{k}" for k in range(64)]
    e = load(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(dims)])
    e = freeze(X.principal_components(freeze(e), ["vec_id", "label"], dims, 2))
    step = e.agg(((F.max("pc1") - F.min("pc1")) / 40).alias("s")).first().s or 1.0
    d = N.nearest_distance(e.where("label <> 0"), e.where("label = 0"), "vec_id", ["pc1", "pc2"], step)
    j = d.join(e.select("vec_id", "label"), "vec_id")
    p = exact_percentiles(j, ["label"], "distance", {"median_nn": 0.5, "p95_nn": 0.95})
    return p.select("label", rnd(F.col("median_nn"), 4).alias("median_nn"), rnd(F.col("p95_nn"), 4).alias("p95_nn"))


_Z2 = """z AS (SELECT series_key, ts, ("value" - avg("value") OVER w)/stddev_pop("value") OVER w x FROM bins WINDOW w AS (PARTITION BY series_key)),
e AS MATERIALIZED (SELECT * FROM (SELECT series_key, row_number() OVER o - 1 i, x a, lead(x, 2) OVER o b, lead(x, 4) OVER o c FROM z WINDOW o AS (PARTITION BY series_key ORDER BY ts)) WHERE c IS NOT NULL)"""


@query("largest_exponents", "X8 J13", f"""WITH {BINS_SQL}, {_Z2}, l AS (SELECT series_key, max(i) - 20 m FROM e GROUP BY 1), v AS MATERIALIZED (SELECT e.* FROM e JOIN l USING (series_key) WHERE i <= m),
u0 AS (SELECT p.series_key, p.i, q.i j, (p.a-q.a)*(p.a-q.a)+(p.b-q.b)*(p.b-q.b)+(p.c-q.c)*(p.c-q.c) d FROM v p JOIN v q ON p.series_key = q.series_key AND abs(p.i-q.i) > 10),
u AS (SELECT series_key, i, min({{'d': d, 'j': j}}).j j FROM u0 GROUP BY 1, 2), h AS (SELECT series_key, i, j, unnest(range(0, 20)) h FROM u),
dv AS (SELECT h.series_key, h, sqrt((p.a-q.a)*(p.a-q.a)+(p.b-q.b)*(p.b-q.b)+(p.c-q.c)*(p.c-q.c)) d FROM h JOIN e p ON p.series_key=h.series_key AND p.i = h.i+h.h JOIN e q ON q.series_key=h.series_key AND q.i = h.j+h.h),
c AS (SELECT series_key, h, avg(ln(d)) y FROM dv WHERE d > 1e-8 GROUP BY 1,2) SELECT series_key, {R('regr_slope(y, h)', 5)} exponent FROM c GROUP BY 1""")
def largest_exponents(spark, sf):
    """Every series over its whole span."""
    points = freeze(X.delay_vectors(freeze(series_bins(spark, sf).select("series_key", "ts", "value")), "series_key", "ts", "value", 2))
    return X.largest_exponent(points, "series_key").withColumn("exponent", rnd(F.col("exponent"), 5))


# squares regressed on twelve squares before: products of all columns, then elimination row by row
_ARCH = """zl AS (SELECT series_key, count(*) n, list(z ORDER BY ts) z0, sqrt(sum(z*z)/count(*)) sd FROM y GROUP BY 1 HAVING count(*) >= 30 AND sum(z*z) > 0),
zn AS MATERIALIZED (SELECT series_key, n, list_transform(z0, lambda v: v/sd) z, least(12, n//4) m FROM zl), sq AS (SELECT series_key, n, m, list_transform(z, lambda v: v*v - 1) q FROM zn),
ct AS MATERIALIZED (SELECT series_key, a, t, CASE WHEN a = 0 THEN 1.0::DOUBLE WHEN a = 13 THEN q[t] WHEN a <= m THEN q[t-a] ELSE 0 END c FROM (SELECT series_key, m, q, unnest(range(m+1, n+1)) t FROM sq), range(0, 14) r(a)),
g1 AS (SELECT x.series_key, x.a, y.a b, sum(x.c*y.c) v FROM ct x JOIN ct y ON x.series_key = y.series_key AND x.t = y.t GROUP BY 1, 2, 3), g2 AS (SELECT series_key, a, list(v ORDER BY b) v FROM g1 GROUP BY 1, 2),
el AS (SELECT series_key, list(v ORDER BY a) m, list(v ORDER BY a) d, 1 p FROM g2 GROUP BY 1 UNION ALL SELECT series_key, CASE WHEN m[p][p] <= 1e-10*d[p][p] THEN m ELSE
 list_transform(m, lambda w, r: CASE WHEN r <= p THEN w ELSE list_transform(w, lambda x, c: x - w[p]/m[p][p]*m[p][c]) END) END, d, p+1 FROM el WHERE p <= 13),
ar AS (SELECT series_key, CASE WHEN d[14][14] - d[1][14]*d[1][14]/d[1][1] > 1e-12 THEN 1 - m[14][14]/(d[14][14] - d[1][14]*d[1][14]/d[1][1]) ELSE 0 END arch_lm FROM el WHERE p = 14)"""
_KPSS = """lg AS (SELECT series_key, n, l, list_sum(list_transform(range(1, n-l+1), lambda t: z[t]*z[t+l])) s FROM (SELECT *, unnest(range(1, floor(pow(n, 2/9.0))::BIGINT + 1)) l FROM zn)),
hh AS (SELECT series_key, n, sum(l*s/(n/2))/(1 + sum(s/(n/2))) r FROM lg GROUP BY 1, 2), al AS (SELECT series_key, least(n-1, floor(1.1447*pow(r*r, 1/3.0)*pow(n, 1/3.0)))::BIGINT k FROM hh),
lv AS (SELECT series_key, n + coalesce(sum(2*list_sum(list_transform(range(1, n-l+1), lambda t: z[t]*z[t+l]))*(1 - l/(k+1.0))), 0) v FROM (SELECT zn.*, k, unnest(range(1, k+1)) l FROM zn JOIN al USING (series_key)) GROUP BY series_key, n),
ps AS (SELECT series_key, n, sum(c*c) e FROM (SELECT series_key, n, sum(x) OVER (PARTITION BY series_key ORDER BY i) c FROM (SELECT series_key, n, unnest(z) x, unnest(range(0, n)) i FROM zn)) GROUP BY 1, 2),
kp AS (SELECT series_key, e/n/(coalesce(v, n)) kpss FROM ps LEFT JOIN lv USING (series_key))"""
_ENTROPY = """hn AS (SELECT series_key, n, i, z[i+1]*(0.5 - 0.5*cos(2*pi()*i/(n-1))) h FROM (SELECT *, unnest(range(0, n)) i FROM zn)), fq AS (SELECT series_key, unnest(range(1, n//2+1)) f FROM zn),
pw AS (SELECT series_key, f, pow(sum(h*cos(2*pi()*((f*i)%n)/n)), 2) + pow(sum(h*sin(2*pi()*((f*i)%n)/n)), 2) p FROM hn JOIN fq USING (series_key) GROUP BY 1, 2),
en AS (SELECT series_key, -sum(CASE WHEN p > 0 THEN p*ln(p) ELSE 0 END)/ln(any_value(c)) e FROM (SELECT series_key, p/sum(p) OVER (PARTITION BY series_key) p, count(*) OVER (PARTITION BY series_key) c FROM pw) GROUP BY 1)"""


@query("feature_table", "X1", f"""WITH RECURSIVE {BINS_SQL}, z AS (SELECT series_key, ts, "value", "value" - avg("value") OVER (PARTITION BY series_key) z FROM bins),
y AS (SELECT *, lead(z) OVER w nx, sum(CASE WHEN p <> "value" THEN 1 ELSE 0 END) OVER w run FROM (SELECT *, lag("value") OVER (PARTITION BY series_key ORDER BY ts) p FROM z) WINDOW w AS (PARTITION BY series_key ORDER BY ts)),
f AS (SELECT series_key, max(k) k FROM (SELECT series_key, run, count(*) k FROM y GROUP BY 1, 2) GROUP BY 1), s AS (SELECT series_key, count(*) n, sum(z*z) s2, avg(z*z*z) m3, sum(z*nx) s1 FROM y GROUP BY 1), {_ARCH}, {_KPSS}, {_ENTROPY}
SELECT series_key, {R('s1/s2')} acf1, {R('arch_lm')} arch_lm, {R('e')} spec_entropy, {R('kpss')} kpss, {R('k/n')} flat_spots, {R('m3/pow(s2/n, 1.5)')} skew
FROM s JOIN f USING (series_key) JOIN ar USING (series_key) JOIN kp USING (series_key) JOIN en USING (series_key) WHERE n >= 30 AND s2 > 0""")
def feature_table(spark, sf):
    f = X.feature_table(freeze(series_bins(spark, sf).select("series_key", "ts", "value")), "series_key", "ts", "value")
    return f.select("series_key", *[rnd(F.col(c)).alias(c) for c in X.FEATURES])


@query("feature_components", "X2")
def feature_components(spark, sf):
    points = challenge_table(spark, sf).select("challenge_id", F.posexplode("context").alias("i", "v"))
    long = X.robust_scale(freeze(X.feature_table(points, "challenge_id", "i", "v")).unpivot(["challenge_id"], list(X.FEATURES), "feature", "v"), "feature", "v")
    wide = long.groupBy("challenge_id").pivot("feature", list(X.FEATURES)).agg(F.first("v"))
    p = X.principal_components(wide, ["challenge_id"], list(X.FEATURES), 2)
    return p.select("challenge_id", rnd(F.abs("pc1")).alias("pc1"), rnd(F.abs("pc2")).alias("pc2"))


@query("robust_scaling", "X2", f"""WITH l AS (SELECT vec_id, i - 1 dim, embedding[i]::DOUBLE v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) i FROM embeddings) WHERE i <= 64),
q AS (SELECT dim, median(v) m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) r FROM l GROUP BY 1) SELECT dim::BIGINT dim, {R('avg(least(6, greatest(-6, (v-m)/r)))')} mean_z, {R('max(least(6, greatest(-6, (v-m)/r)))')} max_z FROM l JOIN q USING (dim) GROUP BY 1""")
def robust_scaling(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    z = X.robust_scale(e, "dim", "v")
    return z.groupBy(F.col("dim").cast("bigint").alias("dim")).agg(rnd(F.avg("v")).alias("mean_z"), rnd(F.max("v")).alias("max_z"))


ROLL_BLOCK = 128
_RHO = "list_sum(list_transform(range(1, len(x)-{p}+1), lambda i: x[i]*x[i+{p}]))/list_sum(list_transform(x, lambda q: q*q)) r{p}"
_ROLL = f"""WITH RECURSIVE {BINS_SQL}, s0 AS (SELECT series_key, list("value" ORDER BY ts) v FROM bins GROUP BY 1), s1 AS (SELECT series_key, v[1:len(v)//2] c, v[len(v)//2+1:] t, len(v) - len(v)//2 total FROM s0 WHERE len(v) >= 2),
rl AS (SELECT series_key, total, len(c) n, c h FROM s1 UNION ALL
 SELECT series_key, total, n, list_concat(h, list_transform(range(0, {ROLL_BLOCK}), lambda k: CASE WHEN p < 2 THEN h[len(h)] ELSE h[len(h)-p+k%p+1] END)) FROM
 (SELECT *, CASE WHEN greatest(r12, r24, r36) > 0.2 THEN CASE greatest(r12, r24, r36) WHEN r12 THEN 12 WHEN r24 THEN 24 ELSE 36 END ELSE 0 END p FROM
 (SELECT *, {", ".join(_RHO.format(p=p) for p in (12, 24, 36))} FROM (SELECT series_key, total, n, h, list_transform(h, lambda q: q - m) x FROM (SELECT *, list_avg(h) m FROM rl WHERE len(h) - n < total))))),
g AS (SELECT series_key, h[n+1:n+total] g FROM rl WHERE len(h) - n >= total), e AS (SELECT s1.series_key, total, t, g, list_stddev_pop(t) sd, unnest(range(0, total)) k FROM s1 JOIN g USING (series_key))
SELECT series_key, any_value(total) steps, {R("coalesce(min(CASE WHEN abs(g[k+1] - t[k+1])/(CASE WHEN sd > 0 THEN sd ELSE 1 END) > 0.4 THEN k END), any_value(total))")} vpt,
 {R("sqrt(avg(pow(g[k+1] - t[k+1], 2)))/(CASE WHEN any_value(sd) > 0 THEN any_value(sd) ELSE 1 END)")} nrmse FROM e GROUP BY 1"""


@query("rollout_report", "M13 X9", _ROLL)
def rollout_report(spark, sf):
    """Roll the seasonal model on from the first half of each whole series over all of its second half, block by block.

    ``vpt`` is the first step that is off by 0.4 of the second half's spread, else the half's length; ``nrmse``
    is over all steps. Series of one point have no first half and give no row.
    """
    t = series_bins(spark, sf).groupBy("series_key").agg(F.expr("transform(array_sort(collect_list(struct(ts, value))), p -> p.value)").alias("v"))
    t = freeze(t.where("size(v) >= 2").selectExpr("series_key", "slice(v, 1, size(v) div 2) AS context", "slice(v, size(v) div 2 + 1, size(v)) AS truth"))
    run = M.free_run(t.withColumn("total", F.size("truth")), "series_key", "total", ROLL_BLOCK)
    spread = t.select("series_key", F.expr(A.std_pop("truth")).alias("sd"), "truth")
    pairs = run.join(spread, "series_key").select("series_key", F.expr("if(sd > 0, sd, 1D)").alias("sd"), F.posexplode(F.arrays_zip("generated", "truth")).alias("step", "p"))
    off = F.abs(F.col("p.generated") - F.col("p.truth")) / F.col("sd")
    return pairs.groupBy("series_key").agg(F.count(F.lit(1)).alias("steps"), rnd(F.coalesce(F.min(F.when(off > 0.4, F.col("step"))), F.count(F.lit(1)))).alias("vpt"), rnd(F.sqrt(F.avg(off * off))).alias("nrmse"))
