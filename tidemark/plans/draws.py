"""Sampling, augmentation and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import arrays as A
from tidemark.functions.hashing import beacon_seed, crc_bag, md5_bag, uniform_sql
from tidemark.operators import augment as U, forecast as M, quality as Q, sampling as S
from tidemark.operators.spectrum import flatness_windows
from tidemark.plans.board import CH_SQL, SCORE_SQL, STATS_SQL, challenge_table
from tidemark.plans.views import BINS_SQL, R, load, rnd, series_bins
from tidemark.registry import query

# one candidate series per customer: (domain, class, band) from nation, segment and key
_SER = """SELECT c_custkey "key", concat('N', c_nationkey % 7) "domain", c_mktsegment dgp_class, CASE c_custkey % 3 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' ELSE 'weekly' END cadence FROM customer"""
N_DRAW, SEED = 400, "round-17"


def pool(spark, sf):
    return load(spark, sf, "customer").selectExpr("c_custkey AS key", "concat('N', c_nationkey % 7) AS domain", "c_mktsegment AS dgp_class",
                                                  "CASE c_custkey % 3 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' ELSE 'weekly' END AS cadence")


_QUOTA = f"""ser AS ({_SER}), cl AS (SELECT DISTINCT "domain", dgp_class, cadence FROM ser),
qd AS (SELECT "domain", {N_DRAW} // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY "domain") - 1 < {N_DRAW} % count(*) OVER () THEN 1 ELSE 0 END nd FROM (SELECT DISTINCT "domain" FROM cl)),
qc AS (SELECT "domain", dgp_class, nd // count(*) OVER w + CASE WHEN row_number() OVER (PARTITION BY "domain" ORDER BY dgp_class) - 1 < nd % count(*) OVER w THEN 1 ELSE 0 END nc FROM (SELECT DISTINCT "domain", dgp_class FROM cl) JOIN qd USING ("domain") WINDOW w AS (PARTITION BY "domain")),
qq AS (SELECT "domain", dgp_class, cadence, CAST(nc // count(*) OVER w + CASE WHEN row_number() OVER (PARTITION BY "domain", dgp_class ORDER BY cadence) - 1 < nc % count(*) OVER w THEN 1 ELSE 0 END AS BIGINT) quota FROM cl JOIN qc USING ("domain", dgp_class) WINDOW w AS (PARTITION BY "domain", dgp_class))"""


@query("equal_weight_quotas", "T4", f"WITH {_QUOTA} SELECT * FROM qq")
def equal_weight_quotas(spark, sf):
    return S.equal_weight_quotas(pool(spark, sf), N_DRAW).withColumn("quota", F.col("quota").cast("bigint"))


@query("stratified_draw", "T4 T8", f"""WITH {_QUOTA}, r AS (SELECT ser.*, quota, row_number() OVER (PARTITION BY ser."domain", ser.dgp_class, ser.cadence ORDER BY {uniform_sql(SEED, "'pick'", '"key"')}, "key") rk,
 count(*) OVER (PARTITION BY ser."domain", ser.dgp_class, ser.cadence) sz FROM ser JOIN qq USING ("domain", dgp_class, cadence) WHERE quota > 0),
o AS (SELECT "domain", dgp_class, cadence, sz, unnest(range(sz + 1, quota + 1)) slot FROM (SELECT DISTINCT "domain", dgp_class, cadence, sz, quota FROM r WHERE quota > sz)),
o2 AS (SELECT *, CAST(floor({uniform_sql(SEED, "'extra'", '"domain"', 'dgp_class', 'cadence', 'slot')} * sz) + 1 AS BIGINT) rk FROM o)
SELECT "domain", dgp_class, cadence, "key", rk slot FROM r WHERE rk <= quota UNION ALL SELECT r."domain", r.dgp_class, r.cadence, "key", slot FROM o2 JOIN r USING ("domain", dgp_class, cadence, rk)""")
def stratified_draw(spark, sf):
    p = pool(spark, sf)
    return S.pick(p, S.equal_weight_quotas(p, N_DRAW), ["domain", "dgp_class", "cadence"], "key", SEED, N_DRAW)


# the split over domains: gamma shares by hash, largest remainders of blocks, the rest to the largest; seats where blocks are too few
_BLOCK, _BLOCKS = S.MIN_CLASS_SLOTS, 128 // S.MIN_CLASS_SLOTS
_GAMMA = " + ".join(f"""ln(greatest({uniform_sql(SEED, "'gamma'", '"domain"', str(i))}, 1e-12))""" for i in range(4))
_JQ = f"""ser AS ({_SER}), g AS (SELECT "domain", count(*) OVER () k, -({_GAMMA}) g FROM (SELECT DISTINCT "domain" FROM ser)),
jr AS (SELECT *, greatest({_BLOCKS}-k, 0) avail, g/sum(g) OVER ()*greatest({_BLOCKS}-k, 0) raw FROM g),
jo AS (SELECT *, avail - sum(floor(raw)) OVER () rem, row_number() OVER (ORDER BY raw - floor(raw) DESC, "domain") ord FROM jr), jb AS (SELECT *, floor(raw) + CASE WHEN ord <= rem THEN 1 ELSE 0 END + 1 blocks FROM jo),
jt AS (SELECT *, row_number() OVER (ORDER BY blocks DESC, "domain") top, row_number() OVER (ORDER BY {uniform_sql(SEED, "'seat'", '"domain"')}, "domain") - 1 seat FROM jb),
jq AS (SELECT "domain", CAST(CASE WHEN k > {_BLOCKS} THEN CASE WHEN seat < {_BLOCKS} THEN 128 // {_BLOCKS} + CASE WHEN seat < 128 % {_BLOCKS} THEN 1 ELSE 0 END ELSE 0 END
 ELSE blocks*{_BLOCK} + CASE WHEN top = 1 THEN {128 - _BLOCKS * _BLOCK} ELSE 0 END END AS BIGINT) quota FROM jt)"""
_CR = _JQ + f""", cs AS (SELECT "domain", dgp_class, count(*) size, any_value(quota) quota FROM ser JOIN jq USING ("domain") WHERE quota > 0 GROUP BY 1, 2),
ck AS (SELECT *, {uniform_sql(SEED, "'mask'", '"domain"', 'dgp_class')} < 0.6 keep, row_number() OVER (PARTITION BY "domain" ORDER BY {uniform_sql(SEED, "'one'", '"domain"', 'dgp_class')}, dgp_class) = 1 fb FROM cs),
ca AS (SELECT *, max(keep::INT) OVER (PARTITION BY "domain") kept FROM ck), cd AS (SELECT *, -ln(greatest({uniform_sql(SEED, "'draw'", '"domain"', 'dgp_class')}, 1e-12))/least(size, {_BLOCK}) x FROM ca WHERE keep OR (kept = 0 AND fb)),
cw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "domain" ORDER BY x, dgp_class) r FROM cd) WHERE r <= greatest(1, quota // {_BLOCK})),
ce AS (SELECT *, count(*) OVER (PARTITION BY "domain") n, row_number() OVER (PARTITION BY "domain" ORDER BY dgp_class) - 1 i FROM cw),
cq AS (SELECT "domain", dgp_class, CAST(quota // n + CASE WHEN i < quota % n THEN 1 ELSE 0 END AS BIGINT) quota FROM ce)"""


@query("jittered_quotas", "T5", f"WITH {_JQ} SELECT * FROM jq")
def jittered_quotas(spark, sf):
    return S.jittered_quotas(pool(spark, sf), 128, SEED)


@query("class_rotation", "T5 T7", f"WITH {_CR} SELECT * FROM cq")
def class_rotation(spark, sf):
    p = pool(spark, sf)
    return S.rotate_classes(p, S.jittered_quotas(p, 128, SEED), SEED, 0.6)


@query("jittered_draw", "T4 T5 T7 T8 T9")
def jittered_draw(spark, sf):
    p = pool(spark, sf)
    q = S.rotate_classes(p, S.jittered_quotas(p, 128, SEED), SEED, 0.6)
    got, short = S.redraw_pool(p, F.col("key") % 10 != 0, q, ["domain", "dgp_class"], "key", SEED, 128)
    return got.join(F.broadcast(short.select("asked", "served", "short")))


@query("bag_membership", "T6", f"""SELECT c_custkey "key", floor({uniform_sql('bag', "'42'", 'c_custkey')} * 10000) < 8000 keep FROM customer""")
def bag_membership(spark, sf):
    return pool(spark, sf).select("key", md5_bag(F.lit("42"), F.col("key"), 0.8).alias("keep"))


@query("crc_bag_membership", "T6")
def crc_bag_membership(spark, sf):
    return pool(spark, sf).select("key", crc_bag(F.lit(42), F.col("key").cast("string"), 0.8).alias("keep"))


@query("beacon_seeds", "F25", """SELECT o_orderkey, CAST(CAST(('0x' || substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), 'epoch-1', o_orderstatus)), 1, 16)) AS UBIGINT) AS VARCHAR) seed FROM orders""")
def beacon_seeds(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", beacon_seed(F.col("o_orderkey").cast("string"), F.lit("epoch-1"), F.col("o_orderstatus")).alias("seed"))


@query("feed_registry", "A17", """WITH f AS (SELECT r_name, n_name, count(*) OVER (PARTITION BY r_name) k FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT concat(r_name, '/', n_name) feed, round(1.0::DOUBLE/k, 6) weight FROM f""")
def feed_registry(spark, sf):
    """One feed per panel member, the feed's weight shared over its panel."""
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    reg = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("panel"))
    return reg.select("r_name", F.explode("panel").alias("p"), F.size("panel").alias("k")).select(
        F.concat_ws("/", "r_name", "p").alias("feed"), F.round(F.lit(1.0) / F.col("k"), 6).alias("weight"))


@query("mixture_draw", "T11", f"""WITH w AS (SELECT p_brand feed, count(*)::DOUBLE weight FROM part GROUP BY 1), c AS (SELECT feed, sum(weight) OVER (ORDER BY feed) hi, sum(weight) OVER (ORDER BY feed) - weight lo, sum(weight) OVER () t FROM w),
d AS (SELECT unnest(range(2000)) id), u AS (SELECT id, {uniform_sql(SEED, "'mix'", 'id')} u FROM d) SELECT id, feed FROM u JOIN c ON u*t >= lo AND u*t < hi""")
def mixture_draw(spark, sf):
    feeds = load(spark, sf, "part").groupBy(F.col("p_brand").alias("feed")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return S.mixture_draw(feeds, 2000, SEED)


@query("augmented_challenges", "C3 C4 C5")
def augmented_challenges(spark, sf):
    a = U.augment(challenge_table(spark, sf), SEED)
    return a.select("challenge_id", "op", rnd(F.expr(A.mean("context"))).alias("ctx_mean"), rnd(F.expr(A.std_pop("truth"))).alias("truth_sd"), F.size("context").alias("n"))


@query("flat_redraw", "C3", f"""WITH {BINS_SQL}, t AS (SELECT series_key, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) - 1 r, CASE WHEN row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) <= 70 THEN 5 ELSE "value" END v FROM bins),
a AS (SELECT series_key, r // 32 attempt, stddev_pop(v) sd, avg(v) m FROM t GROUP BY 1,2 HAVING count(*) = 32)
SELECT series_key, attempt::BIGINT attempt, {R('m', 3)} ctx_mean FROM a QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY CASE WHEN sd > 1e-8 THEN 0 ELSE 1 END, CASE WHEN sd > 1e-8 THEN attempt ELSE -attempt END) = 1""")
def flat_redraw(spark, sf):
    """The newest 70 points are flattened: the first attempt whose context still varies is kept."""
    from pyspark.sql import Window
    w = Window.partitionBy("series_key").orderBy(F.col("ts").desc())
    t = series_bins(spark, sf).withColumn("r", F.row_number().over(w) - 1).withColumn("v", F.expr("if(r < 70, 5D, value)"))
    g = t.groupBy("series_key", F.expr("r div 32").alias("attempt")).agg(F.expr("transform(array_sort(collect_list(struct(-r AS p, v))), x -> x.v)").alias("context")).where("size(context) = 32")
    k = U.first_lively(g, "series_key")
    return k.select("series_key", "attempt", rnd(F.expr(A.mean("context")), 3).alias("ctx_mean"))


@query("series_quality", "Q1 W4 W10", f"""WITH {BINS_SQL}, b AS (SELECT series_key, ts, CASE WHEN series_key LIKE 'event%' AND hour(ts) % 6 = 0 THEN NULL WHEN series_key LIKE '%1-URGENT' THEN 7.0 ELSE "value" END v FROM bins),
f AS (SELECT * FROM b WHERE v IS NOT NULL), md AS (SELECT series_key, median(round(v, 10)) med FROM f GROUP BY 1),
fl AS (SELECT series_key, max(c)::DOUBLE/sum(c) flat FROM (SELECT series_key, run, count(*) c FROM (SELECT series_key, sum(ch) OVER (PARTITION BY series_key ORDER BY ts) run FROM (SELECT series_key, ts, CASE WHEN v <> lag(v) OVER (PARTITION BY series_key ORDER BY ts) THEN 1 ELSE 0 END ch FROM f)) GROUP BY 1,2) GROUP BY 1),
a AS (SELECT f.series_key, count(*) n, count(DISTINCT round(v,10)) u, avg(v) m, stddev_pop(v) s, sum((v-med)*(v-med)) ss, max((v-med)*(v-med)) mx FROM f JOIN md USING (series_key) GROUP BY 1),
t AS (SELECT series_key, count(*) n0 FROM b GROUP BY 1), z AS (SELECT *, n::DOUBLE/n0 ff, u::DOUBLE/n ur, CASE WHEN ss > 0 THEN mx/ss ELSE 0 END sp FROM a JOIN t USING (series_key) JOIN fl USING (series_key))
SELECT series_key, n::BIGINT n, {R('ff')} finite_frac, {R('ur')} unique_ratio, {R('flat')} flat_frac, {R('sp')} spike,
 concat_ws(',', CASE WHEN ff < 0.85 THEN 'finite_frac' END, CASE WHEN n < {Q.SERIES_LEN} THEN 'length' END, CASE WHEN s <= 1e-6*(abs(m)+1e-8) OR s = 0 THEN 'near-constant' END, CASE WHEN ur < 0.05 THEN 'cardinality' END, CASE WHEN flat > 0.5 THEN 'flatline' END, CASE WHEN sp > 0.5 THEN 'spike' END) failures FROM z""")
def series_quality(spark, sf):
    b = series_bins(spark, sf).withColumn("value", F.expr("CASE WHEN series_key LIKE 'event%' AND hour(ts) % 6 = 0 THEN NULL WHEN series_key LIKE '%1-URGENT' THEN 7.0D ELSE value END"))
    r = Q.assess_series(b, ["series_key"], "ts", "value")
    return r.select("series_key", F.col("n").cast("bigint").alias("n"), *[rnd(F.col(c)).alias(c) for c in ("finite_frac", "unique_ratio", "flat_frac", "spike")], F.concat_ws(",", "failures").alias("failures"))


@query("spectral_flatness", "Q2", f"""WITH {CH_SQL}, d AS (SELECT challenge_id, context x, len(context) n, list_avg(context) mu FROM ch WHERE len(context) >= 8),
sl AS (SELECT *, list_sum(list_transform(range(0, n), lambda i: x[i+1]*(i-(n-1)/2.0)))*12.0/(n*(n*n-1.0)) s FROM d), y AS (SELECT challenge_id, n, i, (x[i+1]-mu-s*(i-(n-1)/2.0))*(0.5-0.5*cos(2*pi()*i/(n-1))) y FROM (SELECT *, unnest(range(0, n)) i FROM sl)),
fr AS (SELECT challenge_id, unnest(range(1, n//2+1)) f FROM d), pw AS (SELECT challenge_id, pow(sum(y*cos(2*pi()*((f*i)%n)/n)), 2) + pow(sum(y*sin(2*pi()*((f*i)%n)/n)), 2) + 1e-20 p FROM y JOIN fr USING (challenge_id) GROUP BY challenge_id, f),
fl AS (SELECT challenge_id, exp(avg(ln(p)))/avg(p) v FROM pw GROUP BY 1) SELECT challenge_id, {R("coalesce(v, 'nan'::DOUBLE)", 5)} flatness FROM ch LEFT JOIN fl USING (challenge_id)""")
def spectral_flatness(spark, sf):
    return flatness_windows(challenge_table(spark, sf), "challenge_id", "context").withColumn("flatness", rnd(F.col("flatness"), 5))


_DISC = f"""dl AS (SELECT challenge_id, unnest([1,2,3,12,24,36]) p FROM st), dp AS (SELECT st.challenge_id, max(abs(list_sum(list_transform(range(1, n-p+1), lambda i: x[i]*x[i+p]))/denom)) pr FROM dl JOIN st USING (challenge_id) WHERE p < n GROUP BY 1),
ne AS (SELECT challenge_id, source_id, smae FROM sc WHERE model = 'seasonal_naive'), dd2 AS (SELECT source_id, avg(pr) pr, avg(smae) ne, count(*) nw FROM ne JOIN dp USING (challenge_id) GROUP BY 1)"""


def window_scores(spark, sf):
    ch = challenge_table(spark, sf)
    st = M.with_context_stats(ch).withColumn("predictability", F.expr(Q.predictability()))
    naive = A.total(f"zip_with(truth, {M.COLUMN_PATHS['seasonal_naive']}, (t, p) -> abs(t - p))")
    return st.select("source_id", "predictability", F.expr(f"{naive} / horizon / sigma0").alias("naive_error"))


@query("discrimination", "Q3", f"WITH {SCORE_SQL}, {_DISC} SELECT source_id, {R('pr')} predictability, {R('ne')} naive_error, nw n_windows, nw >= 4 AND pr >= 0.15 AND ne >= 0.1 ok FROM dd2")
def discrimination(spark, sf):
    d = Q.discrimination(window_scores(spark, sf), ["source_id"])
    return d.select("source_id", rnd(F.col("predictability")).alias("predictability"), rnd(F.col("naive_error")).alias("naive_error"), "n_windows", "ok")


@query("source_verdicts", "Q4 Q3 Q1", f"""WITH {SCORE_SQL}, {_DISC}, md AS (SELECT series_key, median(round("value", 10)) med FROM bins GROUP BY 1),
fl AS (SELECT series_key, max(c)::DOUBLE/sum(c) flat FROM (SELECT series_key, run, count(*) c FROM (SELECT series_key, sum(ch) OVER (PARTITION BY series_key ORDER BY ts) run FROM (SELECT series_key, ts, CASE WHEN "value" <> lag("value") OVER (PARTITION BY series_key ORDER BY ts) THEN 1 ELSE 0 END ch FROM bins)) GROUP BY 1,2) GROUP BY 1),
a AS (SELECT source_id, bins.series_key, count(*) n, count(DISTINCT round("value", 10)) u, avg("value") m, stddev_pop("value") sd, sum(("value"-med)*("value"-med)) ss, max(("value"-med)*("value"-med)) mx FROM bins JOIN md USING (series_key) GROUP BY 1,2),
s AS (SELECT source_id, n >= {Q.SERIES_LEN} AND NOT (n >= 8 AND (sd <= 1e-6*(abs(m)+1e-8) OR sd = 0 OR u::DOUBLE/n < 0.05 OR flat > 0.5 OR (ss > 0 AND mx/ss > 0.5))) ok FROM a JOIN fl USING (series_key)),
v AS (SELECT source_id, count(*) n_series, count(CASE WHEN ok THEN 1 END) n_ok FROM s GROUP BY 1)
SELECT source_id, n_series, n_ok, CASE WHEN n_ok < 0.6*n_series THEN 'too few series pass' WHEN nw IS NULL OR nw < 4 THEN 'too few windows' ELSE concat_ws(',', CASE WHEN pr < 0.15 THEN 'unforecastable' END, CASE WHEN ne < 0.1 THEN 'trivial' END) END reasons FROM v LEFT JOIN dd2 USING (source_id)""")
def source_verdicts(spark, sf):
    q = Q.assess_series(series_bins(spark, sf), ["source_id", "series_key"], "ts", "value")
    v = Q.source_verdict(q, Q.discrimination(window_scores(spark, sf), ["source_id"]))
    return v.select("source_id", "n_series", "n_ok", F.concat_ws(",", "reasons").alias("reasons"))
