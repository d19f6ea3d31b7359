"""Gates, composition, as-of, novelty and leakage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import arrays as A
from tidemark.functions.hashing import uniform, uniform_sql
from tidemark.operators import forecast as M, gates as G, novelty as N, scoring as S
from tidemark.plans.board import CH_SQL, SCORE_SQL, STATS_SQL, challenge_table, metrics_sql, score_table
from tidemark.plans.views import BINS_SQL, R, load, rnd, series_bins
from tidemark.registry import query

PARROT_SQL = """
pq AS (SELECT challenge_id, context, n, horizon h, greatest(8, least(2*horizon, n//4)) q FROM st),
pk AS (SELECT *, list_avg(context[n-q+1:n]) mq FROM pq WHERE n >= q+h+1 AND n-q-h >= 1),
pz AS (SELECT *, list_transform(context[n-q+1:n], lambda v: v-mq) qz FROM pk),
pj AS (SELECT challenge_id, h, q, n, context, qz, unnest(range(0, n-q-h)) j FROM pz),
pw AS (SELECT *, list_avg(context[j+1:j+q]) mw FROM pj),
ps2 AS (SELECT challenge_id, j, list_sum(list_transform(range(1, q+1), lambda i: (context[j+i]-mw)*qz[i])) / sqrt(list_sum(list_transform(context[j+1:j+q], lambda v: (v-mw)*(v-mw)))) sim FROM pw),
pb AS (SELECT challenge_id, j FROM ps2 QUALIFY row_number() OVER (PARTITION BY challenge_id ORDER BY sim DESC, j) = 1),
pf AS (SELECT pq.challenge_id, k.h step, CASE WHEN pb.j IS NULL THEN context[n] ELSE context[pb.j+q+k.h] + context[n] - context[pb.j+q] END point
  FROM pq LEFT JOIN pb USING (challenge_id), (SELECT unnest(range(1, 49)) h) k WHERE k.h <= pq.h)"""


@query("parrot_forecast", "J8 M9 V1", f"WITH {STATS_SQL}, {PARROT_SQL} SELECT challenge_id, step::BIGINT step, {R('point')} point FROM pf")
def parrot_forecast(spark, sf):
    f = M.parrot_forecasts(challenge_table(spark, sf))
    return f.select("challenge_id", F.posexplode("mean").alias("i", "p")).select("challenge_id", (F.col("i") + 1).cast("bigint").alias("step"), rnd(F.col("p")).alias("point"))


_PERR = f"""pe AS (SELECT pf.challenge_id, avg(abs(st.truth[step] - point)) mae, avg(abs(st.truth[step] - point))/any_value(st."scale") mase, avg(abs(st.truth[step] - point))/any_value(st.sigma0) smae,
  any_value(0.25+0.75*st.unseen_frac) weight FROM pf JOIN st USING (challenge_id) GROUP BY 1)"""


def _with_parrot(spark, sf):
    ch = challenge_table(spark, sf)
    cols = M.column_forecasts(ch, ("seasonal_naive", "ewma", "drift", "damped"))
    fc = cols.unionByName(M.parrot_forecasts(ch))
    return S.contributions(M.gaussian_band(fc))


@query("floor_check", "E1 M11", f"""WITH {SCORE_SQL}, {PARROT_SQL}, {_PERR}, m AS (SELECT model, sum(weight*mase)/sum(weight) s FROM sc WHERE model IN ('seasonal_naive','ewma','drift','damped') GROUP BY 1 UNION ALL SELECT 'context_parrot', sum(weight*mase)/sum(weight) FROM pe),
f AS (SELECT max(CASE WHEN model='seasonal_naive' THEN s END) a, max(CASE WHEN model='context_parrot' THEN s END) b FROM m)
SELECT model, {R('s')} score, {R('a')} floor_seasonal_naive, {R('b')} floor_context_parrot, CASE WHEN a >= b THEN 'seasonal_naive' ELSE 'context_parrot' END worst_floor, s < a AND s < b clears FROM m, f""")
def floor_check(spark, sf):
    r = G.clears_floor(S.metrics_by(_with_parrot(spark, sf), "model"))
    return r.select("model", *[rnd(F.col(c)).alias(c) for c in ("score", "floor_seasonal_naive", "floor_context_parrot")], "worst_floor", "clears")


@query("headroom", "E2", f"""WITH {SCORE_SQL}, m AS ({metrics_sql('model')}), a AS (SELECT * FROM m WHERE model = 'damped')
SELECT m.model, {R('a.mase-m.mase')} mase_margin, {R('a.wql-m.wql')} wql_margin, {R('a.crps-m.crps')} crps_margin, m.mase < a.mase AND m.wql <= a.wql beats_anchor FROM m, a""")
def headroom(spark, sf):
    h = G.headroom(S.metrics_by(score_table(spark, sf), "model"), "damped")
    return h.select("model", *[rnd(F.col(f"{c}_margin")).alias(f"{c}_margin") for c in ("mase", "wql", "crps")], "beats_anchor")


_U1, _U2 = uniform_sql("probe", "challenge_id", "h", "'a'"), uniform_sql("probe", "challenge_id", "h", "'b'")


@query("superior_probe", "E12 E2", f"""WITH {SCORE_SQL}, sdt AS (SELECT challenge_id, list_stddev_pop(truth) s FROM st),
pr AS (SELECT fc.challenge_id, avg(abs(0.05*greatest(s, 1e-8)*sqrt(-2*ln(greatest({_U1}, 1e-12)))*cos(2*pi()*{_U2}))) mae, any_value("scale") sc2, any_value(0.25+0.75*unseen_frac) w FROM fc JOIN sdt USING (challenge_id) WHERE model = 'ewma' GROUP BY 1),
a AS (SELECT sum(weight*mase)/sum(weight) am FROM sc WHERE model = 'damped'), b AS (SELECT sum(w*mae/sc2)/sum(w) pm FROM pr)
SELECT {R('pm')} probe_mase, {R('am')} anchor_mase, pm < am go FROM a, b""".replace("'h'", "'h'"))
def superior_probe(spark, sf):
    """A forecast known to be better (truth plus small noise) must beat the anchor, or the set has no headroom."""
    ch = M.with_context_stats(challenge_table(spark, sf))
    sd = A.std_pop("truth")
    steps = ch.select("challenge_id", "scale", "unseen_frac", F.expr(f"greatest({sd}, 1e-8D)").alias("s"), F.explode(F.sequence(F.lit(1), "horizon")).alias("h"))
    z = F.sqrt(-2 * F.log(F.greatest(uniform("probe", F.col("challenge_id"), F.col("h"), F.lit("a")), F.lit(1e-12)))) * F.cos(2 * F.pi() * uniform("probe", F.col("challenge_id"), F.col("h"), F.lit("b")))
    per = steps.groupBy("challenge_id").agg((F.avg(F.abs(0.05 * F.col("s") * z)) / F.first("scale")).alias("mase"), F.first(0.25 + 0.75 * F.col("unseen_frac")).alias("w"))
    p = per.agg((F.sum(F.col("w") * F.col("mase")) / F.sum("w")).alias("probe_mase"))
    a = score_table(spark, sf, ("damped",)).agg((F.sum(F.col("weight") * F.col("mase")) / F.sum("weight")).alias("anchor_mase"))
    return p.join(F.broadcast(a)).select(rnd(F.col("probe_mase")).alias("probe_mase"), rnd(F.col("anchor_mase")).alias("anchor_mase"), (F.col("probe_mase") < F.col("anchor_mase")).alias("go"))


@query("panel_fitness", "G11 G12", f"""WITH {SCORE_SQL}, e AS (SELECT "domain", model, avg(smae) err, count(*) n FROM sc GROUP BY 1,2 UNION ALL SELECT 'ALL', model, avg(smae), count(*) FROM sc GROUP BY 2)
SELECT "domain", max(n) n, {R('(max(err)-min(err))/avg(err)')} spread, {R("max(CASE WHEN model='damped' THEN err END)")} difficulty FROM e GROUP BY 1""")
def panel_fitness(spark, sf):
    s = score_table(spark, sf).select("domain", "model", "smae")
    # one aggregation with both levels: strata and the whole set
    e = s.groupingSets([[F.col("domain"), F.col("model")], [F.col("model")]], F.col("domain"), F.col("model")).agg(F.avg("smae").alias("err"), F.count(F.lit(1)).alias("n"))
    e = e.withColumn("domain", F.coalesce("domain", F.lit("ALL")))
    r = G.spread(e, "domain", anchor="damped")
    return r.select("domain", "n", rnd(F.col("spread")).alias("spread"), rnd(F.col("difficulty")).alias("difficulty"))


@query("foundational_fitness", "E3 E4 G13 G14", f"""WITH {SCORE_SQL}, {PARROT_SQL}, {_PERR}, e AS (SELECT model, avg(smae) err FROM sc WHERE model IN ('seasonal_naive','ewma','drift','damped') GROUP BY 1),
k AS (SELECT (max(err)-min(err))/avg(err) fit, max(CASE WHEN model='damped' THEN err END) strong FROM e), p AS (SELECT avg(smae) parrot FROM pe),
d AS (SELECT exp(-sum(p*ln(p))) eff FROM (SELECT count(*)::DOUBLE/sum(count(*)) OVER () p FROM ch GROUP BY "domain")),
m1 AS (SELECT min(c)::DOUBLE/sum(c) s FROM (SELECT count(*) c FROM ch GROUP BY dgp_class)), m2 AS (SELECT min(c)::DOUBLE/sum(c) s FROM (SELECT count(*) c FROM ch GROUP BY cadence)),
z AS (SELECT fit, 1/(1+exp(-6.0*(parrot/strong-1))) pg, least(1, eff/4.0) cg, CASE WHEN m1.s >= 0.02 THEN 1.0 ELSE 0 END dg, CASE WHEN m2.s >= 0.02 THEN 1.0 ELSE 0 END bg FROM k, p, d, m1, m2)
SELECT {R('fit')} fitness, {R('pg')} parrot_gate, {R('cg')} coverage_gate, {R('dg')} class_gate, {R('bg')} cadence_gate, {R('fit*pg*cg*dg*bg')} foundational FROM z""")
def foundational_fitness(spark, sf):
    s = _with_parrot(spark, sf).select("model", "smae")
    e = G.panel_errors(s)
    is_p = F.col("model") == "context_parrot"
    one = e.agg(F.max(F.when(~is_p, F.col("err"))).alias("hi"), F.min(F.when(~is_p, F.col("err"))).alias("lo"), F.avg(F.when(~is_p, F.col("err"))).alias("m"),
                F.max(F.when(F.col("model") == "damped", F.col("err"))).alias("strong"), F.max(F.when(is_p, F.col("err"))).alias("parrot"))
    labels = challenge_table(spark, sf).select("domain", "dgp_class", "cadence")
    # single-row frames: joining them is a scalar lookup
    z = one.join(F.broadcast(G.domain_coverage(labels))).join(F.broadcast(G.min_share(labels, "dgp_class"))).join(F.broadcast(G.min_share(labels, "cadence")))
    z = z.select(((F.col("hi") - F.col("lo")) / F.col("m")).alias("fitness"), G.parrot_gate(F.col("strong"), F.col("parrot")).alias("parrot_gate"), "coverage_gate",
                 G.breadth_gate(F.col("dgp_class_share")).alias("class_gate"), G.breadth_gate(F.col("cadence_share")).alias("cadence_gate"))
    z = z.withColumn("foundational", F.expr("fitness * parrot_gate * coverage_gate * class_gate * cadence_gate"))
    return z.select(*[rnd(F.col(c)).alias(c) for c in z.columns])


@query("domain_coverage", "G13", """WITH c AS (SELECT o_orderpriority d, count(*) c FROM orders GROUP BY 1), p AS (SELECT c::DOUBLE/sum(c) OVER () p FROM c)
SELECT count(*) n_domains, round(-sum(p*ln(p)), 6) entropy, round(exp(-sum(p*ln(p))), 6) effective_domains, round(least(1, exp(-sum(p*ln(p)))/4), 6) coverage_gate FROM p""")
def domain_coverage(spark, sf):
    d = G.domain_coverage(load(spark, sf, "orders").select(F.col("o_orderpriority").alias("domain")))
    return d.select("n_domains", *[rnd(F.col(c)).alias(c) for c in ("entropy", "effective_domains", "coverage_gate")])


@query("min_label_share", "G14", "WITH c AS (SELECT p_brand, count(*) c FROM part WHERE p_size <> 1 GROUP BY 1) SELECT round(min(c)::DOUBLE/sum(c), 6) share FROM c")
def min_label_share(spark, sf):
    p = load(spark, sf, "part").selectExpr("CASE WHEN p_size <> 1 THEN p_brand END AS brand")
    return G.min_share(p, "brand").select(rnd(F.col("brand_share")).alias("share"))


@query("round_composition", "G15", f"""WITH {CH_SQL}, u AS (SELECT 'pooled' kind, NULL::BIGINT draw, "domain" "label", count(*) n, count(DISTINCT dgp_class) n_classes FROM ch GROUP BY 3
UNION ALL SELECT 'draw', draw, "domain", count(*), count(DISTINCT dgp_class) FROM ch GROUP BY 2,3 UNION ALL SELECT 'cadence', NULL, cadence, count(*), count(DISTINCT dgp_class) FROM ch GROUP BY 3)
SELECT *, {R('n::DOUBLE/sum(n) OVER (PARTITION BY kind, draw)')} share FROM u""")
def round_composition(spark, sf):
    r = G.round_composition(challenge_table(spark, sf).select("draw", "domain", "cadence", "dgp_class"))
    return r.withColumn("draw", F.col("draw").cast("bigint")).withColumn("share", rnd(F.col("share")))


# ------------------------------------------------------------------- as-of, novelty, leakage
@query("as_of_gate", "J7 L3", """WITH c AS (SELECT user_id, min(ts) + INTERVAL 10 DAY c FROM events WHERE event_type = 'purchase' OR user_id % 2 = 0 GROUP BY 1)
SELECT user_id, count(CASE WHEN ts > c THEN 1 END) n_available, CAST(max(CASE WHEN ts <= c THEN epoch_us(ts) END) AS BIGINT) as_of_us, arg_max(CASE WHEN ts <= c THEN "value" END, CASE WHEN ts <= c THEN ts END) "value" FROM events JOIN c USING (user_id) GROUP BY 1""")
def as_of_gate(spark, sf):
    e = load(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    commits = e.where("event_type = 'purchase' OR user_id % 2 = 0").groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 10 DAY")).alias("commit_at"))
    rows = e.withColumn("available_at", F.col("ts"))
    fresh = N.available_after(rows, commits, ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    known = N.value_as_of(rows, commits, ["user_id"], "ts", "value")
    j = known.join(fresh, "user_id", "left")
    return j.select("user_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_available"), F.unix_micros("as_of").alias("as_of_us"), "value")


@query("window_signatures", "L1", f"""WITH {CH_SQL}, k AS (SELECT challenge_id, context, len(context) n, unnest(range(32)) k FROM ch),
r AS (SELECT challenge_id, k, context[floor(k*(n-1)/31.0)::INT+1] + (context[least(floor(k*(n-1)/31.0)::INT+2, n)] - context[floor(k*(n-1)/31.0)::INT+1]) * (k*(n-1)/31.0::DOUBLE - floor(k*(n-1)/31.0)) v FROM k),
c AS (SELECT challenge_id, k, v - avg(v) OVER (PARTITION BY challenge_id) c FROM r) SELECT challenge_id, k::BIGINT k, {R('c / sqrt(sum(c*c) OVER (PARTITION BY challenge_id))', 5)} s FROM c""")
def window_signatures(spark, sf):
    c = challenge_table(spark, sf).select("challenge_id", F.expr(N.signature("context")).alias("sig"))
    return c.select("challenge_id", F.posexplode("sig").alias("k", "s")).select("challenge_id", F.col("k").cast("bigint").alias("k"), rnd(F.col("s"), 5).alias("s"))


EMB_DIM = 64
NEAR = dims.DUP_COSINE
# copies of the stored vectors: exact (k=1), scaled by up to 5 % (k=2, near) and 25 % (k=3, not near)
_COPIES = ((0, 1, 0.0), (1, 5, 0.0), (2, 3, 0.05), (3, 7, 0.25))


def unit_vectors(spark, sf):
    """Embeddings and derived copies of them as unit vectors; ids are 4 x the stored id + copy kind."""
    e = load(spark, sf, "embeddings").select("vec_id", F.expr("transform(embedding, v -> CAST(v AS DOUBLE))").alias("x"))
    kinds = ", ".join(f"named_struct('k', {k}, 'm', {m}, 's', {s}D)" for k, m, s in _COPIES)
    e = e.withColumn("c", F.expr(f"explode(filter(array({kinds}), z -> vec_id % z.m = 0))"))
    e = e.select((F.col("vec_id") * 4 + F.col("c.k")).alias("vec_id"), F.expr("transform(x, (v, i) -> v * (1 + c.s * (i % 3 - 1)))").alias("x"))
    return e.select("vec_id", F.expr(N.unit("x")).alias("vec"))


_EMB = ("e0 AS (" + " UNION ALL ".join(
    f"SELECT vec_id*4+{k} vec_id, list_transform(range(1, len(embedding)+1), lambda i: embedding[i]::DOUBLE*(1+{s}*((i-1)%3-1))) x FROM embeddings WHERE vec_id % {m} = 0" for k, m, s in _COPIES)
    + "), e AS MATERIALIZED (SELECT vec_id, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda w: w*w)))) v FROM e0)")


def greedy_sql(name: str, frm: str) -> str:
    """CTEs that admit the rows (vec_id, v) of ``frm`` one by one in id order; ``name`` holds the admitted list."""
    return (f"{name}_o AS MATERIALIZED (SELECT a.vec_id, row_number() OVER (ORDER BY a.vec_id) rn, list(b.vec_id) FILTER (b.vec_id IS NOT NULL) nb FROM {frm} a "
            f"LEFT JOIN {frm} b ON b.vec_id < a.vec_id AND list_dot_product(a.v, b.v) >= {NEAR} GROUP BY 1), "
            f"{name}_g(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT i + 1, CASE WHEN len(list_intersect(kept, coalesce(nb, []))) > 0 THEN kept ELSE list_append(kept, vec_id) END "
            f"FROM {name}_g JOIN {name}_o ON rn = i + 1), {name} AS (SELECT unnest(kept) vec_id FROM {name}_g WHERE i = (SELECT count(*) FROM {name}_o))")


@query("near_duplicates", "J6", f"WITH {_EMB}, u AS (SELECT min(vec_id) vec_id, v FROM e GROUP BY v) SELECT a.vec_id FROM u a WHERE EXISTS (SELECT 1 FROM u b WHERE b.vec_id < a.vec_id AND list_dot_product(a.v, b.v) >= {NEAR})")
def near_duplicates(spark, sf):
    """Distinct vectors that resemble one with a lower id."""
    return N.repeats_of_lower(N.collapse(unit_vectors(spark, sf), "vec_id", "vec"), "vec_id", "vec", EMB_DIM, NEAR)


@query("novelty_rate", "L6 J6", f"""WITH {_EMB}, h AS (SELECT * FROM e WHERE vec_id % 2 = 0), c AS (SELECT * FROM e WHERE vec_id % 2 = 1),
d AS (SELECT c.vec_id FROM c WHERE EXISTS (SELECT 1 FROM h WHERE list_dot_product(c.v, h.v) >= {NEAR}))
SELECT (SELECT count(*) FROM c) n_total, (SELECT count(*) FROM c) - (SELECT count(*) FROM d) n_novel, round(1 - (SELECT count(*) FROM d)::DOUBLE/(SELECT count(*) FROM c), 6) novelty_rate""")
def novelty_rate(spark, sf):
    v = unit_vectors(spark, sf)
    c = v.where("vec_id % 2 = 1")
    seen = N.seen_before(c, v.where("vec_id % 2 = 0"), "vec_id", "vec", EMB_DIM, NEAR).withColumn("dup", F.lit(1))
    a = c.select("vec_id").join(seen, "vec_id", "left").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("dup").isNull()).alias("n_novel"))
    return a.select("n_total", "n_novel", rnd(F.col("n_novel") / F.col("n_total")).alias("novelty_rate"))


@query("fresh_pool", "L2 L3 C6", f"""WITH RECURSIVE {_EMB}, h AS (SELECT * FROM e WHERE vec_id % 5 = 0), c AS (SELECT * FROM e WHERE vec_id % 5 <> 0), f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE list_dot_product(c.v, h.v) >= {NEAR})),
{greedy_sql("gr", "f")} SELECT vec_id FROM gr""")
def fresh_pool(spark, sf):
    v = unit_vectors(spark, sf)
    return N.admit_batch(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), "vec_id", "vec", EMB_DIM, NEAR).select("vec_id")


@query("temporal_barrier", "L4", f"SELECT count(CASE WHEN ts <= TIMESTAMP '{max(dims.MODEL_CUTOFFS.values())}' THEN 1 END) n_stale, count(*) n_total, '{max(dims.MODEL_CUTOFFS.values())}' t_now, count(CASE WHEN ts <= TIMESTAMP '{max(dims.MODEL_CUTOFFS.values())}' THEN 1 END) = 0 ok FROM events".replace("count(CASE", "count(CASE"))
def temporal_barrier(spark, sf):
    cut = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in dims.MODEL_CUTOFFS.values()])).alias("cutoff"))
    b = N.barrier_check(cut.select(F.col("cutoff").cast("timestamp").alias("cutoff")), load(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts")), "ts")
    return b.select("n_stale", "n_total", F.date_format("t_now", "yyyy-MM-dd").alias("t_now"), "ok")


@query("memorisation_probe", "L5", f"""WITH {SCORE_SQL}, a AS (SELECT model, avg(CASE WHEN draw = 0 THEN smae END) f, avg(CASE WHEN draw > 0 THEN smae END) r FROM sc GROUP BY 1)
SELECT model, {R('f')} err_fresh, {R('r')} err_repeated, {R('(f-r)/f')} gap, (f-r)/f > 0.25 suspicious FROM a""")
def memorisation_probe(spark, sf):
    s = score_table(spark, sf).withColumn("cohort", F.when(F.col("draw") == 0, "fresh").otherwise("repeated"))
    m = N.memorisation_gap(s, "cohort")
    return m.select("model", *[rnd(F.col(c)).alias(c) for c in ("err_fresh", "err_repeated", "gap")], "suspicious")
