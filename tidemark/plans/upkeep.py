"""Audit, pool report, monitoring and publishing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.operators import catalog as C, forecast as M, monitor as O, publish as P, scoring as S, significance as E
from tidemark.operators.bounded import running_total
from tidemark.plans.board import _M as _FREQ_M, CH_SQL, REL_SQL, SCORE_SQL, challenge_table, metrics_sql, score_table
from tidemark.plans.curation import _CAT, CAT_SQL, catalog, live_catalog
from tidemark.plans.gate_checks import PARROT_SQL
from tidemark.plans.views import R, load, rnd
from tidemark.registry import query
from tidemark.session import scratch_path
from tidemark.sources import lake as L

TODAY = "2001-11-01"
NOW = TODAY + " 00:00:00"
# what each supplier's feed stored: one row per line item, stamps spelled per supplier
_OBS_SQL = """ob AS (SELECT s_name source_id, CAST(l_shipdate AS DATE) d, CASE WHEN s_suppkey % 23 = 0 THEN NULL WHEN s_suppkey % 19 = 0 THEN l_shipdate + INTERVAL 400 YEAR ELSE l_shipdate END t,
 CASE WHEN s_suppkey % 6 = 0 AND l_linenumber % 2 = 0 THEN NULL ELSE l_extendedprice END v, l_orderkey*10 + l_linenumber seq FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 12 <> 11)"""


def stored(spark, sf):
    li, s = load(spark, sf, "lineitem"), load(spark, sf, "supplier").where("s_suppkey % 12 <> 11")
    j = li.join(s, li.l_suppkey == s.s_suppkey)
    return j.selectExpr(
        "s_name AS source_id", "CAST(l_shipdate AS DATE) AS scrape_date",
        "CASE WHEN s_suppkey % 23 = 0 THEN concat('batch ', l_orderkey) WHEN s_suppkey % 19 = 0 THEN date_format(l_shipdate + INTERVAL 400 YEARS, 'yyyy-MM-dd') "
        "WHEN s_suppkey % 3 = 1 THEN date_format(l_shipdate, 'yyyyMMdd') ELSE date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END AS timestamp",
        "if(s_suppkey % 6 = 0 AND l_linenumber % 2 = 0, 'n/a', CAST(l_extendedprice AS STRING)) AS value", "l_orderkey * 10 + l_linenumber AS seq")


def full_catalog(spark, sf):
    return catalog(spark, sf).selectExpr("*", "CAST(CASE WHEN seq % 4 = 1 THEN 2 END AS DOUBLE) AS audit_slack_days", "CAST(NULL AS DOUBLE) AS forecast_horizon_days",
                                         "CASE WHEN seq % 9 = 0 THEN 'PT6H' END AS poll", "seq % 5 AS window_days", "CASE seq % 3 WHEN 0 THEN 'now()' WHEN 1 THEN 'data[].t' END AS timestamp_field")


_LIM = "CASE frequency WHEN 'P1D' THEN 8 WHEN 'P1W' THEN 35 WHEN 'P1M' THEN 100 WHEN 'irregular' THEN 45 ELSE 3 END"
_AUDIT = f"""{CAT_SQL}, {_OBS_SQL}, ls AS (SELECT ob.* FROM ob JOIN (SELECT source_id, max(d) d FROM ob GROUP BY 1) USING (source_id, d)),
pr AS (SELECT source_id, count(*) n, max(CASE WHEN t <= TIMESTAMP '{NOW}' + INTERVAL 14 DAY THEN t END) newest, max(t) raw, count(v)::DOUBLE/count(*) nf FROM ls GROUP BY 1),
au AS (SELECT cat0.source_id, disabled, n, newest, raw, nf, (epoch(TIMESTAMP '{NOW}') - epoch(newest))/86400.0 age, CAST(CASE WHEN seq % 4 = 1 THEN 2 ELSE {_LIM} END AS DOUBLE) lim FROM cat0 LEFT JOIN pr USING (source_id)),
st2a AS (SELECT *, CASE WHEN disabled THEN 'disabled' WHEN n IS NULL THEN 'nodata' WHEN newest IS NULL AND raw IS NOT NULL THEN 'future' WHEN newest IS NULL THEN 'unparsed' WHEN age > lim THEN 'stale' ELSE 'ok' END status FROM au)"""


@query("freshness_audit", "G20 F11", f"WITH {_AUDIT} SELECT source_id, status, n AS n_rows, {R('age', 3)} age_days, {R('lim', 3)} limit_days, {R('nf')} numeric_frac FROM st2a")
def freshness_audit(spark, sf):
    a = O.freshness_audit(full_catalog(spark, sf), stored(spark, sf), NOW)
    return a.select("source_id", "status", F.col("rows").alias("n_rows"), *[rnd(F.col(c), d).alias(c) for c, d in (("age_days", 3), ("limit_days", 3), ("numeric_frac", 6))])


@query("auto_disable", "Q8", f"WITH {_AUDIT} SELECT source_id, disabled OR coalesce(status = 'stale' AND round(age, 1) > 3*round(lim, 1), false) AS disabled FROM st2a")
def auto_disable(spark, sf):
    return O.auto_disable(O.freshness_audit(full_catalog(spark, sf), stored(spark, sf), NOW)).select("source_id", F.coalesce("disabled", F.lit(False)).alias("disabled"))


@query("numeric_fraction", "G21", f"""WITH {_OBS_SQL} SELECT source_id, {R('count(v)::DOUBLE/count(*)')} numeric_frac, count(*) n_head FROM ob GROUP BY 1""")
def numeric_fraction(spark, sf):
    return O.numeric_fraction(stored(spark, sf), ["source_id"], "seq", ["value"]).withColumn("numeric_frac", rnd(F.col("numeric_frac")))


@query("silence_check", "W13 O3 U3", f"""WITH {CAT_SQL}, {_OBS_SQL}, l AS (SELECT source_id, max(d) ld FROM ob GROUP BY 1),
a AS (SELECT cat.source_id, date_diff('day', ld, DATE '{TODAY}') dd, CASE WHEN seq % 9 = 0 THEN 1 ELSE CASE frequency WHEN 'P1W' THEN 7 WHEN 'P1M' THEN 30 ELSE 1 END END allow FROM cat LEFT JOIN l USING (source_id))
SELECT source_id, CAST(dd AS INT) "days", CASE WHEN dd IS NULL THEN 'never' WHEN dd > allow THEN 'behind' ELSE 'writing' END status FROM a""")
def silence_check(spark, sf):
    return O.silence(full_catalog(spark, sf), stored(spark, sf), TODAY).select("source_id", "days", "status")


@query("due_sources", "O5", f"""WITH {CAT_SQL}, {_OBS_SQL}, l AS (SELECT source_id, max(d) d FROM ob GROUP BY 1), a AS (SELECT cat.source_id, seq, CAST(epoch(TIMESTAMP '{NOW}') - epoch(CAST(d AS TIMESTAMP)) AS BIGINT) age, frequency LIKE 'P%' AND frequency NOT LIKE 'PT%' slow, CASE WHEN seq % 2 = 0 THEN 7200 END tried FROM cat LEFT JOIN l USING (source_id))
SELECT source_id, CASE WHEN seq % 9 = 0 THEN coalesce(least(age, tried) >= 21600, true) WHEN age IS NULL THEN true WHEN slow THEN age >= 21600 WHEN seq % 5 >= 1 THEN age >= 3600 ELSE true END due, {R('age')} age_s FROM a""")
def due_sources(spark, sf):
    """Feeds last seen long ago; of those with a poll period of six hours, every other one was tried two hours ago."""
    seen = stored(spark, sf).groupBy("source_id").agg(F.max(F.to_timestamp("scrape_date")).alias("last_seen"))
    live = full_catalog(spark, sf).where("NOT disabled")
    last = live.select("source_id", F.expr(f"CASE WHEN seq % 2 = 0 THEN TIMESTAMP'{NOW}' - INTERVAL 2 HOURS END").alias("last_attempt")).join(seen, "source_id", "left")
    d = O.due_sources(live, last, NOW)
    return d.select("source_id", "due", rnd(F.col("age_s")).alias("age_s"))


@query("undersampled_feeds", "O4", f"""WITH {CAT_SQL} SELECT source_id, frequency FROM cat WHERE frequency IN ('PT30S', 'PT10S', 'PT5M') AND seq % 3 <> 1 AND seq % 16 <> 0""")
def undersampled_feeds(spark, sf):
    c = full_catalog(spark, sf)
    return O.undersampled(c, c.where("seq % 16 = 0").select("source_id")).select("source_id", "frequency")


@query("pool_report", "G19 J2 U3", f"""WITH {CAT_SQL}, n AS (SELECT s_name source_id, l_returnflag p, count(*) n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 12 <> 11 GROUP BY 1,2 HAVING count(*) >= 200),
j AS (SELECT cat."domain", cadence, source_id, p FROM cat LEFT JOIN n USING (source_id))
SELECT "domain", cadence, count(p) n_series, count(DISTINCT CASE WHEN p IS NOT NULL THEN source_id END) n_sources, count(CASE WHEN p IS NULL THEN 1 END) n_ineligible FROM j GROUP BY 1,2""")
def pool_report(spark, sf):
    """Eligible series and sources per domain x band, and live sources without any."""
    li, s = load(spark, sf, "lineitem"), load(spark, sf, "supplier").where("s_suppkey % 12 <> 11")
    rows = li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("s_name").alias("source_id"), F.col("l_returnflag").alias("_panel_flag"))
    idx = L.series_index(rows, 200).groupBy("source_id").agg(F.count(F.lit(1)).alias("k"))
    j = live_catalog(spark, sf).select("source_id", "domain", "cadence").join(idx, "source_id", "left")
    return j.groupBy("domain", "cadence").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_series"), F.count("k").alias("n_sources"), F.count_if(F.col("k").isNull()).alias("n_ineligible"))


@query("pool_totals", "G19", f"""WITH {CAT_SQL}, n AS (SELECT s_name source_id, l_returnflag p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 12 <> 11 GROUP BY 1,2 HAVING count(*) >= 200),
j AS (SELECT cat."domain", cadence, source_id, p FROM cat LEFT JOIN n USING (source_id)), c AS (SELECT "domain", cadence, count(*) k FROM j WHERE p IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, 1.0/count(*) OVER ()/1.0 share FROM c)
SELECT "domain", cadence, {R('share')} draw_share, k cell_series, (SELECT count(DISTINCT source_id) FROM j) live_sources, (SELECT count(DISTINCT source_id) FROM j WHERE p IS NOT NULL) eligible_sources,
 (SELECT count(DISTINCT source_id) FROM j WHERE p IS NULL) ineligible_sources, (SELECT count(p) FROM j) eligible_series, (SELECT count(*) FROM c) cells FROM w""")
def pool_totals(spark, sf):
    """Totals of the pool beside the mix that equal weights of the eligible cells draw on average."""
    li, s = load(spark, sf, "lineitem"), load(spark, sf, "supplier").where("s_suppkey % 12 <> 11")
    rows = li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("s_name").alias("source_id"), F.col("l_returnflag").alias("_panel_flag"))
    idx = L.series_index(rows, 200).groupBy("source_id").agg(F.count(F.lit(1)).alias("k"))
    mix, totals = C.pool_mix(live_catalog(spark, sf).select("source_id", "domain", "cadence").join(idx, "source_id", "left"), ["domain", "cadence"], "source_id", "k")
    return mix.join(F.broadcast(totals)).withColumn("draw_share", rnd(F.col("draw_share")))  # one row of totals


@query("depth_backlog", "J2", f"""WITH {CAT_SQL}, n AS (SELECT DISTINCT s_name source_id FROM (SELECT l_suppkey, l_returnflag FROM lineitem GROUP BY 1,2 HAVING count(*) >= 200) JOIN supplier ON l_suppkey = s_suppkey) SELECT source_id FROM cat WHERE source_id NOT IN (SELECT source_id FROM n)""")
def depth_backlog(spark, sf):
    li, s = load(spark, sf, "lineitem"), load(spark, sf, "supplier")
    deep = li.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).where("n >= 200").select("l_suppkey").distinct()
    ids = deep.join(s, deep.l_suppkey == s.s_suppkey).select(F.col("s_name").alias("source_id"))
    return live_catalog(spark, sf).select("source_id").join(ids, "source_id", "left_anti")


# ------------------------------------------------------------------- logs
_JOBS = "SELECT event_type job, CASE event_type WHEN 'click' THEN 60 WHEN 'view' THEN 900 WHEN 'error' THEN 86400 ELSE 300 END period_s FROM events GROUP BY 1 UNION ALL SELECT 'ghost', 60"


@query("heartbeats", "O1", f"""WITH j AS ({_JOBS}), l AS (SELECT event_type job, max(ts) t FROM events GROUP BY 1), a AS (SELECT j.*, greatest(0, epoch(TIMESTAMP '2024-01-31') - floor(epoch(t))) age FROM j LEFT JOIN l USING (job))
SELECT job, {R('age', 1)} age_s, CASE WHEN age IS NULL OR NOT EXISTS (SELECT 1 FROM l WHERE l.job = a.job) THEN 'missing' WHEN age > period_s + least(period_s, 3600) THEN 'late' ELSE 'ok' END status FROM a""".replace("greatest(0, epoch(TIMESTAMP '2024-01-31') - floor(epoch(t)))", "CASE WHEN t IS NOT NULL THEN greatest(0, epoch(TIMESTAMP '2024-01-31') - floor(epoch(t))) ELSE 0 END"))
def heartbeats(spark, sf):
    e = load(spark, sf, "events")
    runs = e.select(F.col("event_type").alias("job"), F.col("ts").cast("timestamp").alias("at"))
    jobs = runs.select("job").distinct().unionByName(spark.range(1).select(F.lit("ghost").alias("job"))).withColumn(
        "period_s", F.expr("CASE job WHEN 'click' THEN 60 WHEN 'view' THEN 900 WHEN 'error' THEN 86400 WHEN 'ghost' THEN 60 ELSE 300 END"))
    return O.heartbeats(runs, jobs, "2024-01-31 00:00:00").select("job", rnd(F.col("age_s"), 1).alias("age_s"), "status")


def sweep_log(spark, sf):
    return load(spark, sf, "events").selectExpr(
        "event_type AS log", "event_id AS line_no", "if(event_id % 5 = 4, concat('debug line ', event_id), concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',123 INFO sweep finished: ', user_id, ' ok, ', event_id % 3, ' failed, ', "
        "if(event_type = 'error', event_id % 7 + 1, event_id % 7), ' skipped of ', user_id + 10, ' in ', value, 's')) AS line")


@query("sweep_log", "O2", """WITH s AS (SELECT event_type log, ts, event_id, event_id % 3 failed, CASE WHEN event_type = 'error' THEN event_id % 7 + 1 ELSE event_id % 7 END sk FROM events WHERE event_id % 5 <> 4 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('second', ts) DESC, event_id DESC) <= 8)
SELECT log, count(*) seen, count(CASE WHEN sk > 0 THEN 1 END) skipping, CAST(arg_max(sk, (date_trunc('second', ts), event_id)) AS BIGINT) skipped_last, CAST(arg_max(failed, (date_trunc('second', ts), event_id)) AS BIGINT) failed_last, count(CASE WHEN sk > 0 THEN 1 END) = count(*) AND count(*) > 2 chronic FROM s GROUP BY 1""")
def sweep_log_query(spark, sf):
    return O.recent_sweeps(O.parse_sweeps(sweep_log(spark, sf), "line", "log", "line_no"), ["log"], "line_no")


def error_log(spark, sf):
    return load(spark, sf, "events").where("event_type = 'error'").selectExpr(
        "concat('src', user_id) AS source_id", "concat('host', user_id % 6) AS host",
        "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), ' ', CASE event_id % 3 WHEN 0 THEN 'FETCH' WHEN 1 THEN 'PARSE' ELSE 'UNCAUGHT' END, ' ', CASE event_id % 4 WHEN 0 THEN concat('HTTP ', 500 + user_id % 4, ': busy') WHEN 1 THEN 'Read timed out' ELSE concat('ValueError: ', event_id) END) AS line")


_ERR = """er AS (SELECT concat('src', user_id) s, concat('host', user_id % 6) h, concat(CASE event_id % 3 WHEN 0 THEN 'FETCH' WHEN 1 THEN 'PARSE' ELSE 'UNCAUGHT' END, ' ', CASE event_id % 4 WHEN 0 THEN concat('HTTP ', 500 + user_id % 4) WHEN 1 THEN 'timeout' ELSE 'ValueError' END) w
 FROM events WHERE event_type = 'error' AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10'),
ru AS (SELECT 'host' axis, h "label", count(*) errors, count(DISTINCT s) sources FROM er GROUP BY 2 UNION ALL SELECT 'source', s, count(*), 1 FROM er GROUP BY 2 UNION ALL SELECT 'reason', w, count(*), count(DISTINCT s) FROM er GROUP BY 2)"""


@query("failure_rollup", "G26 O3", f"WITH {_ERR} SELECT axis, \"label\", errors, sources::BIGINT sources FROM ru")
def failure_rollup(spark, sf):
    return O.failure_rollup(O.parse_errors(error_log(spark, sf), "line", "source_id", "host"), "2024-01-10 00:00:00").withColumn("sources", F.col("sources").cast("bigint"))


@query("ranked_findings", "O6", f"""WITH {_ERR}, f AS (SELECT 'warn' severity, 'failures' "check", concat("label", ': ', errors, ' errors') detail FROM ru WHERE axis = 'host' AND errors >= 20),
l AS (SELECT event_type job, max(ts) t FROM events GROUP BY 1), h AS (SELECT 'critical' severity, 'heartbeat' "check", job || ': late' detail FROM l WHERE epoch(TIMESTAMP '2024-01-31') - floor(epoch(t)) > CASE job WHEN 'click' THEN 120 WHEN 'view' THEN 1800 WHEN 'error' THEN 90000 ELSE 600 END
 UNION ALL SELECT 'critical', 'heartbeat', 'ghost: missing') SELECT *, 'critical' overall FROM (SELECT * FROM f UNION ALL SELECT * FROM h)""")
def ranked_findings(spark, sf):
    roll = O.culprit_hosts(O.failure_rollup(O.parse_errors(error_log(spark, sf), "line", "source_id", "host"), "2024-01-10 00:00:00"))
    f = roll.select(F.lit("warn").alias("severity"), F.lit("failures").alias("check"), F.concat("label", F.lit(": "), "errors", F.lit(" errors")).alias("detail"))
    hb = heartbeats(spark, sf).where("status <> 'ok'").select(F.lit("critical").alias("severity"), F.lit("heartbeat").alias("check"), F.concat_ws(": ", "job", "status").alias("detail"))
    found = O.findings(f, hb)
    return found.join(F.broadcast(O.overall_status(found).select(F.col("status").alias("overall"))))


@query("producer_yield", "G31 O7", """WITH s AS (SELECT concat('v', user_id % 12) producer, round(sum("value"), 4) secs, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) found, count(CASE WHEN event_type = 'purchase' AND user_id % 12 <> 3 THEN 1 END) wired, count(*) runs FROM events GROUP BY 1)
SELECT producer, found, wired, runs, round(60*wired/secs, 6) per_minute, CASE WHEN secs < 1800 THEN NULL WHEN wired = 0 THEN 'no yield' WHEN secs/wired > 1800 THEN 'too slow' END benched FROM s""")
def producer_yield(spark, sf):
    r = load(spark, sf, "events").selectExpr("concat('v', user_id % 12) AS producer", "value AS seconds", "CAST(get_json_object(props, '$.k') AS BIGINT) AS found",
                                            "if(event_type = 'purchase' AND user_id % 12 <> 3, 1, 0) AS wired")
    return O.producer_stats(r).select("producer", "found", "wired", "runs", rnd(F.col("per_minute")).alias("per_minute"), "benched")


# ------------------------------------------------------------------- publishing
def draw_boards(spark, sf):
    s = score_table(spark, sf)
    from pyspark.sql import Window
    per = s.groupBy("draw", "model", "source_id").agg(*S.metric_sums()).select("*", (F.col("mase_sum") / F.col("wsum")).alias("m"), (F.col("crps_sum") / F.col("wsum")).alias("c"))
    w = Window.partitionBy("draw", "source_id")
    base = lambda c: F.max(F.when(F.col("model") == "seasonal_naive", F.col(c))).over(w)
    per = per.select("*", (F.col("m") / F.greatest(base("m"), F.lit(dims.EPS))).alias("mr"), (F.col("c") / F.greatest(base("c"), F.lit(dims.EPS))).alias("cr"))
    b = per.groupBy("draw", "model").agg(S.shifted_gmean(F.col("mr"), F.col("wsum")).alias("mase_rel"), S.shifted_gmean(F.col("cr"), F.col("wsum")).alias("crps_rel"),
                                         (F.sum("mase_sum") / F.sum("wsum")).alias("mase"), (F.sum("crps_sum") / F.sum("wsum")).alias("crps"))
    b = b.select(F.concat(F.lit("r"), "draw").alias("round_id"), "model", *[rnd(F.col(c)).alias(c) for c in ("mase_rel", "crps_rel", "mase", "crps")])
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("round_id").orderBy("crps_rel", "model")))


_BOARDS = f"""{SCORE_SQL}, dp AS (SELECT draw, model, source_id, sum(weight*mase) ms, sum(weight*crps) cs, sum(weight) w FROM sc GROUP BY 1,2,3),
dr8 AS (SELECT a.draw, a.model, a.w, a.ms, a.cs, (a.ms/a.w)/greatest(b.ms/b.w,1e-8) mr, (a.cs/a.w)/greatest(b.cs/b.w,1e-8) cr FROM dp a JOIN dp b ON a.draw=b.draw AND a.source_id=b.source_id AND b.model='seasonal_naive'),
bo AS (SELECT concat('r', draw) round_id, model, {R('exp(sum(w*ln(mr+1e-5))/sum(w))-1e-5')} mase_rel, {R('exp(sum(w*ln(cr+1e-5))/sum(w))-1e-5')} crps_rel, {R('sum(ms)/sum(w)')} mase, {R('sum(cs)/sum(w)')} crps FROM dr8 GROUP BY 1,2),
br8 AS (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY crps_rel, model) rk FROM bo)"""


@query("round_history", "A18 E10", f"""WITH {_BOARDS} SELECT round_id, string_agg(model, ',' ORDER BY model) models, string_agg(CAST(rk AS VARCHAR), ',' ORDER BY model) ranks FROM br8 GROUP BY 1""")
def round_history(spark, sf):
    h = P.round_history(draw_boards(spark, sf))
    return h.select("round_id", F.array_join("models", ",").alias("models"), F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",").alias("ranks"))


@query("round_index", "A18", f"""WITH {_BOARDS} SELECT round_id, string_agg(CASE WHEN rk <= 3 THEN model END, ',' ORDER BY rk) top, count(*) n_models FROM br8 GROUP BY 1""")
def round_index(spark, sf):
    return P.round_index(draw_boards(spark, sf)).withColumn("top", F.array_join("top", ","))


@query("round_documents", "A18", f"""WITH {_BOARDS} SELECT round_id, 1::BIGINT schema_version, count(*)::INT n_models, min(CASE WHEN rk = 1 THEN model END) leader FROM br8 GROUP BY 1""")
def round_documents(spark, sf):
    """Documents are written as JSON lines and read back, as a site would fetch them."""
    path = scratch_path(spark, "rounds")
    P.round_documents(draw_boards(spark, sf)).select("document").write.text(path)
    return spark.read.json(path).select("round_id", "schema_version", F.size("leaderboard").alias("n_models"), F.col("leaderboard")[0]["model"].alias("leader"))


@query("merged_blocks", "A19 U4", f"WITH {SCORE_SQL} SELECT model, challenge_id, CASE WHEN model = 'seasonal_naive' OR model = 'drift' THEN 0 ELSE 1 END::BIGINT block, {R('crps')} crps FROM sc")
def merged_blocks(spark, sf):
    from tidemark.session import freeze
    s = freeze(score_table(spark, sf).select("model", "challenge_id", "source_id", "crps"))
    b0 = s.where("model IN ('seasonal_naive', 'drift')").withColumn("block", F.lit(0))
    b1 = s.where("model <> 'drift'").withColumn("block", F.lit(1))
    return P.merge_blocks(b0.unionByName(b1)).select("model", "challenge_id", F.col("block").cast("bigint").alias("block"), rnd(F.col("crps")).alias("crps"))


@query("report_table", "G28 A20", f"""WITH {SCORE_SQL}, m AS ({metrics_sql('model, draw')}), v AS (SELECT model, draw, mase, CASE WHEN draw = 2 THEN NULL ELSE crps END crps FROM m)
SELECT model, {R('avg(mase)')} mase_mean, {R('stddev_samp(mase)')} mase_std, {R('avg(crps)')} crps_mean, {R('stddev_samp(crps)')} crps_std, count(*) n_runs FROM v GROUP BY 1""")
def report_table(spark, sf):
    runs = S.metrics_by(score_table(spark, sf), "model", "draw").withColumn("crps", F.when(F.col("draw") == 2, float("nan")).otherwise(F.col("crps")))
    path = scratch_path(spark, "report")
    P.write_report(P.report_table(runs, ["model"], ["mase", "crps"]), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("model", *[rnd(F.col(c)).alias(c) for c in ("mase_mean", "mase_std", "crps_mean", "crps_std")], F.col("n_runs").cast("bigint").alias("n_runs"))


@query("model_intersection", "U5", "SELECT DISTINCT p_brand model FROM part WHERE p_size < 4 INTERSECT SELECT DISTINCT p_brand FROM part WHERE p_retailprice > 915")
def model_intersection(spark, sf):
    p = load(spark, sf, "part")
    return p.where("p_size < 4").select(F.col("p_brand").alias("model")).intersect(p.where("p_retailprice > 915").select("p_brand"))


@query("snapshot_diff", "A21")
def snapshot_diff(spark, sf):
    """Which table files a mirror still needs: the mirror's listing misses some and has others at another size."""
    local = L.file_listing(spark, sf)
    remote = local.where("key <> 'nation.parquet'").withColumn("length", F.when(F.col("key") == "orders.parquet", F.col("length") - 1).otherwise(F.col("length")))
    return L.snapshot_diff(local, remote)


@query("forecast_intake", "M12", f"""WITH {SCORE_SQL} SELECT model, count(*) n_valid, false AS missing FROM sc WHERE NOT (model = 'drift') AND NOT (model = 'ewma' AND draw = 1) GROUP BY 1 UNION ALL SELECT 'drift', 0, true""")
def forecast_intake(spark, sf):
    """External forecasts: drift arrives one step short everywhere, ewma lacks its median in one draw."""
    ch = challenge_table(spark, sf)
    fc = M.gaussian_band(M.column_forecasts(ch))
    fc = fc.withColumn("mean", F.expr("if(model = 'drift', slice(mean, 1, horizon - 1), mean)"))
    fc = fc.withColumn("q", F.expr("if(model = 'ewma' AND draw = 1, filter(q, e -> e.level <> 0.5D), q)")).select("model", "challenge_id", "mean", "q")
    good, missing = P.forecast_validation(fc, ch)
    ok = good.groupBy("model").agg(F.count(F.lit(1)).alias("n_valid")).withColumn("missing", F.lit(False))
    return ok.unionByName(missing.select("model", F.lit(0).cast("bigint").alias("n_valid"), F.lit(True).alias("missing")))


# the two decomposition models, the seven candidates and the backtest over shorter contexts (v = 1, 2), one row per step
_SUMS = "list_sum(list_transform({x}, lambda q: q*q))"
PANEL_SQL = f"""
pv AS (SELECT challenge_id, 0 v, context, horizon, freq, NULL::DOUBLE[] held FROM ch
 UNION ALL SELECT challenge_id, 1, context[1:len(context)-horizon], horizon, freq, context[len(context)-horizon+1:] FROM ch WHERE len(context)-horizon >= horizon+8
 UNION ALL SELECT challenge_id, 2, context[1:e-horizon], horizon, freq, context[e-horizon+1:e] FROM (SELECT *, len(context)-horizon//2 e FROM ch) WHERE len(context)-horizon > 2*horizon+8 AND e-horizon >= horizon+8),
d0 AS (SELECT *, len(context) n, list_avg(context) mu, (len(context)-1)/2.0::DOUBLE mid, {_FREQ_M} m0 FROM pv),
d1 AS (SELECT *, list_transform(context, lambda q: q-mu) x, list_sum(list_transform(range(1, n+1), lambda i: (i-1-mid)*(context[i]-mu)))/(n*(n*n-1.0::DOUBLE)/12) b FROM d0),
d2 AS (SELECT *, list_transform(range(1, n+1), lambda i: x[i]-b*(i-1-mid)) r FROM d1),
ca AS (SELECT challenge_id, v, kind, p, ord, list_sum(list_transform(range(1, n-p+1), lambda i: y[i]*y[i+p]))/s rr FROM (
 SELECT challenge_id, v, n, m0, kind, y, s, unnest([12, 24, 36, m0]) p, unnest([1, 2, 3, 4]) ord FROM (
  SELECT challenge_id, v, n, m0, 'r' kind, r y, {_SUMS.format(x="r")} s FROM d2 UNION ALL SELECT challenge_id, v, n, m0, 'x', x, {_SUMS.format(x="x")} FROM d2))
 WHERE p >= 2 AND p < n AND s > 1e-8 AND (ord < 4 OR m0 NOT IN (12, 24, 36))),
bp AS (SELECT challenge_id, v, kind, p FROM ca WHERE rr > 0.2 QUALIFY row_number() OVER (PARTITION BY challenge_id, v, kind ORDER BY rr DESC, ord) = 1),
d4 AS (SELECT d2.*, coalesce(a.p, 0) rp, coalesce(c.p, 0) xp FROM d2 LEFT JOIN bp a ON a.challenge_id = d2.challenge_id AND a.v = d2.v AND a.kind = 'r'
 LEFT JOIN bp c ON c.challenge_id = d2.challenge_id AND c.v = d2.v AND c.kind = 'x'),
d5 AS (SELECT *, CASE WHEN rp < 2 THEN [0.0::DOUBLE] ELSE list_transform(range(0, rp), lambda k: list_avg(list_transform(range(k+1, n+1, rp), lambda i: r[i]))) END p0 FROM d4),
d6 AS (SELECT *, list_transform(p0, lambda q: q-list_avg(p0)) pr, len(p0) pl FROM d5),
d7 AS (SELECT *, list_transform(range(1, n+1), lambda i: r[i]-pr[(i-1)%pl+1]) l0, list_transform(range(1, n+1), lambda i: context[i]-pr[(i-1)%pl+1]) lv,
 least(greatest(CASE WHEN rp >= 2 THEN 2*rp ELSE 24 END, 12), n-1) k FROM d6),
d8 AS (SELECT *, list_transform(l0, lambda q: q-list_avg(l0)) lo FROM d7),
d9 AS (SELECT *, {_SUMS.format(x="lo")}-lo[n]*lo[n] hd, list_sum(list_transform(range(1, n), lambda i: lo[i]*lo[i+1])) lg,
 list_avg(list_transform(range(1, n), lambda i: abs(context[i+1]-context[i]))) st1, list_reduce(context, lambda a, q: 0.7::DOUBLE*a+0.3::DOUBLE*q) ew FROM d8),
da AS MATERIALIZED (SELECT *, CASE WHEN hd <= 1e-8 THEN 0 ELSE greatest(-0.99, least(0.99, lg/hd)) END ph,
 CASE WHEN st1 > 1e-8 THEN st1 ELSE list_stddev_pop(context)+1e-8 END sg FROM d9),
dh AS (SELECT *, unnest(range(1, horizon+1)) h, 0.9::DOUBLE dq FROM da),
pm AS MATERIALIZED (SELECT challenge_id, v, h, held, sg, 'hw_ar' model, 1 ord, lv[n]+(lv[n]-lv[n-k])/k*(dq*(1-pow(dq, h))/(1-dq))+pr[(n-1+h)%pl+1] point FROM dh
 UNION ALL SELECT challenge_id, v, h, held, sg, 'decomp', 2, mu+b*(n-1+h-mid)+pr[(n-1+h)%pl+1]+lo[n]*pow(ph, h) FROM dh
 UNION ALL SELECT challenge_id, v, h, held, sg, 'naive', 3, context[n] FROM dh
 UNION ALL SELECT challenge_id, v, h, held, sg, 'drift', 4, context[n]+(context[n]-context[1])/greatest(n-1, 1)*h FROM dh
 UNION ALL SELECT challenge_id, v, h, held, sg, 'damped', 5, context[n]+(context[n]-context[n-least(12, n-1)])/least(12, n-1)*(dq*(1-pow(dq, h))/(1-dq)) FROM dh
 UNION ALL SELECT challenge_id, v, h, held, sg, 'ewma', 6, ew FROM dh
 UNION ALL SELECT challenge_id, v, h, held, sg, 'seasonal', 7, CASE WHEN xp < 2 THEN context[n] ELSE context[n-xp+((h-1)%xp)+1] END FROM dh),
lo1 AS (SELECT challenge_id, v, model, ord, avg(abs(point-held[h]))/any_value(sg) l FROM pm WHERE v > 0 GROUP BY ALL),
cho AS (SELECT challenge_id, model FROM (SELECT challenge_id, model, ord, sum(l) l FROM lo1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY challenge_id ORDER BY l, ord) = 1),
px AS (SELECT challenge_id, h, model, point FROM pm WHERE v = 0 AND model IN ('hw_ar', 'decomp')
 UNION ALL SELECT pm.challenge_id, h, 'strong', point FROM pm LEFT JOIN cho ON cho.challenge_id = pm.challenge_id WHERE v = 0 AND pm.model = coalesce(cho.model, 'hw_ar')
 UNION ALL SELECT challenge_id, step, 'context_parrot', point FROM pf)"""
PANEL_SCORE_SQL = SCORE_SQL.replace("fc AS MATERIALIZED", "fc0 AS MATERIALIZED").replace(",\nfq AS", f""", {PARROT_SQL}, {PANEL_SQL},
fc AS (SELECT * FROM fc0 UNION ALL SELECT model, st.challenge_id, draw, source_id, series_key, "domain", dgp_class, cadence, st.horizon, unseen_frac, sigma0, "scale", h, truth[h], point
 FROM px JOIN st USING (challenge_id)),\nfq AS""")


@query("panel_batch_forecasts", "M6 M7 M8 M9 M11", f"""WITH {PANEL_SCORE_SQL}, {REL_SQL}, met AS ({metrics_sql('model')})
SELECT model, CAST(row_number() OVER (ORDER BY round(mase_rel, 9), model) AS INT) "rank", {R('mase_rel')} mase_rel, {R('crps_rel')} crps_rel, {R('mase')} mase, {R('crps')} crps FROM met JOIN gm USING (model)""")
def panel_batch_forecasts(spark, sf):
    """The whole panel over every challenge: column, decomposition, matching and backtest-selected models."""
    b = S.leaderboard(S.contributions(M.gaussian_band(M.panel_forecasts(challenge_table(spark, sf)))))
    return b.select("model", F.col("rank").cast("int").alias("rank"), *[rnd(F.col(c)).alias(c) for c in ("mase_rel", "crps_rel", "mase", "crps")])


@query("user_forecaster", "V1 V2", f"""WITH {CH_SQL} SELECT challenge_id, {R('list_max(context)')} level FROM ch""")
def user_forecaster(spark, sf):
    """A user's model over Arrow batches: here the highest value of the context, held flat."""
    def ceiling(context, horizon, cands):
        return [context.max()] * horizon

    f = M.batch_forecasts(challenge_table(spark, sf), {"ceiling": ceiling})
    return f.select("challenge_id", rnd(F.element_at("mean", -1)).alias("level"))


@query("comparison_run", "E10")
def comparison_run(spark, sf):
    """End to end: challenges, panel, paired tests against the floor, one row per model."""
    from tidemark.session import freeze
    ch = challenge_table(spark, sf)
    fc = M.panel_forecasts(ch).where(~F.col("model").isin(*M.DECOMPOSED_PATHS))
    s = freeze(S.contributions(M.gaussian_band(fc)))
    vs = E.compare_to_baseline(s).select(F.col("model_a").alias("model"), "median_diff", "win_rate", "wilcoxon_p_holm", "significant")
    board = S.leaderboard(s, "crps", dims.EPS_REL).select("model", "rank", "crps_rel", "mase_rel")
    f = E.friedman(s).select(rnd(F.col("statistic"), 3).alias("friedman"), "p_value")
    return board.join(vs, "model", "left").join(F.broadcast(f))
