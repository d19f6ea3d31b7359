"""Lake, index, gap, window and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform_sql
from tidemark.operators import clean as K, series as Q
from tidemark.plans.views import BINS_SQL, R, load, rnd, series_bins
from tidemark.functions import timeparse as T
from tidemark.registry import query
from tidemark.session import scratch_path
from tidemark.sources import lake as L

NOW = "2024-02-01 00:00:00"


def observations(spark, sf):
    """Hour-stamped event reports; every third event is re-reported the next day with a corrected value."""
    e = load(spark, sf, "events").select(
        F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("_panel_user"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:00:00").alias("timestamp"), F.col("value").cast("string").alias("value"),
        F.to_date("ts").alias("scrape_date"), F.col("event_id").alias("seq"))
    again = e.where("seq % 3 = 0").withColumn("value", F.expr("CAST(CAST(value AS DOUBLE) + 1 AS STRING)")).withColumn("scrape_date", F.date_add("scrape_date", 1))
    bulk = load(spark, sf, "supplier").select(
        F.lit("bulk_once").alias("source_id"), F.col("s_nationkey").cast("string").alias("_panel_user"), F.lit("2024-01-15T00:00:00").alias("timestamp"),
        F.col("s_acctbal").cast("string").alias("value"), F.lit("2024-01-15").cast("date").alias("scrape_date"), F.col("s_suppkey").alias("seq"))
    return e.unionByName(again).unionByName(bulk)


OBS_SQL = """obs0 AS (SELECT event_type source_id, CAST(user_id AS VARCHAR) u, strftime(ts, '%Y-%m-%dT%H:00:00') t, "value" v, CAST(ts AS DATE) d, event_id seq FROM events),
obs AS (SELECT * FROM obs0 UNION ALL SELECT source_id, u, t, v+1, d+1, seq FROM obs0 WHERE seq % 3 = 0
  UNION ALL SELECT 'bulk_once', CAST(s_nationkey AS VARCHAR), '2024-01-15T00:00:00', s_acctbal, DATE '2024-01-15', s_suppkey FROM supplier),
lww AS (SELECT * FROM obs WHERE source_id <> 'bulk_once' QUALIFY row_number() OVER (PARTITION BY source_id, u, t ORDER BY d DESC, seq DESC) = 1
  UNION ALL SELECT * FROM obs WHERE source_id = 'bulk_once')"""


@query("lake_round_trip", "A1 A2 A4 U1 U2 V3", f"""WITH {OBS_SQL} SELECT source_id, CAST(d AS VARCHAR) scrape_date, count(*) n, {R('sum(v)', 2)} total,
 count(CASE WHEN d >= DATE '2024-01-20' THEN u END) n_user FROM obs WHERE d >= DATE '2024-01-15' GROUP BY 1,2""")
def lake_round_trip(spark, sf):
    """Write two drifting batches (the second adds the panel column), re-append one, read back with pruning."""
    obs = observations(spark, sf)
    root = scratch_path(spark, "lake")
    old = obs.where("scrape_date < '2024-01-20'").drop("_panel_user").withColumn("seq", F.concat_ws("#", "seq", "timestamp"))
    new = obs.where("scrape_date >= '2024-01-20'").withColumn("seq", F.concat_ws("#", "seq", "timestamp"))
    L.write_day(L.as_text(old), root)
    L.write_day(L.merge_day(new, new), root)
    back = L.read_lake(spark, root, since="2024-01-15")
    return back.groupBy("source_id", F.col("scrape_date").cast("string").alias("scrape_date")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum(F.col("value").cast("double")), 2).alias("total"), F.count("_panel_user").alias("n_user"))


@query("append_day", "A4 U2", """WITH o AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) d, o_orderstatus s FROM orders) SELECT CAST(o_custkey AS VARCHAR) cust, CAST(d AS VARCHAR) "day", s status FROM o""")
def append_day(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    first, second = o.where("o_orderkey % 3 <> 0").drop("o_orderkey"), o.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").drop("o_orderkey")
    return L.merge_day(first, second)


@query("last_write_wins", "W1", f"""WITH {OBS_SQL} SELECT source_id, u _panel_user, t "timestamp", {R('v', 2)} "value", CAST(d AS VARCHAR) scrape_date FROM lww""")
def last_write_wins(spark, sf):
    r = L.last_write_wins(observations(spark, sf))
    return r.select("source_id", "_panel_user", "timestamp", rnd(F.col("value").cast("double"), 2).alias("value"), F.col("scrape_date").cast("string").alias("scrape_date"))


@query("series_index", "G2 J1 A3", f"""WITH {OBS_SQL}, n AS (SELECT source_id, concat(source_id, '|user=', u) series_key, count(*) n_rows FROM lww GROUP BY ALL HAVING count(*) >= 3)
SELECT source_id, series_key, n_rows, CASE source_id WHEN 'click' THEN 'web_cloudops' WHEN 'bulk_once' THEN 'sales' ELSE 'transport' END "domain" FROM n
WHERE source_id <> 'error' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY series_key) <= 40""")
def series_index(spark, sf):
    """Index of the live series: counts after dedup, minimum length, first 40 panels, catalog labels."""
    obs = L.last_write_wins(observations(spark, sf)).where("_panel_user IS NOT NULL")
    idx = L.series_index(obs, 3, 40)
    cat = obs.select("source_id").distinct().select(
        "source_id", F.expr("CASE source_id WHEN 'click' THEN 'web_cloudops' WHEN 'bulk_once' THEN 'sales' ELSE 'transport' END").alias("domain"),
        (F.col("source_id") == "error").alias("disabled"))
    return idx.join(cat.where(~F.coalesce("disabled", F.lit(False))).drop("disabled"), "source_id")


@query("bin_records", "G1", f"""SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) t, {R('avg(CASE WHEN event_id % 4 <> 0 THEN "value" END)', 4)} mean_value FROM events GROUP BY 1,2 HAVING count(CASE WHEN event_id % 4 <> 0 THEN 1 END) > 0""")
def bin_records(spark, sf):
    e = load(spark, sf, "events").select("event_type", F.col("ts").cast("string").alias("timestamp"), F.expr("if(event_id % 4 = 0, 'n/a', CAST(value AS STRING))").alias("v"))
    b = K.bin_records(e, "timestamp", 3600, "mean", "v", ["event_type"])
    return b.select("event_type", F.unix_seconds("bin").alias("t"), rnd(F.col("value"), 4).alias("mean_value"))


@query("bin_counts", "G1", "SELECT l_returnflag, CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT) t, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1,2")
def bin_counts(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", F.col("l_shipdate").cast("timestamp").alias("ts"))
    return K.bin_records(li, "ts", 86400, "count", None, ["l_returnflag"]).select("l_returnflag", F.unix_seconds("bin").alias("t"), F.col("value").alias("n"))


_UG = """g AS (SELECT user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)))/1e6::DOUBLE gap FROM (SELECT DISTINCT user_id, ts FROM events)),
m AS (SELECT user_id, median(gap) med FROM g WHERE gap > 0 GROUP BY 1)"""


@query("gap_segments", "W2 W3 Z4", f"""WITH {_UG}, s AS (SELECT g.user_id, ts, sum(CASE WHEN gap > 8*med THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY ts) seg FROM g LEFT JOIN m USING (user_id)),
p AS (SELECT user_id, seg, count(*) n, min(ts) st, max(ts) en FROM s GROUP BY 1,2)
SELECT user_id, n longest, CAST(floor(epoch(st)) AS BIGINT) seg_start, CAST(floor(epoch(en)) AS BIGINT) seg_end, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) n_rows, count(*) OVER (PARTITION BY user_id) n_segments
FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seg) = 1""")
def gap_segments(spark, sf):
    e = load(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    r = Q.longest_segment(Q.segments(e, ["user_id"], "ts"), ["user_id"], "ts")
    return r.select("user_id", "longest", F.unix_seconds("start").alias("seg_start"), F.unix_seconds("end").alias("seg_end"), "n_rows", "n_segments")


@query("cadence_profile", "G22", f"""WITH {_UG}, b AS (SELECT user_id, count(DISTINCT ts) n, max(ts) newest FROM events GROUP BY 1)
SELECT user_id, n n_distinct, 0::BIGINT n_future, {R('med', 3)} median_gap_s, {R("(epoch(TIMESTAMP '2024-02-01') - floor(epoch(newest)))/86400.0")} age_days,
 CASE WHEN med <= 90 THEN 'PT1M' WHEN med <= 450 THEN 'PT5M' WHEN med <= 1200 THEN 'PT15M' WHEN med <= 2700 THEN 'PT30M' WHEN med <= 7200 THEN 'PT1H' WHEN med <= 129600 THEN 'P1D' WHEN med <= 864000 THEN 'P1W' WHEN med <= 3888000 THEN 'P1M' END frequency,
 CASE WHEN n < 2 THEN 'too few stamps' ELSE 'ok' END verdict FROM b LEFT JOIN m USING (user_id)""")
def cadence_profile(spark, sf):
    e = load(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    r = Q.cadence_profile(e, ["user_id"], "ts", NOW)
    return r.select("user_id", "n_distinct", "n_future", rnd(F.col("median_gap_s"), 3).alias("median_gap_s"), rnd(F.col("age_days")).alias("age_days"), "frequency", "verdict")


@query("adaptive_bins", "G23", """WITH c AS (SELECT user_id, count(DISTINCT date_trunc('day', ts)) d, count(DISTINCT epoch(ts)::BIGINT // 21600) s, count(DISTINCT date_trunc('hour', ts)) h FROM (SELECT user_id, date_trunc('second', ts) ts FROM events) GROUP BY 1)
SELECT user_id, d n_day, s n_six_hours, h n_hour, CASE WHEN d >= 24 THEN 'P1D' WHEN s >= 24 THEN 'PT6H' WHEN h >= 24 THEN 'PT1H' END bin FROM c""")
def adaptive_bins(spark, sf):
    r = Q.adaptive_bin(load(spark, sf, "events").select("user_id", "ts"), ["user_id"], "ts")
    return r.select("user_id", F.col("P1D").alias("n_day"), F.col("PT6H").alias("n_six_hours"), F.col("PT1H").alias("n_hour"), "bin")


@query("activity_profile", "G24", """WITH b AS (SELECT user_id, date_trunc('day', ts) d, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) c FROM events GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) i FROM b),
a AS (SELECT user_id, count(CASE WHEN c <> 0 THEN 1 END) nonzero, count(DISTINCT c) n_distinct, count(CASE WHEN c <> 0 AND i <= 7 THEN 1 END) recent, count(*) n_bins FROM r GROUP BY 1)
SELECT *, CASE WHEN nonzero = 0 THEN 'all zero' WHEN recent < 2 THEN 'quiet lately' WHEN nonzero < 8 THEN 'mostly empty' WHEN n_distinct < 3 THEN 'few values' ELSE 'ok' END verdict FROM a""")
def activity_profile(spark, sf):
    b = load(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count_if(F.col("event_type") == "error").alias("c"))
    return Q.activity_profile(b, ["user_id"], "d", "c", 7, 2, 8, 3)


_FLAT = "(SELECT series_key, ts, floor(\"value\"/200000) v FROM bins)"


@query("flat_runs", "W4", f"""WITH {BINS_SQL}, c AS (SELECT series_key, ts, CASE WHEN v <> lag(v) OVER (PARTITION BY series_key ORDER BY ts) THEN 1 ELSE 0 END c FROM {_FLAT}),
r AS (SELECT series_key, sum(c) OVER (PARTITION BY series_key ORDER BY ts) run FROM c), k AS (SELECT series_key, run, count(*) n FROM r GROUP BY 1,2)
SELECT series_key, {R('max(n)::DOUBLE/sum(n)')} flat_frac, CAST(sum(n) AS BIGINT) n FROM k GROUP BY 1""")
def flat_runs(spark, sf):
    b = series_bins(spark, sf).select("series_key", "ts", F.floor(F.col("value") / 200000).alias("value"))
    return Q.longest_flat_run(b, ["series_key"], "ts", "value").withColumn("flat_frac", rnd(F.col("flat_frac")))


_LAGS = (1, 2, 3, 12, 24, 36)


@query("lag_correlations", "W5", f"""WITH {BINS_SQL}, x AS (SELECT series_key, ts, "value" - avg("value") OVER (PARTITION BY series_key) x FROM bins),
l AS (SELECT series_key, x, {', '.join(f'lag(x,{p}) OVER (PARTITION BY series_key ORDER BY ts) l{p}' for p in _LAGS)} FROM x)
SELECT series_key, {', '.join(R(f'sum(x*l{p})/sum(x*x)') + f' acf_{p}' for p in _LAGS)} FROM l GROUP BY 1""")
def lag_correlations(spark, sf):
    r = Q.lag_correlations(series_bins(spark, sf), ["series_key"], "ts", "value", _LAGS)
    return r.select("series_key", *[rnd(F.col(f"acf_{p}")).alias(f"acf_{p}") for p in _LAGS])


@query("seasonal_profile", "W6", f"""WITH {BINS_SQL}, p AS (SELECT series_key, (row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1) % 12 phase, "value" v FROM bins), m AS (SELECT series_key, phase, avg(v) m FROM p GROUP BY 1,2)
SELECT series_key, phase::BIGINT phase, {R('m - avg(m) OVER (PARTITION BY series_key)', 3)} profile FROM m""")
def seasonal_profile(spark, sf):
    r = Q.seasonal_profile(series_bins(spark, sf), ["series_key"], "ts", "value", 12)
    return r.select("series_key", F.col("phase").cast("bigint").alias("phase"), rnd(F.col("profile"), 3).alias("profile"))


@query("noise_and_trend", "W7 W10 F28", f"""WITH {BINS_SQL}, d AS (SELECT series_key, ts, "value" v, row_number() OVER w - 1 i, "value" - lag("value") OVER w d1 FROM bins WINDOW w AS (PARTITION BY series_key ORDER BY ts)),
e AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY series_key ORDER BY ts) d2 FROM d)
SELECT series_key, {R('avg(abs(d1))', 3)} step, {R('20*log10(stddev_pop(v)/(stddev_pop(d2)/sqrt(6.0)))')} snr_db, {R('regr_slope(v, i)', 4)} slope, {R('regr_intercept(v, i)', 2)} "intercept" FROM e GROUP BY 1""")
def noise_and_trend(spark, sf):
    r = Q.noise_to_signal(series_bins(spark, sf), ["series_key"], "ts", "value")
    return r.select("series_key", rnd(F.col("step"), 3).alias("step"), rnd(F.col("snr_db")).alias("snr_db"), rnd(F.col("slope"), 4).alias("slope"), rnd(F.col("intercept"), 2).alias("intercept"))


@query("strided_windows", "W9", f"""WITH {BINS_SQL}, n AS (SELECT series_key, ts, "value" v, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 pos, count(*) OVER (PARTITION BY series_key) n FROM bins),
s AS (SELECT DISTINCT series_key, n, unnest(range(0, n - 128 + 1, 32)) st FROM (SELECT DISTINCT series_key, n FROM n WHERE n >= 128))
SELECT s.series_key, st "start", CAST(epoch(max(ts)) AS BIGINT) available_at, count(*)::BIGINT len, {R('avg(v)', 3)} mean_value FROM s JOIN n ON n.series_key = s.series_key AND pos >= st AND pos < st + 128 GROUP BY 1,2""")
def strided_windows(spark, sf):
    from tidemark.functions import arrays as A
    r = Q.strided_windows(series_bins(spark, sf), ["series_key"], "ts", "value", 128, 32)
    return r.select("series_key", "start", F.unix_seconds("available_at").alias("available_at"), F.size("values").cast("bigint").alias("len"), rnd(F.expr(A.mean("values")), 3).alias("mean_value"))


_SEED = "motif-v1"


@query("motif_extraction", "C1 T10 W2", f"""WITH {BINS_SQL}, b2 AS (SELECT * FROM bins WHERE NOT (hash_gap(series_key, ts))),
g AS (SELECT series_key, ts, "value" v, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_key ORDER BY ts)) gap FROM b2), m AS (SELECT series_key, median(gap) med FROM g WHERE gap > 0 GROUP BY 1),
s AS (SELECT g.*, sum(CASE WHEN gap > 8*med THEN 1 ELSE 0 END) OVER (PARTITION BY g.series_key ORDER BY ts) seg FROM g LEFT JOIN m USING (series_key)),
p AS (SELECT series_key, seg, count(*) n, count(*) OVER (PARTITION BY series_key) nseg, sum(count(*)) OVER (PARTITION BY series_key) tot FROM s GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY n DESC, seg) = 1),
q AS (SELECT *, n - least(n, 320) free, CASE WHEN {uniform_sql(_SEED, 'series_key', "'tail'")} < 0.5 THEN n - least(n, 320) ELSE floor({uniform_sql(_SEED, 'series_key', "'start'")} * (n - least(n,320) + 1)) END lo FROM p),
w AS (SELECT q.series_key, s.v, s.ts, row_number() OVER (PARTITION BY q.series_key ORDER BY s.ts) - 1 pos, lo, n FROM q JOIN s ON s.series_key = q.series_key AND s.seg = q.seg),
a AS (SELECT series_key, avg(v) mv, count(*) len, max(ts) mts FROM w WHERE pos >= lo AND pos < lo + least(n, 320) AND n >= 128 GROUP BY 1)
SELECT q.series_key, n longest, CAST(tot AS BIGINT) n_rows, nseg n_segments, CAST(lo AS BIGINT) start_pos, CASE WHEN n < 128 THEN 'longest contiguous segment under floor' END reason, {R('mv', 3)} mean_value, CAST(coalesce(len, 0) AS BIGINT) len, CAST(epoch(mts) AS BIGINT) last_ts
FROM q LEFT JOIN a USING (series_key)""".replace("hash_gap(series_key, ts)", "dayofyear(ts) BETWEEN 150 AND 190 AND series_key LIKE '%_day|%'"))
def motif_extraction(spark, sf):
    """Windows from the longest contiguous run: forty-day holes are punched into the daily series first."""
    from tidemark.functions import arrays as A
    b = series_bins(spark, sf).where("NOT (dayofyear(ts) BETWEEN 150 AND 190 AND series_key LIKE '%\\_day|%')")
    r = Q.extract_motifs(b, ["series_key"], "ts", "value", 320, _SEED, 0.5)
    return r.select("series_key", "longest", "n_rows", "n_segments", "start_pos", "reason", rnd(F.expr(A.mean("motif")), 3).alias("mean_value"),
                    F.coalesce(F.size("motif"), F.lit(0)).cast("bigint").alias("len"), F.unix_seconds(F.array_max("motif_ts")).alias("last_ts"))


@query("rejection_summary", "G29", f"""WITH {BINS_SQL}, b2 AS (SELECT * FROM bins WHERE NOT (series_key LIKE 'ship_day|%' AND dayofmonth(ts) > 20) AND NOT (series_key LIKE 'order_week|%' AND year(ts) > 1993)),
g AS (SELECT series_key, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_key ORDER BY ts)) gap FROM b2), m AS (SELECT series_key, median(gap) med FROM g WHERE gap > 0 GROUP BY 1),
s AS (SELECT g.*, sum(CASE WHEN gap > 8*med THEN 1 ELSE 0 END) OVER (PARTITION BY g.series_key ORDER BY ts) seg FROM g LEFT JOIN m USING (series_key)), p AS (SELECT series_key, seg, count(*) n FROM s GROUP BY 1, 2), l AS (SELECT series_key, max(n) n FROM p GROUP BY 1)
SELECT 'longest contiguous segment under floor' reason, count(*) n_series FROM l WHERE n < 128 HAVING count(*) > 0""")
def rejection_summary(spark, sf):
    """Why series give no window: the shipping days lose a third of every month, the weekly orders all but their first years."""
    b = series_bins(spark, sf).where("NOT (series_key LIKE 'ship\\_day|%' AND dayofmonth(ts) > 20) AND NOT (series_key LIKE 'order\\_week|%' AND year(ts) > 1993)")
    return Q.rejection_summary(Q.extract_motifs(b, ["series_key"], "ts", "value", 320, _SEED, 0.5), "reason")


_STAMP = "event_id % (CASE WHEN event_type = 'error' THEN 4 ELSE 25 END) = 0"


@query("chronological_order", "W3", f"""WITH e AS (SELECT event_type, event_id, CASE WHEN {_STAMP} THEN NULL ELSE date_trunc('second', ts) END t FROM events), s AS (SELECT *, avg(CASE WHEN t IS NULL THEN 0.0 ELSE 1 END) OVER (PARTITION BY event_type) r FROM e)
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN r > 0.9 THEN t END NULLS LAST, event_id) "position" FROM s""")
def chronological_order(spark, sf):
    """Stamps arrive as text; some cannot be read, of one type too many."""
    e = load(spark, sf, "events").selectExpr("event_type", "event_id", f"if({_STAMP}, 'not known', date_format(ts, 'yyyy-MM-dd HH:mm:ss')) AS stamp")
    e = e.withColumn("t", F.expr(T.parse_ts("stamp")))
    return Q.chronological(e, ["event_type"], "t", "event_id").select("event_type", "event_id", "position")


@query("longest_flow_series", "G25", """WITH s AS (SELECT p_type flow, concat(p_brand, '.', l_returnflag) skey, CASE CAST(regexp_extract(p_brand, '[0-9]+') AS INT) % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'Q' WHEN 2 THEN 'W' ELSE 'A' END code, count(DISTINCT date_trunc('month', l_shipdate)) n
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1,2,3)
SELECT flow, skey, code, n n_periods FROM s WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY flow ORDER BY CASE code WHEN 'M' THEN 0 WHEN 'W' THEN 1 WHEN 'Q' THEN 2 ELSE 3 END, n DESC, skey) = 1""")
def longest_flow_series(spark, sf):
    """Per flow: long enough first, then the best frequency, then the longest history."""
    li, p = load(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_shipdate"), load(spark, sf, "part")
    j = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("p_type").alias("flow"), F.concat_ws(".", "p_brand", "l_returnflag").alias("skey"),
        F.expr("CASE CAST(regexp_extract(p_brand, '[0-9]+', 0) AS INT) % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'Q' WHEN 2 THEN 'W' ELSE 'A' END").alias("code"),
        F.trunc("l_shipdate", "month").alias("period"))
    return Q.longest_usable(j, "flow", "skey", "code", "period", ("M", "W", "Q", "A"))
