"""Cleaning and column-profile queries over text records written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean as K
from tidemark.plans.views import BINS_SQL, R, load, rnd, series_bins
from tidemark.registry import query


def raw_orders(spark, sf):
    """Order records as a feed would store them: everything text, some cells dirty."""
    return load(spark, sf, "orders").selectExpr(
        "o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS timestamp",
        "CASE o_orderkey % 4 WHEN 0 THEN replace(replace(replace(format_number(o_totalprice, 2), ',', '#'), '.', ','), '#', '.') "
        "WHEN 1 THEN CAST(o_totalprice AS STRING) WHEN 2 THEN '' END AS total",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('Magnitude ', o_orderkey % 90 / 10.0D, ', zone') WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS note",
        "o_orderpriority AS _panel_priority", "o_orderstatus AS level")


@query("clean_values", "B1 B3 B4 B5", """WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') d, CASE WHEN o_orderkey%4 IN (0,1) THEN o_totalprice END v,
 CASE WHEN o_orderkey % 3 = 0 THEN round((o_orderkey % 90)/10.0, 1) END mag, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END st, o_orderkey % 4 = 2 AS blank FROM orders)
SELECT o_orderkey, substr(d, 1, 7) "timestamp", CAST(v AS DOUBLE) price, CAST(mag AS DOUBLE) magnitude, st FROM r WHERE v IS NOT NULL OR mag IS NOT NULL OR st IS NOT NULL""")
def clean_values(spark, sf):
    r = K.rename_fields(raw_orders(spark, sf), {"total": "price"})
    r = K.decimal_comma(r, ["price", "note"])
    r = K.drop_null_values(r, ["price", "note"])
    r = K.regex_extract(r, "timestamp", r"^(\d{4}-\d{2})-\d{2}$")
    r = K.regex_extract(r, "note", r"^Magnitude ([0-9.]+)")
    return r.select("o_orderkey", "timestamp", F.expr("try_cast(nullif(price, '') AS DOUBLE)").alias("price"),
                    F.expr("try_cast(note AS DOUBLE)").alias("magnitude"), F.expr("if(try_cast(note AS DOUBLE) IS NULL, note, NULL)").alias("st"))


@query("filter_records", "B6 B7 B8", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'soon-ish' ELSE strftime(o_orderdate, '%Y-%m-%d') END "timestamp" FROM orders
 WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND (o_orderkey % 10 = 0 OR (o_orderdate <= TIMESTAMP '1999-06-02' AND NOT (o_orderkey % 10 = 1)))""")
def filter_records(spark, sf):
    r = raw_orders(spark, sf).withColumn("timestamp", F.expr(
        "CASE o_orderkey % 10 WHEN 0 THEN 'soon-ish' WHEN 1 THEN substr(timestamp, 1, 4) ELSE timestamp END"))
    r = K.where_equals(r, {"level": "F", "priority": "1-URGENT"})
    r = K.drop_future(r, "1999-06-01 00:00:00", 1.0)
    return K.keep_stamps_like(r, r"\d{4}-\d{2}-\d{2}$|soon").select("o_orderkey", "timestamp")


@query("snapshot_rows", "B2", """SELECT c_nationkey nation, CAST(c_custkey // 64 AS BIGINT) page, c_custkey, CASE WHEN c_custkey % 64 < 60 THEN round(c_acctbal, 2) END balance, '2024-01-01T00:00:00' "timestamp" FROM customer""")
def snapshot_rows(spark, sf):
    c = load(spark, sf, "customer").groupBy(F.expr("c_custkey div 64").alias("page")).agg(F.expr(
        "array_sort(collect_list(named_struct('k', c_custkey, 'n', c_nationkey, 'b', c_acctbal)))").alias("r"))
    polls = c.selectExpr("page", "transform(r, x -> x.k) AS c_custkey", "transform(r, x -> x.n) AS nation", "transform(slice(r, 1, 60), x -> x.b) AS balance")
    out = K.stamp_snapshot(polls, ["c_custkey", "nation", "balance"], "2024-01-01T00:00:00")
    return out.withColumn("balance", F.round("balance", 2))


@query("panel_cap", "B9", """WITH g AS (SELECT DISTINCT l_returnflag s, l_suppkey k FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY CAST(k AS VARCHAR)) i FROM g)
SELECT l_returnflag source_id, CAST(l_suppkey AS VARCHAR) supp, count(*) n FROM lineitem JOIN r ON s = l_returnflag AND k = l_suppkey AND i <= 50 GROUP BY 1,2""")
def panel_cap(spark, sf):
    from tidemark.sources.lake import cap_panels
    r = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source_id"), F.col("l_suppkey").cast("string").alias("_panel_supp"))
    return cap_panels(r, 50).groupBy("source_id", F.col("_panel_supp").alias("supp")).agg(F.count(F.lit(1)).alias("n"))


@query("densest_column", "B10", """WITH r AS (SELECT o_custkey, o_orderpriority a, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END b, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END c FROM orders),
n AS (SELECT o_custkey, count(b) nb, count(c) nc FROM r GROUP BY 1)
SELECT o_custkey, CASE WHEN nb = 0 AND nc = 0 THEN NULL WHEN nb >= nc THEN 'b' ELSE 'c' END field, greatest(nb, nc) n_finite FROM n""")
def densest_column(spark, sf):
    r = load(spark, sf, "orders").selectExpr("o_custkey", "o_orderpriority AS a", "CAST(if(o_orderkey % 3 = 0, o_totalprice, NULL) AS STRING) AS b",
                                             "if(o_orderkey % 2 = 0, CAST(o_orderkey AS STRING), 'n/a') AS c")
    return K.densest_column(r, ["o_custkey"], ["a", "b", "c"])


@query("category_codes", "B10", """SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) - 1 AS DOUBLE) code FROM orders""")
def category_codes(spark, sf):
    r = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return K.category_codes(r, ["o_orderstatus"], "o_orderpriority").select("o_orderkey", "code")


def holey_windows(spark, sf):
    """Every whole series with holes punched into it; urgent orders are constant, high ones empty."""
    from pyspark.sql import Window
    w = Window.partitionBy("series_key")
    t = series_bins(spark, sf).withColumns({"pos": F.row_number().over(w.orderBy("ts")) - 1, "n": F.count(F.lit(1)).over(w)})
    return t.select("series_key", "pos", F.expr("CASE WHEN pos % 7 IN (3, 4) OR pos >= n - 2 OR series_key LIKE '%2-HIGH' THEN double('NaN') "
                                                "WHEN series_key LIKE '%1-URGENT' THEN 7D ELSE value END").alias("value"))


_HOLEY = BINS_SQL + """, t AS (SELECT series_key, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 pos, count(*) OVER (PARTITION BY series_key) n, "value" v FROM bins),
h AS (SELECT series_key, pos, n, CASE WHEN pos % 7 IN (3, 4) OR pos >= n - 2 OR series_key LIKE '%2-HIGH' THEN NULL WHEN series_key LIKE '%1-URGENT' THEN 7.0::DOUBLE ELSE v END v FROM t)"""


@query("median_fill", "B11 B13 B14", f"""WITH {_HOLEY}, f AS (SELECT series_key, pos, n, coalesce(v, median(v) OVER (PARTITION BY series_key), 0) v, series_key LIKE '%2-HIGH' e, series_key LIKE '%1-URGENT' k FROM h)
SELECT series_key, pos::BIGINT pos, {R('v', 3)} filled, CASE WHEN e THEN 'all non-finite' WHEN k THEN 'constant' END reason,
 {R('CASE WHEN e OR k THEN (-1 + 2.0::DOUBLE*pos/(n-1))/sqrt((n+1)/(3.0::DOUBLE*(n-1))) ELSE (v - avg(v) OVER (PARTITION BY series_key)) / stddev_pop(v) OVER (PARTITION BY series_key) END')} z FROM f""")
def median_fill(spark, sf):
    g = holey_windows(spark, sf).groupBy("series_key").agg(F.expr("array_sort(collect_list(struct(pos, value)))").alias("w"))
    g = g.withColumn("x", F.expr("transform(w, p -> p.value)")).withColumn("f", F.expr(K.median_fill("x")))
    g = g.withColumn("reason", F.expr(K.degenerate_reason("x"))).withColumn("z", F.expr(K.zscore_or_ramp("f")))
    e = g.select("series_key", "reason", F.explode(F.expr("arrays_zip(transform(w, p -> p.pos), f, z)")).alias("r"))
    return e.select("series_key", F.expr("r['0']").cast("bigint").alias("pos"), rnd(F.col("r.f"), 3).alias("filled"), "reason", rnd(F.col("r.z")).alias("z"))


@query("interpolated_gaps", "B12", f"""WITH {_HOLEY}, k AS (SELECT *, last_value(v IGNORE NULLS) OVER b v0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b p0,
 first_value(v IGNORE NULLS) OVER a v1, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a p1 FROM h WHERE series_key NOT LIKE '%2-HIGH'
 WINDOW b AS (PARTITION BY series_key ORDER BY pos ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY series_key ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_key, pos::BIGINT pos, {R('CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL OR p0 = p1 THEN v0 ELSE v0 + (v1-v0)*(pos-p0)/(p1-p0) END', 3)} "value" FROM k""")
def interpolated_gaps(spark, sf):
    r = K.interpolate_gaps(holey_windows(spark, sf), ["series_key"], "pos", "value")
    return r.select("series_key", F.col("pos").cast("bigint").alias("pos"), rnd(F.col("value"), 3).alias("value"))


_PROF = "SELECT '{c}' \"column\", count(*) n, count({c}) non_null, count(try_cast(replace(CAST({c} AS VARCHAR), ',', '.') AS DOUBLE)) \"numeric\", {d} datelike, '{r}' \"role\" FROM events"


@query("column_roles", "B16 B17", " UNION ALL ".join(_PROF.format(c=c, d=d, r=r) for c, d, r in (
    ("event_id", "count(CASE WHEN length(CAST(event_id AS VARCHAR)) = 8 THEN 1 END)", "identifier"), ("ts", "count(*)", "timestamp"),
    ("user_id", "0::BIGINT", "identifier"), ("event_type", "0::BIGINT", "panel"), ("value", "0::BIGINT", "value"), ("props", "0::BIGINT", "panel"))).replace('count(value)', 'count("value")').replace("CAST(value AS", 'CAST("value" AS'))
def column_roles(spark, sf):
    return K.assign_roles(K.profile_columns(load(spark, sf, "events"))).select("column", "n", "non_null", "numeric", "datelike", "role")


@query("interleaved_panels", "B18", """WITH e AS (SELECT date_trunc('hour', ts) h, event_type, CAST(user_id % 5 AS VARCHAR) band FROM events),
u AS (SELECT '' dim, '' pin, h FROM e UNION ALL SELECT 'event_type', event_type, h FROM e UNION ALL SELECT 'band', band, h FROM e)
SELECT dim, pin, count(*) n_rows, count(DISTINCT h) n_stamps, count(DISTINCT h) < 0.8 * count(*) panelled FROM u GROUP BY 1,2""")
def interleaved_panels(spark, sf):
    e = load(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("h"), "event_type", (F.col("user_id") % 5).alias("band"))
    return K.panel_check(e, "h", ["event_type", "band"])
