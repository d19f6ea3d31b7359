"""Decoder queries: payload pages are written from the tables and read back.

Pages hold 64 consecutive keys, so no page grows with a hot customer or user.
The DuckDB twin states the rows the pages were written from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.plans.views import load
from tidemark.registry import query
from tidemark.sources import payloads as P


def order_pages(spark, sf, body: str):
    """One row per 64 orders with a text payload; ``body`` builds it from ``rows`` (sorted by key)."""
    o = load(spark, sf, "orders").withColumn("page", F.expr("o_orderkey div 64"))
    g = o.groupBy("page").agg(F.expr(
        "array_sort(collect_list(named_struct('k', o_orderkey, 'd', date_format(o_orderdate, 'yyyy-MM-dd'), "
        "'e', unix_seconds(CAST(o_orderdate AS TIMESTAMP)), 'v', o_totalprice, 'p', o_orderpriority, 's', o_orderstatus)))").alias("rows"))
    return g.select("page", F.expr(body).alias("payload"))


@query("json_path_records", "A5 F13 V5", """SELECT o_orderkey // 64 page, strftime(o_orderdate, '%Y-%m-%d') "timestamp", round(o_totalprice, 2) price, o_orderpriority region, 'rows' kind FROM orders
UNION ALL SELECT o_orderkey // 64, '2001-09-09T01:46:40+00:00', round(o_totalprice, 2), o_orderpriority, 'stations' FROM orders""")
def json_path_records(spark, sf):
    pages = order_pages(spark, sf, "to_json(named_struct('meta', named_struct('last_updated', 1000000000), 'data', named_struct('rows', "
                        "transform(rows, r -> named_struct('day', r.d, 'obs', named_struct('price', r.v), 'region', r.p)))))")
    rows = P.json_records(pages, "payload", ["page"], "data.rows[].day", ["data.rows[].obs.price"], ["data.rows[].region"])
    stations = P.json_records(pages, "payload", ["page"], "meta.last_updated", ["data.rows[].obs.price"], ["data.rows[].region"])
    both = rows.withColumn("kind", F.lit("rows")).unionByName(stations.withColumn("kind", F.lit("stations")))
    return both.select("page", "timestamp", F.expr("round(CAST(price AS DOUBLE), 2)").alias("price"), F.col("_panel_region").alias("region"), "kind")


@query("date_map_records", "A6 J12", """WITH a AS (SELECT o_orderkey // 64 page, strftime(o_orderdate, '%Y-%m-%d') d, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) h,
 max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) b FROM orders GROUP BY 1,2)
SELECT page, d "timestamp", CAST(h AS VARCHAR) hits_dates, CAST(b AS VARCHAR) bandwidth_dates FROM a WHERE h IS NOT NULL OR b IS NOT NULL""")
def date_map_records(spark, sf):
    m = lambda cond: ("transform(array(filter(rows, r -> " + cond + ")), f -> map_from_entries(transform(array_distinct(transform(f, r -> r.d)), "  # noqa: E731
                      "d -> struct(d, element_at(filter(f, r -> r.d = d), -1).k))))[0]")
    pages = order_pages(spark, sf, f"to_json(named_struct('hits', named_struct('dates', {m('r.k % 2 = 0')}), 'bandwidth', named_struct('dates', {m('r.k % 3 = 0')})))")
    return P.date_map_records(pages, "payload", ["page"], ["hits.dates", "bandwidth.dates"])


@query("stepped_records", "A7", """WITH n AS (SELECT *, o_orderkey // 64 page, row_number() OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) - 1 i,
 first_value(epoch(o_orderdate)) OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) e0 FROM orders)
SELECT page, 'forward' dir, CAST(e0 + i*900 AS BIGINT) t, round(o_totalprice, 2) v FROM n
UNION ALL SELECT page, 'newest_first', CAST(1009756800 - i*3600 AS BIGINT), round(o_totalprice, 2) FROM n WHERE i >= 1""")
def stepped_records(spark, sf):
    pages = order_pages(spark, sf, "to_json(named_struct('start', rows[0].e, 'step_ms', 900000, 'freq', transform(rows, r -> r.v)))")
    fwd = P.stepped_records(pages, "payload", ["page"], "start", "step_ms", ["freq"])
    back = P.stepped_records(pages, "payload", ["page"], "now", "PT1H", ["freq"], newest_first=True, skip=1, now="TIMESTAMP'2001-12-31 00:25:00'")
    both = fwd.withColumn("dir", F.lit("forward")).unionByName(back.withColumn("dir", F.lit("newest_first")))
    return both.select("page", "dir", F.unix_seconds("timestamp").alias("t"), F.expr("round(CAST(value AS DOUBLE), 2)").alias("v"))


@query("cube_records", "A13 V5", """WITH c AS (SELECT year(o_orderdate) y, month(o_orderdate) m, o_orderpriority p, o_orderstatus s, count(*) n FROM orders GROUP BY ALL)
SELECT s status, y*100 + m ym, p priority, CAST(n AS DOUBLE) "value" FROM c""")
def cube_records(spark, sf):
    """A year x month x priority cube per status: the flat array is rebuilt from grouped counts."""
    o = load(spark, sf, "orders")
    cells = o.groupBy("o_orderstatus", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    cube = cells.groupBy("o_orderstatus").agg(F.expr("map_from_entries(collect_list(named_struct('key', concat_ws('|', y, m, o_orderpriority), 'value', n)))").alias("m"),
                                              F.expr("array_sort(collect_set(CAST(y AS STRING)))").alias("ys"), F.expr("array_sort(collect_set(o_orderpriority))").alias("ps"))
    months = "transform(sequence(1, 12), i -> CAST(i AS STRING))"
    flat = f"flatten(flatten(transform(ys, y -> transform({months}, mo -> transform(ps, p -> try_element_at(m, concat_ws('|', y, mo, p)))))))"
    idx = lambda a: f"map_from_arrays({a}, sequence(0, size({a}) - 1))"
    dim = lambda a: f"named_struct('category', named_struct('index', {idx(a)}))"
    body = (f"to_json(named_struct('id', array('Y', 'M', 'P'), 'size', array(size(ys), 12, size(ps)), 'value', {flat}, "
            f"'dimension', named_struct('Y', {dim('ys')}, 'M', {dim(months)}, 'P', {dim('ps')})), map('ignoreNullFields', 'false'))")
    pages = cube.select("o_orderstatus", F.expr(body).alias("payload"))
    r = P.cube_records(pages, "payload", ["o_orderstatus"], time_dims=["Y", "M"])
    return r.select(F.col("o_orderstatus").alias("status"), F.expr("CAST(replace(timestamp, '-', '') AS BIGINT)").alias("ym"), F.expr("panel['P']").alias("priority"), "value")


@query("sdmx_records", "A14", """SELECT o_orderkey // 64 page, o_orderpriority series_key, strftime(o_orderdate, '%Y-%m-%d') "timestamp", round(max(o_totalprice), 2) "value" FROM orders GROUP BY 1,2,3""")
def sdmx_records(spark, sf):
    """One message per 64 orders: the largest price per (priority, day). Rows sorted by (priority, day, price) end each pair's run with it."""
    o = load(spark, sf, "orders").selectExpr("o_orderkey div 64 AS page", "o_orderpriority AS p", "date_format(o_orderdate, 'yyyy-MM-dd') AS d", "o_totalprice AS v")
    g = o.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p", "d", "v"))).alias("rows"), F.array_sort(F.collect_set("d")).alias("periods"),
                              F.array_sort(F.collect_set("p")).alias("ps"))
    best = "filter(rows, (r, i) -> NOT coalesce(get(rows, i + 1).p = r.p AND get(rows, i + 1).d = r.d, false))"
    entry = "named_struct('key', CAST(array_position(periods, r.d) - 1 AS STRING), 'value', array(r.v))"
    obs = let("b", best, f"map_from_arrays(ps, transform(ps, p -> named_struct('observations', map_from_entries(transform(filter(b, r -> r.p = p), r -> {entry})))))")
    body = (f"to_json(named_struct('dataSets', array(named_struct('series', {obs})), 'structure', named_struct('dimensions', "
            "named_struct('observation', array(named_struct('id', 'TIME_PERIOD', 'values', transform(periods, d -> named_struct('id', d))))))))")
    return P.sdmx_records(g.select("page", F.expr(body).alias("payload")), "payload", ["page"]).withColumn("value", F.round("value", 2))


@query("csv_records", "A8 A16", """SELECT o_orderkey // 64 page, strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST((o_orderkey % 24) AS VARCHAR), 2, '0') || ':00:00' "timestamp",
 CAST(o_totalprice AS DOUBLE) price, o_orderpriority || ', x' region FROM orders""")
def csv_records(spark, sf):
    line = "concat_ws(';', r.d, CAST(r.k % 24 + 1 AS STRING), concat('\"', r.p, ', x\"'), CAST(r.v AS STRING))"
    pages = order_pages(spark, sf, f"concat('# source: export\\nunits;in;dollars;x\\nDate;Hour;\"Region\";Price\\n', array_join(transform(rows, r -> {line}), '\\n'))")
    r = P.csv_records(pages, "payload", ["page"], "Date Hour", ["Price"], ["Region"], comment="#", skip_rows=1)
    return r.select("page", "timestamp", F.expr("CAST(Price AS DOUBLE)").alias("price"), F.col("_panel_Region").alias("region"))


@query("wide_csv_melt", "A9 V5", """SELECT o_orderpriority region, strftime(o_orderdate, '%Y-%m') "timestamp", CAST(count(*) AS VARCHAR) "value" FROM orders GROUP BY 1,2""")
def wide_csv_melt(spark, sf):
    m = load(spark, sf, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.count(F.lit(1)).alias("n"))
    g = m.groupBy("o_orderpriority").agg(F.expr("array_sort(collect_list(struct(ym, n)))").alias("c"))
    pages = g.select(F.expr("concat('Region,Rank,', array_join(transform(c, x -> x.ym), ','), ',2099-01\\n', '\"', o_orderpriority, '\",7,', "
                            "array_join(transform(c, x -> CAST(x.n AS STRING)), ','), ',')").alias("payload"))
    return P.wide_records(pages, "payload", [], ["Region"]).withColumnRenamed("_panel_Region", "region")


@query("xml_records", "A10", """SELECT o_orderkey // 64 page, strftime(o_orderdate, '%Y-%m-%d') "timestamp", CAST(o_totalprice AS DOUBLE) price,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END st, o_orderpriority region FROM orders""")
def xml_records(spark, sf):
    rec = ("concat('<obs date=\"', r.d, '\"><val unit=\"', r.p, '\">', r.v, '</val>', if(r.k % 2 = 0, concat('<st>', r.s, '</st>'), ''), '</obs>')")
    pages = order_pages(spark, sf, f"concat('<doc>', array_join(transform(rows, r -> {rec}), ''), '</doc>')")
    r = P.xml_records(pages, "payload", ["page"], "obs", "@date", ["val", "st"], ["val/@unit"])
    return r.select("page", "timestamp", F.expr("CAST(val AS DOUBLE)").alias("price"), "st", F.col("_panel_unit").alias("region"))


@query("feed_items", "A11", """SELECT o_orderkey // 64 page, strftime(o_orderdate, '%Y-%m-%d') "timestamp",
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END "value" FROM orders""")
def feed_items(spark, sf):
    item = "concat('<item><title>', r.p, '</title>', if(r.k % 2 = 0, concat('<category>', r.s, '</category>'), ''), '<pubDate>', r.d, '</pubDate></item>')"
    entry = "concat('<entry><updated>', r.d, '</updated><title>', r.p, '</title>', if(r.k % 2 = 0, concat('<category term=\"', r.s, '\"/>'), ''), '</entry>')"
    pages = order_pages(spark, sf, f"if(page % 2 = 0, concat('<rss>', array_join(transform(rows, r -> {item}), ''), '</rss>'), concat('<feed>', array_join(transform(rows, r -> {entry}), ''), '</feed>'))")
    return P.feed_records(pages, "payload", ["page"])


@query("html_tables", "A12", """SELECT o_orderkey // 64 page, strftime(o_orderdate, '%Y-%m-%d') "timestamp", CAST(round(o_totalprice) AS DOUBLE) "value" FROM orders WHERE o_orderkey % 5 <> 0""")
def html_tables(spark, sf):
    row = "if(r.k % 5 = 0, '<tr><td>note</td></tr>', concat('<tr class=x><td>', r.d, '</td><td><b>', format_number(round(r.v), 0), '</b></td></tr>'))"
    pages = order_pages(spark, sf, f"concat('<html><table id=t><tr><th>Day</th><th>Total</th></tr>', array_join(transform(rows, r -> {row}), '\\n'), '</table></html>')")
    r = P.html_table_records(pages, "payload", ["page"], "Day", "Total")
    return r.select("page", "timestamp", F.expr("CAST(value AS DOUBLE)").alias("value"))


@query("page_table_scan", "A12", "SELECT page_id, 0::BIGINT n_records FROM pages WHERE NOT regexp_matches(html, '(?i)<table') AND regexp_matches(html, '(?i)<html')")
def page_table_scan(spark, sf):
    """How many table records each crawled page yields (the corpus carries none)."""
    pages = load(spark, sf, "pages").select("page_id", "html")
    rec = P.html_table_records(pages, "html", ["page_id"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return pages.select("page_id").join(rec, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_records"))


@query("minute_counts", "A15", """SELECT strftime(ts, '%Y-%m-%dT%H:%M') || ':00Z' "timestamp", count(*) "value" FROM events GROUP BY 1""")
def minute_counts(spark, sf):
    log = load(spark, sf, "events").select(F.expr("concat('{\"id\":', event_id, ',\"created_at\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '\",\"props\":', props, '}')").alias("line"))
    return P.minute_counts(log, "line")


@query("whitespace_table", "A16", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:00') "timestamp", "value" FROM events WHERE event_id % 7 <> 0""")
def whitespace_table(spark, sf):
    log = load(spark, sf, "events").select("event_id", F.expr("concat(date_format(ts, 'yyyy MM dd HH mm'), '   ', if(event_id % 7 = 0, 'MM', CAST(value AS STRING)), '  99')").alias("line"))
    return P.whitespace_records(log, "line", ["event_id"], [0, 1, 2, 3, 4], 5)


@query("json_path_props", "F13", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events""")
def json_path_props(spark, sf):
    from tidemark.functions import jsonpath as J
    return load(spark, sf, "events").select("event_id", F.expr("try_parse_json(props)").alias("v")).select(
        "event_id", F.expr(J.walk("v", "k", "bigint")).alias("k"))
