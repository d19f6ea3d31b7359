"""Loading the driver tables and deriving the benchmark's series from them.

Values are summed as integer cents: the result does not depend on the order in
which partitions arrive, so a re-run after a lost executor is identical.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import dims


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(c: str) -> Column:
    return F.sum(F.round(F.col(c) * 100).cast("bigint"))


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def _label(df: DataFrame, source: str, panel: str, domain: str, klass: str, freq: str) -> DataFrame:
    return df.select(
        F.lit(source).alias("source_id"),
        F.concat_ws("|", F.lit(source), F.col(panel)).alias("series_key"),
        F.lit(domain).alias("domain"),
        F.lit(klass).alias("dgp_class"),
        F.lit(freq).alias("freq"),
        F.lit(dims.FREQ_BAND[freq]).alias("cadence"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("c") / F.lit(100.0)).alias("value"),
    )


def _rebin(df: DataFrame, panel: str, unit: str) -> DataFrame:
    return df.groupBy(panel, F.date_trunc(unit, "ts").alias("ts")).agg(F.sum("c").alias("c"))


def series_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Every series of the lake, one row per populated bin.

    The weekly series roll up the daily ones, so each table is read once; bins
    bound every series by calendar span / bin width whatever the row count is.
    """
    li = load(spark, sf, "lineitem")
    od = load(spark, sf, "orders")
    ev = load(spark, sf, "events")
    ship = li.groupBy("l_returnflag", F.date_trunc("day", "l_shipdate").alias("ts")).agg(
        cents("l_extendedprice").alias("c"))
    order = od.groupBy("o_orderpriority", F.date_trunc("day", "o_orderdate").alias("ts")).agg(
        cents("o_totalprice").alias("c"))
    event = ev.groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(
        cents("value").alias("c"))
    parts = [
        _label(ship, "ship_day", "l_returnflag", "transport", "freight_volume", "P1D"),
        _label(_rebin(ship, "l_returnflag", "week"), "ship_week", "l_returnflag", "transport",
               "freight_weekly", "P1W"),
        _label(order, "order_day", "o_orderpriority", "sales", "order_flow", "P1D"),
        _label(_rebin(order, "o_orderpriority", "week"), "order_week", "o_orderpriority", "sales",
               "order_weekly", "P1W"),
        _label(event, "event_hour", "event_type", "web_cloudops", "event_stream", "PT1H"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _sql_part(src: str, frm: str, panel: str, dom: str, klass: str, freq: str) -> str:
    return (
        f"SELECT '{src}' source_id, concat('{src}|', {panel}) series_key, '{dom}' \"domain\", "
        f"'{klass}' dgp_class, '{freq}' freq, '{dims.FREQ_BAND[freq]}' cadence, "
        f"CAST(ts AS TIMESTAMP) ts, CAST(c AS DOUBLE)/100.0 \"value\" FROM {frm}"
    )


BINS_SQL = f"""
ship AS (SELECT l_returnflag p, date_trunc('day', l_shipdate) ts,
   sum(CAST(round(l_extendedprice*100) AS BIGINT)) c FROM lineitem GROUP BY 1,2),
shipw AS (SELECT p, date_trunc('week', ts) ts, sum(c) c FROM ship GROUP BY 1,2),
ordr AS (SELECT o_orderpriority p, date_trunc('day', o_orderdate) ts,
   sum(CAST(round(o_totalprice*100) AS BIGINT)) c FROM orders GROUP BY 1,2),
ordrw AS (SELECT p, date_trunc('week', ts) ts, sum(c) c FROM ordr GROUP BY 1,2),
evt AS (SELECT event_type p, date_trunc('hour', ts) ts,
   sum(CAST(round("value"*100) AS BIGINT)) c FROM events GROUP BY 1,2),
bins AS (
 {_sql_part('ship_day', 'ship', 'p', 'transport', 'freight_volume', 'P1D')} UNION ALL
 {_sql_part('ship_week', 'shipw', 'p', 'transport', 'freight_weekly', 'P1W')} UNION ALL
 {_sql_part('order_day', 'ordr', 'p', 'sales', 'order_flow', 'P1D')} UNION ALL
 {_sql_part('order_week', 'ordrw', 'p', 'sales', 'order_weekly', 'P1W')} UNION ALL
 {_sql_part('event_hour', 'evt', 'p', 'web_cloudops', 'event_stream', 'PT1H')})
"""


def R(expr: str, digits: int = 6) -> str:
    """Rounded DuckDB expression without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE)"


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)
