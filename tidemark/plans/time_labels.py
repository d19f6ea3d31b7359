"""Timestamp and label functions over stamps re-written from the tables' own dates.

Every row's date is spelled in one of the accepted shapes and parsed back; the
DuckDB twin states the instant the label stands for straight from the date.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timeparse as T
from tidemark.plans.views import load
from tidemark.registry import query

# (Spark text of the label, DuckDB text of the instant it stands for)
_D = "o_orderdate"
_SHAPES = [
    (f"date_format({_D}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", _D),
    (f"date_format({_D}, 'yyyy-MM-dd HH:mm')", _D),
    (f"date_format({_D}, 'yyyy-MM')", f"date_trunc('month', {_D})"),
    (f"CAST(unix_seconds(CAST({_D} AS TIMESTAMP)) AS STRING)", f"CASE WHEN epoch({_D}) >= 1000000000 THEN {_D} END"),
    (f"CAST(unix_millis(CAST({_D} AS TIMESTAMP)) AS STRING)", f"CASE WHEN epoch({_D})*1000 >= 1e12 THEN {_D} END"),
    (f"date_format({_D}, 'yyyyMMdd')", _D),
    (f"date_format({_D}, 'yyyyMMddHHmmss')", _D),
    (f"concat(year({_D}), 'Q', quarter({_D}))", f"date_trunc('quarter', {_D})"),
    (f"date_format({_D}, \"yyyy'M'MM\")", f"date_trunc('month', {_D})"),
    (f"concat(extract(YEAROFWEEK FROM {_D}), '-W', lpad(weekofyear({_D}), 2, '0'))", f"date_trunc('week', {_D})"),
    (f"date_format({_D}, \"ddHHmm'Z' MMM yyyy\")", _D),
    (f"date_format({_D}, \"dd-MM-yyyy '24:00'\")", f"{_D} + INTERVAL 1 DAY"),
    (f"date_format({_D}, \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\")", _D),
    (f"date_format({_D}, 'ddMMMyyyy')", _D),
    (f"date_format({_D}, 'dd.MM.yyyy')", _D),
    (f"date_format({_D}, 'MMM-yy')", f"date_trunc('month', {_D})"),
    (f"date_format({_D}, 'yyyy MMM')", f"date_trunc('month', {_D})"),
    (f"concat('n/a ', o_orderkey)", "NULL"),
]
_N = len(_SHAPES)


def _pick(k: int) -> str:
    arms = " ".join(f"WHEN {i} THEN {s[k]}" for i, s in enumerate(_SHAPES))
    return f"CASE o_orderkey % {_N} {arms} END"


@query("parse_timestamps", "F1 A16", f"SELECT o_orderkey, CAST(epoch({_pick(1)}) AS BIGINT) parsed_epoch FROM orders".replace(
    "CASE WHEN epoch(o_orderdate)*1000 >= 1e12", "CASE WHEN length(CAST(CAST(epoch(o_orderdate)*1000 AS BIGINT) AS VARCHAR)) = 13"))
def parse_timestamps(spark, sf):
    raw = load(spark, sf, "orders").select("o_orderkey", F.expr(_pick(0)).alias("stamp"))
    return raw.select("o_orderkey", F.expr(f"unix_seconds({T.parse_ts('stamp')})").alias("parsed_epoch"))


@query("slash_dates", "F7", """SELECT o_orderkey, CAST(epoch(CASE WHEN day(o_orderdate) > 12 THEN o_orderdate
  ELSE (CASE WHEN greatest(o_orderdate, make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))) + to_hours(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 24 AS INT) ELSE 0 END) <= TIMESTAMP '2001-09-01'
    THEN greatest(o_orderdate, make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)))
    ELSE least(o_orderdate, make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))) END) END) AS BIGINT)
  + (CASE WHEN o_orderkey % 3 = 0 THEN 3600*(o_orderkey % 24) ELSE 0 END) parsed_epoch FROM orders""")
def slash_dates(spark, sf):
    """Day and month readings of the same label; the later one that is not in the future wins."""
    lab = ("concat(date_format(o_orderdate, if(o_orderkey % 2 = 0, 'dd/MM/yyyy', 'MM/dd/yyyy')), "
           "if(o_orderkey % 3 = 0, concat(' ', o_orderkey % 24 + 1), ''))")
    raw = load(spark, sf, "orders").select("o_orderkey", F.expr(lab).alias("stamp"))
    now = "TIMESTAMP'2001-08-01 00:00:00'"
    return raw.select("o_orderkey", F.expr(f"unix_seconds({T.slash_date('stamp', now)})").alias("parsed_epoch"))


@query("epoch_or_label", "F2", """SELECT event_id, CASE event_id % 8
 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') WHEN 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00')
 WHEN 2 THEN CAST(year(ts) AS VARCHAR) WHEN 3 THEN strftime(ts, '%Y%m%d') WHEN 4 THEN strftime(date_trunc('week', ts), '%Y-%m-%d')
 WHEN 5 THEN concat(year(ts), '-', lpad(CAST(least(CAST(floor((event_id % 1000)/1000.0*12) AS INT)+1, 12) AS VARCHAR), 2, '0'), '-01')
 WHEN 6 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') ELSE event_type END stamp FROM events""")
def epoch_or_label(spark, sf):
    lab = """CASE event_id % 8 WHEN 0 THEN CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS STRING)
      WHEN 1 THEN CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING) WHEN 2 THEN CAST(year(ts) AS STRING)
      WHEN 3 THEN date_format(ts, 'yyyyMMdd') WHEN 4 THEN concat(extract(YEAROFWEEK FROM ts), '-W', lpad(weekofyear(ts), 2, '0'))
      WHEN 5 THEN concat(year(ts), '.', lpad(event_id % 1000, 3, '0'))
      WHEN 6 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00Z'") ELSE event_type END"""
    raw = load(spark, sf, "events").select("event_id", F.expr(lab).alias("raw"))
    return raw.select("event_id", F.expr(T.epoch_or_label("raw")).alias("stamp"))


@query("compose_timestamps", "F3", """SELECT o_orderkey, CASE o_orderkey % 5
 WHEN 0 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T', lpad(CAST((o_orderkey // 5) % 24 AS VARCHAR), 2, '0'), ':00:00')
 WHEN 1 THEN concat(strftime(o_orderdate, '%Y-%m-%dT'), lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0'), ':00')
 WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN strftime(o_orderdate, '%Y-%m')
 ELSE concat(year(o_orderdate), ' ', o_orderstatus) END stamp,
 strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') week_stamp,
 concat(strftime(o_orderdate, '%Y-%m-%d'), 'T', lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'), ':00:00') hour_stamp FROM orders""")
def compose_timestamps(spark, sf):
    parts = """CASE o_orderkey % 5
      WHEN 0 THEN array(date_format(o_orderdate, 'yyyy/MM/dd'), CAST((o_orderkey div 5) % 24 + 1 AS STRING))
      WHEN 1 THEN array(CAST(year(o_orderdate) AS STRING), CAST(month(o_orderdate) AS STRING), CAST(day(o_orderdate) AS STRING),
        CAST(o_orderkey % 24 AS STRING), CAST(o_orderkey % 60 AS STRING))
      WHEN 2 THEN array(CAST(year(o_orderdate) AS STRING), CAST(month(o_orderdate) AS STRING))
      WHEN 3 THEN array(CAST(year(o_orderdate) AS STRING), date_format(o_orderdate, 'MMMM'))
      ELSE array(CAST(year(o_orderdate) AS STRING), o_orderstatus) END"""
    raw = load(spark, sf, "orders").select(
        "o_orderkey", F.expr(parts).alias("p"),
        F.expr("array(CAST(extract(YEAROFWEEK FROM o_orderdate) AS STRING), CAST(weekofyear(o_orderdate) AS STRING))").alias("yw"),
        F.expr("array(date_format(o_orderdate, 'yyyy-MM-dd'), CAST(o_orderkey % 24 AS STRING))").alias("dh"))
    return raw.select("o_orderkey", F.expr(T.compose_ts("p")).alias("stamp"),
                      F.expr(T.compose_ts("yw", year_week=True)).alias("week_stamp"),
                      F.expr(T.compose_ts("dh", hour_of_day=True)).alias("hour_stamp"))


@query("statbank_labels", "F4", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m')
 WHEN 1 THEN concat(year(o_orderdate), '-Q', quarter(o_orderdate)) WHEN 2 THEN strftime(o_orderdate, '%G-W%V') ELSE strftime(o_orderdate, '%Y-%m-%d') END "label",
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE strftime(o_orderdate, '%Y-%m') END composed FROM orders""")
def statbank_labels(spark, sf):
    lab = """CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, "yyyy'M'MM") WHEN 1 THEN concat(year(o_orderdate), if(o_orderkey % 8 = 1, 'K', 'Q'), quarter(o_orderdate))
      WHEN 2 THEN concat(extract(YEAROFWEEK FROM o_orderdate), 'W', lpad(weekofyear(o_orderdate), 2, '0')) ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"""
    parts = "array(CAST(year(o_orderdate) AS STRING), if(o_orderkey % 3 = 0, '1. - 12.', concat(month(o_orderdate), '.')))"
    raw = load(spark, sf, "orders").select("o_orderkey", F.expr(lab).alias("l"), F.expr(parts).alias("p"))
    return raw.select("o_orderkey", F.expr(T.statbank_label("l")).alias("label"), F.expr(T.compose_statbank("p")).alias("composed"))


@query("period_ends", "F5", """SELECT o_orderkey, strftime(CASE o_orderkey % 7 WHEN 0 THEN make_date(year(o_orderdate), 12, 31)
 WHEN 1 THEN last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)
 WHEN 2 THEN CASE WHEN month(o_orderdate) <= 6 THEN make_date(year(o_orderdate), 6, 30) ELSE make_date(year(o_orderdate), 12, 31) END
 WHEN 3 THEN CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) WHEN 4 THEN last_day(o_orderdate) WHEN 5 THEN CAST(o_orderdate AS DATE) END, '%Y-%m-%d') period_end FROM orders""")
def period_ends(spark, sf):
    lab = """CASE o_orderkey % 7 WHEN 0 THEN date_format(o_orderdate, 'yyyy') WHEN 1 THEN concat(year(o_orderdate), '-Q', quarter(o_orderdate))
      WHEN 2 THEN concat(year(o_orderdate), '-S', if(month(o_orderdate) <= 6, 1, 2))
      WHEN 3 THEN concat(extract(YEAROFWEEK FROM o_orderdate), '-W', lpad(weekofyear(o_orderdate), 2, '0'))
      WHEN 4 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 5 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE 'latest' END"""
    raw = load(spark, sf, "orders").select("o_orderkey", F.expr(lab).alias("p"))
    return raw.select("o_orderkey", F.expr(f"CAST({T.period_end('p')} AS STRING)").alias("period_end"))


@query("loose_dates", "F6", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END d FROM orders""")
def loose_dates(spark, sf):
    lab = """CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy')
      WHEN 2 THEN date_format(o_orderdate, 'd.M.yyyy') WHEN 3 THEN date_format(o_orderdate, 'yyyyMMdd') ELSE o_orderpriority END"""
    raw = load(spark, sf, "orders").select("o_orderkey", F.expr(lab).alias("s"))
    return raw.select("o_orderkey", F.expr(f"CAST({T.loose_date('s')} AS STRING)").alias("d"))


_DUR = """CASE o_orderkey % 9 WHEN 0 THEN concat('PT', k, 'S') WHEN 1 THEN concat('PT', k, 'M') WHEN 2 THEN concat('PT', k, 'H')
 WHEN 3 THEN concat('P', k, 'D') WHEN 4 THEN concat('P', k, 'W') WHEN 5 THEN concat('P', k, 'M') WHEN 6 THEN concat('P', k, 'Y')
 WHEN 7 THEN concat('P', k, 'DT', k, 'H', k, 'M') ELSE 'irregular' END"""
_SECS = """CASE o_orderkey % 9 WHEN 0 THEN k WHEN 1 THEN k*60 WHEN 2 THEN k*3600 WHEN 3 THEN k*86400 WHEN 4 THEN k*604800
 WHEN 5 THEN k*2592000 WHEN 6 THEN k*31536000 WHEN 7 THEN k*86400+k*3600+k*60 END"""
_BAND = "CASE WHEN s IS NULL THEN 'irregular' WHEN freq = 'PT8H' THEN 'hourly' WHEN s < 60 THEN 'sub-min' WHEN freq = 'PT1M' THEN 'sub-min' " \
        "WHEN s <= 900 THEN 'few-min' WHEN s <= 1800 THEN 'half-hour' WHEN s <= 10800 THEN 'hourly' WHEN s <= 259200 THEN 'daily' " \
        "WHEN s <= 1209600 THEN 'weekly' WHEN s <= 3888000 THEN 'monthly' WHEN s <= 17280000 THEN 'quarterly' ELSE 'yearly' END"
_AGE = "(o_orderkey % 40) / 10.0"


@query("durations_and_bands", "F8 F9 F11 F12 F26", f"""WITH f AS (SELECT o_orderkey, k, {_DUR} freq, {_SECS} s FROM (SELECT *, o_orderkey // 9 % 30 + 1 k FROM orders))
SELECT o_orderkey, freq, CAST(s AS BIGINT) AS "seconds", {_BAND} band,
 CAST(CASE WHEN s IS NULL THEN 1080 WHEN s >= 7000000 THEN 13200 WHEN s >= 2000000 THEN 2400 WHEN s >= 500000 THEN 840 ELSE greatest(s*8/3600.0, 72) END AS DOUBLE) stale_hours,
 CASE WHEN {_AGE} > 2 THEN 'P1D' WHEN {_AGE} > 0.25 THEN 'PT1H' WHEN freq IN ('PT1M','PT5M','PT15M','PT30M','PT1H') THEN freq ELSE 'P1D' END poll,
 CASE freq WHEN 'PT1M' THEN 'min' WHEN 'PT5M' THEN '5min' WHEN 'PT15M' THEN '15min' WHEN 'PT30M' THEN '30min' WHEN 'PT1H' THEN 'h' WHEN 'P1D' THEN 'D' WHEN 'P1W' THEN 'W' WHEN 'P1M' THEN 'MS' END offset_alias FROM f""")
def durations_and_bands(spark, sf):
    raw = load(spark, sf, "orders").withColumn("k", F.expr("o_orderkey div 9 % 30 + 1")).select("o_orderkey", F.expr(_DUR).alias("freq")).withColumn(
        "seconds", F.expr(T.duration_seconds("freq")))
    alias = "CASE freq WHEN 'PT1M' THEN 'min' WHEN 'PT5M' THEN '5min' WHEN 'PT15M' THEN '15min' WHEN 'PT30M' THEN '30min' WHEN 'PT1H' THEN 'h' WHEN 'P1D' THEN 'D' WHEN 'P1W' THEN 'W' WHEN 'P1M' THEN 'MS' END"
    return raw.select("o_orderkey", "freq", "seconds",
                      F.expr(T.cadence_band("freq", sec="seconds")).alias("band"), F.expr(T.stale_after_hours("freq", "seconds")).alias("stale_hours"),
                      F.expr(T.poll_cadence("freq", "o_orderkey % 40 / 10.0D")).alias("poll"), F.expr(alias).alias("offset_alias"))


@query("label_frequency_and_slack", "F31 F32", """WITH l AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'P1Y' WHEN 1 THEN 'P1M' WHEN 2 THEN 'P3M' WHEN 3 THEN 'P6M' ELSE 'P1W' END freq,
 CASE o_orderkey % 5 WHEN 0 THEN CAST(date_trunc('year', o_orderdate) AS DATE) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 2 THEN CAST(date_trunc('quarter', o_orderdate) AS DATE)
  WHEN 3 THEN CASE WHEN month(o_orderdate) <= 6 THEN make_date(year(o_orderdate),1,1) ELSE make_date(year(o_orderdate),7,1) END END st, (o_orderkey % 900)::INT age, (o_orderkey % 200)*3600 gap FROM orders)
SELECT o_orderkey, freq, CAST(date_diff('day', st, DATE '2002-01-01') AS INT) age_days,
 CASE freq WHEN 'P1Y' THEN 500 WHEN 'P6M' THEN 300 WHEN 'P3M' THEN 180 WHEN 'P1M' THEN 75 WHEN 'P1W' THEN 30 END statbank_slack,
 greatest(CASE freq WHEN 'P1W' THEN 30 WHEN 'P1M' THEN 75 WHEN 'P3M' THEN 200 WHEN 'P6M' THEN 320 ELSE 500 END, age + CASE freq WHEN 'P1W' THEN 7 WHEN 'P1M' THEN 31 WHEN 'P3M' THEN 92 WHEN 'P6M' THEN 184 ELSE 366 END + 45) agency_slack,
 CASE WHEN gap <= 7200 THEN age+3 WHEN gap <= 129600 THEN greatest(14, age+10) ELSE age+45 END gap_slack, age+45 flat_slack FROM l""")
def label_frequency_and_slack(spark, sf):
    lab = """CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy') WHEN 1 THEN date_format(o_orderdate, "yyyy'M'MM")
      WHEN 2 THEN concat(year(o_orderdate), 'K', quarter(o_orderdate)) WHEN 3 THEN concat(year(o_orderdate), 'H', if(month(o_orderdate) <= 6, 1, 2))
      ELSE concat(extract(YEAROFWEEK FROM o_orderdate), 'W', lpad(weekofyear(o_orderdate), 2, '0')) END"""
    raw = load(spark, sf, "orders").select("o_orderkey", F.expr(lab).alias("p"), F.expr("CAST(o_orderkey % 900 AS INT)").alias("age"),
                                           F.expr("o_orderkey % 200 * 3600").alias("gap"))
    raw = raw.withColumn("freq", F.expr(T.label_freq("p")))
    return raw.select("o_orderkey", "freq", F.expr(T.label_age_days("p", "DATE'2002-01-01'")).alias("age_days"),
                      F.expr(T.slack_statbank("freq")).alias("statbank_slack"), F.expr(T.slack_agency("freq", "age")).alias("agency_slack"),
                      F.expr(T.slack_by_gap("gap", "age")).alias("gap_slack"), F.expr(T.slack_flat("age")).alias("flat_slack"))
