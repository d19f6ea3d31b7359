"""Freshness audit and upkeep checks over run logs and the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import text as X, timeparse as T

DEFAULT_HORIZON_DAYS = 14.0


def freshness_audit(catalog: DataFrame, obs: DataFrame, now: str) -> DataFrame:
    """Newest readable stamp in each source's newest day, against its cadence-scaled limit.

    Stamps are made distinct before they are parsed; a stamp past the horizon
    does not count, so one mistyped year cannot keep a dead source alive.
    """
    newest_day = obs.groupBy("source_id").agg(F.max("scrape_date").alias("scrape_date"))
    last = obs.join(newest_day, ["source_id", "scrape_date"], "left_semi")
    stamps = last.groupBy("source_id", "timestamp").agg(
        F.count(F.lit(1)).alias("c"), F.count(F.expr("try_cast(replace(value, ',', '') AS DOUBLE)")).alias("num"))
    stamps = stamps.withColumn("t", F.expr(T.parse_ts("timestamp")))
    cat = catalog.withColumn("horizon", F.coalesce("forecast_horizon_days", F.lit(DEFAULT_HORIZON_DAYS)))
    nowts = F.unix_seconds(F.lit(now).cast("timestamp"))
    j = cat.select("source_id", "horizon").join(stamps, "source_id")
    per = j.groupBy("source_id").agg(
        F.sum("c").alias("rows"), F.max(F.when(F.unix_seconds("t") <= nowts + F.col("horizon") * 86400, F.col("t"))).alias("newest"),
        F.max("t").alias("raw_newest"), (F.sum("num") / F.sum("c")).alias("numeric_frac"))
    out = cat.join(per, "source_id", "left").withColumn("period_s", F.expr(T.duration_seconds("frequency")))
    out = out.withColumn("age_days", (nowts - F.unix_seconds("newest")) / 86400.0).withColumn(
        "limit_days", F.expr(f"coalesce(audit_slack_days, {T.stale_after_hours('frequency', 'period_s')} / 24)"))
    return out.withColumn("status", F.expr(
        "CASE WHEN disabled THEN 'disabled' WHEN rows IS NULL THEN 'nodata' WHEN newest IS NULL AND raw_newest IS NOT NULL THEN 'future' "
        "WHEN newest IS NULL THEN 'unparsed' WHEN age_days > limit_days THEN 'stale' ELSE 'ok' END"))


def auto_disable(audit: DataFrame, factor: float = 3.0) -> DataFrame:
    """Sources stale beyond ``factor`` times their limit turn disabled."""
    return audit.withColumn("disabled", F.col("disabled") | (
        (F.col("status") == "stale") & (F.round("age_days", 1) > factor * F.round("limit_days", 1))))


def numeric_fraction(rows: DataFrame, keys: list[str], seq: str, cols: list[str], first: int | None = None) -> DataFrame:
    """Share of numbers among the rows of each value column; blanks count against it.

    ``first`` looks at so many rows of each source only, in ``seq`` order; by default all count.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    head = rows if first is None else rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first)
    num = sum((F.count(F.expr(f"try_cast(replace({c}, ',', '') AS DOUBLE)")) for c in cols), F.lit(0))
    return head.groupBy(*keys).agg((num / (F.count(F.lit(1)) * len(cols))).alias("numeric_frac"), F.count(F.lit(1)).alias("n_head"))


def heartbeats(runs: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """Late when older than the period plus one extra period, capped at an hour of slack."""
    last = runs.groupBy("job").agg(F.max("at").alias("last_run"))
    age = F.greatest(F.lit(0.0), F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("last_run"))
    grace = F.col("period_s") + F.least("period_s", F.lit(3600))
    return jobs.join(last, "job", "left").withColumn("age_s", age).withColumn("status", F.when(
        F.col("last_run").isNull(), "missing").when(F.col("age_s") > grace, "late").otherwise("ok"))


SWEEP = (r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)[,.]\d+ \w+ sweep finished: (\d+) ok, (\d+) failed, "
         r"(\d+) skipped of (\d+) in ([\d.]+)s")
ERROR_LINE = r"^(\S+) (FETCH|PARSE|UNCAUGHT) (.*)$"


def parse_sweeps(log: DataFrame, line: str, *keep: str) -> DataFrame:
    g = lambda i: F.regexp_extract(line, SWEEP, i)
    return log.where(F.col(line).rlike(SWEEP)).select(
        *keep, g(1).alias("at"), g(2).cast("bigint").alias("ok"), g(3).cast("bigint").alias("failed"),
        g(4).cast("bigint").alias("skipped"), g(5).cast("bigint").alias("total"), g(6).cast("double").alias("seconds"))


def recent_sweeps(sweeps: DataFrame, keys: list[str], position: str, keep: int = 8) -> DataFrame:
    """The last ``keep`` sweeps per log and whether every one of them hit its deadline.

    Log lines are stamped to the second; within one second the line further down
    the log (``position``) is the later one.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc(position))
    r = sweeps.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("skipped") > 0).alias("skipping"),
        F.min_by("skipped", "_r").alias("skipped_last"), F.min_by("failed", "_r").alias("failed_last")).withColumn(
        "chronic", (F.col("skipping") == F.col("seen")) & (F.col("seen") > 2))


def parse_errors(log: DataFrame, line: str, *keep: str) -> DataFrame:
    g = lambda i: F.regexp_extract(line, ERROR_LINE, i)
    return log.where(F.col(line).rlike(ERROR_LINE)).select(
        *keep, F.try_to_timestamp(g(1)).alias("at"), g(2).alias("kind"), g(3).alias("msg")).withColumn(
        "reason", F.expr(X.error_reason("msg")))


def failure_rollup(errors: DataFrame, since: str) -> DataFrame:
    """Errors in the window by host, by source and by kind + reason, in one grouping-sets pass."""
    e = errors.where(F.col("at") >= F.lit(since).cast("timestamp")).withColumn("what", F.concat_ws(" ", "kind", "reason"))
    g = e.groupingSets([[F.col("host")], [F.col("source_id")], [F.col("what")]], F.col("host"), F.col("source_id"), F.col("what")).agg(
        F.count(F.lit(1)).alias("errors"), F.count_distinct("source_id").alias("sources"), F.grouping_id().alias("gid"))
    return g.select(F.expr("CASE gid WHEN 3 THEN 'host' WHEN 5 THEN 'source' ELSE 'reason' END").alias("axis"),
                    F.coalesce("host", "source_id", "what").alias("label"), "errors",
                    F.expr("CASE WHEN gid = 5 THEN 1 ELSE sources END").alias("sources"))


def culprit_hosts(rollup: DataFrame, floor: int = 20) -> DataFrame:
    return rollup.where((F.col("axis") == "host") & (F.col("errors") >= floor))


def silence(catalog: DataFrame, obs: DataFrame, today: str) -> DataFrame:
    """Days since each live source last wrote, against its poll period plus one day of slack."""
    last = obs.groupBy("source_id").agg(F.max("scrape_date").alias("last_day"))
    period = F.expr(f"coalesce({T.duration_seconds('poll')}, {T.duration_seconds('frequency')}, 86400)")
    j = catalog.where(~F.col("disabled")).join(last, "source_id", "left").withColumn(
        "allowed_days", F.greatest(F.lit(1), F.round(period / 86400).cast("int"))).withColumn(
        "days", F.datediff(F.lit(today).cast("date"), "last_day"))
    return j.withColumn("status", F.when(F.col("last_day").isNull(), "never").when(
        F.col("days") > F.col("allowed_days"), "behind").otherwise("writing"))


def undersampled(catalog: DataFrame, fast: DataFrame, max_period_s: int = 300) -> DataFrame:
    """Snapshot feeds declared fast but outside the every-minute band."""
    ts = F.trim(F.coalesce("timestamp_field", F.lit("")))
    snap = catalog.where(~F.col("disabled")).withColumn("period_s", F.expr(T.duration_seconds("frequency"))).where(
        (F.col("period_s") <= max_period_s) & ts.isin("", "now()", "current-state"))
    return snap.join(fast, "source_id", "left_anti")


MIN_REFRESH_S = 3600
MAX_REFRESH_S = 6 * 3600


def due_sources(catalog: DataFrame, last: DataFrame, now: str) -> DataFrame:
    """Which sources need a refresh: explicit poll, staggered backfill, frequency gate.

    ``last`` has source_id, last_seen and perhaps last_attempt; a source with a
    poll period counts from the later of the two.
    """
    since = lambda c: F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(c)
    j = catalog.join(last, "source_id", "left").withColumn("age_s", since("last_seen"))
    tried = F.least("age_s", since("last_attempt")) if "last_attempt" in last.columns else F.col("age_s")
    j = j.withColumn("poll_s", F.expr(T.duration_seconds("poll"))).withColumn("period_s", F.expr(T.duration_seconds("frequency")))
    stagger = F.lit(MIN_REFRESH_S) + (F.crc32("source_id") % 4) * 900
    fast = F.col("period_s").isNull() | (F.col("period_s") <= MIN_REFRESH_S)
    due = (F.when(F.col("poll_s") > 0, F.coalesce(tried >= F.col("poll_s"), F.lit(True))).when(F.col("age_s").isNull(), True)
           .when(fast & (F.col("window_days") >= 1), F.col("age_s") >= stagger).when(fast, True)
           .otherwise(F.col("age_s") >= F.least("period_s", F.lit(MAX_REFRESH_S))))
    return j.withColumn("due", due)


def producer_stats(runs: DataFrame) -> DataFrame:
    """Accumulated seconds, finds, wired and runs per producer, its yield and whether to bench it."""
    s = runs.groupBy("producer").agg(F.sum("seconds").alias("seconds"), F.sum("found").alias("found"),
                                     F.sum("wired").alias("wired"), F.count(F.lit(1)).alias("runs"))
    return s.withColumn("per_minute", F.expr("CASE WHEN seconds > 0 THEN 60 * wired / seconds END")).withColumn(
        "benched", F.expr("CASE WHEN seconds < 1800 THEN NULL WHEN wired = 0 THEN 'no yield' WHEN seconds / wired > 1800 THEN 'too slow' END"))


def findings(*checks: DataFrame) -> DataFrame:
    """Ranked findings: every check contributes (severity, check, detail) rows."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "check", "detail")


def overall_status(found: DataFrame) -> DataFrame:
    return found.agg(F.expr("CASE WHEN count_if(severity = 'critical') > 0 THEN 'critical' WHEN count(*) > 0 THEN 'warn' ELSE 'ok' END").alias("status"),
                     F.count(F.lit(1)).alias("n_findings"))
