"""Catalog analytics: coverage, diversity, gaps, vetting, admission, ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import dims
from tidemark.functions import text as X, timeparse as T
from tidemark.session import freeze


def live(catalog: DataFrame) -> DataFrame:
    return catalog.where(~F.coalesce("disabled", F.lit(False)))


def with_labels(catalog: DataFrame) -> DataFrame:
    """Band, host, access method and risk of every entry."""
    return catalog.select(
        "*", F.expr(T.duration_seconds("frequency")).alias("period_s")).select(
        "*", F.expr(T.cadence_band("frequency", sec="period_s")).alias("cadence"), F.expr(X.netloc("url")).alias("host"),
        F.expr(X.access_method("cadence_note", "auth", "endpoint_type")).alias("access_method"),
        F.coalesce(F.expr(dims.sql_case("lower(novelty)", dims.NOVELTY_RISK)), F.lit("medium")).alias("contamination_risk"),
        F.expr(X.first_available("last_verified", "history")).alias("first_available_date"))


def coverage_matrix(cat: DataFrame) -> DataFrame:
    """Counts per domain x cadence with both margins and the grand total."""
    return cat.cube("domain", "cadence").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("domain", F.lit("TOTAL")).alias("domain"), F.coalesce("cadence", F.lit("TOTAL")).alias("cadence"), "n")


def coverage_summary(cat: DataFrame) -> DataFrame:
    """One scan, four breakdowns (grouping sets)."""
    axes = ["domain", "cadence", "contamination_risk", "access_method"]
    g = cat.groupingSets([[F.col(a)] for a in axes], *[F.col(a) for a in axes]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    axis = F.expr("CASE gid " + " ".join(f"WHEN {15 - (8 >> i)} THEN '{a}'" for i, a in enumerate(axes)) + " END")
    return g.select(axis.alias("axis"), F.coalesce(*axes).alias("label"), "n")


def host_counts(cat: DataFrame, *keys: str) -> DataFrame:
    return cat.groupBy(*keys, "host").agg(F.count(F.lit(1)).alias("n"))


def diversity(cat: DataFrame, cap: int = 5) -> DataFrame:
    """Sources, hosts, the top host's share, and the count with at most ``cap`` per host."""
    h = host_counts(cat, "domain")
    top = F.max(F.struct("n", "host"))
    return h.groupBy("domain").agg(
        F.sum("n").alias("sources"), F.count(F.lit(1)).alias("hosts"), top.alias("t"),
        F.sum(F.least("n", F.lit(cap))).alias("effective")).select(
        "domain", "sources", "hosts", F.round(F.col("t.n") / F.col("sources"), 3).alias("top_host_share"), "effective")


def domain_rows(spark, names=dims.DOMAINS) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in names])).alias("domain"))


def gap_cells(cat: DataFrame) -> DataFrame:
    """Every fixed (domain, band) cell below its target, worst first."""
    cells = domain_rows(cat.sparkSession).withColumn(
        "cadence", F.explode(F.array(*[F.lit(b) for b in dims.CADENCE_BANDS])))
    have = cat.groupBy("domain", "cadence").agg(F.count(F.lit(1)).alias("have"))
    high = F.col("cadence").isin(*dims.HIGH_VALUE_BANDS)
    j = cells.join(have, ["domain", "cadence"], "left").select(
        "domain", "cadence", F.coalesce("have", F.lit(0).cast("bigint")).alias("have"), high.alias("high_value"),
        F.when(high, dims.TARGET_PER_HIGH_VALUE_CELL).otherwise(dims.TARGET_PER_CELL).cast("bigint").alias("target"))
    j = j.withColumn("deficit", F.col("target") - F.col("have")).where("deficit > 0")
    return j.orderBy(F.desc("deficit"), F.desc("high_value"), "domain")


def weakest_domains(cat: DataFrame, n: int = 3, cap: int = 5) -> DataFrame:
    """Thinnest domains by effective count; a domain with nothing counts as zero."""
    d = domain_rows(cat.sparkSession).join(diversity(cat, cap), "domain", "left").select(
        "domain", F.coalesce("effective", F.lit(0).cast("bigint")).alias("effective"))
    return d.orderBy("effective", "domain").limit(n)


def rank_candidates(cands: DataFrame, cells: DataFrame, targets: list[str], per_host: int) -> DataFrame:
    """Finds that most improve balance; the host cap applies while ranking."""
    j = cands.join(cells.select("domain", "cadence", F.col("have").alias("cell_n")), ["domain", "cadence"], "left")
    keys = [F.when(F.col("domain").isin(*targets), 0).otherwise(1), F.coalesce("cell_n", F.lit(0)),
            F.when(F.col("cadence").isin(*dims.HIGH_VALUE_BANDS), 0).otherwise(1), F.col("seq")]
    w = Window.partitionBy("host").orderBy(*keys)
    j = j.withColumn("host_rank", F.row_number().over(w)).where(F.col("host_rank") <= per_host)
    return j.orderBy(*keys)


def numeric_text(c: str) -> str:
    return f"try_cast(replace({c}, ',', '') AS DOUBLE)"


# --- vetting -------------------------------------------------------------------------------


def schema_errors(cols: list[str]) -> Column:
    """Missing fields and out-of-vocabulary values, in field order."""
    miss = [f"CASE WHEN {c} IS NULL OR CAST({c} AS STRING) = '' THEN \"missing/empty field '{c}'\" END" if c in cols
            else f"\"missing/empty field '{c}'\"" for c in dims.CANDIDATE_FIELDS]
    vocab = [("access_method", dims.ACCESS_METHODS), ("contamination_risk", dims.RISK_LEVELS), ("confidence", dims.CONFIDENCE_LEVELS)]
    bad = [f"CASE WHEN {c} <> '' AND {c} NOT IN ({', '.join(repr(v) for v in vs)}) THEN concat(\"invalid {c} '\", {c}, \"'\") END"
           for c, vs in vocab]
    return F.expr(f"array_compact(array({', '.join(miss + bad)}))")


def vet(cands: DataFrame, registry: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger, schema, denylist, duplicate host and novelty claim -> accept / flag / reject.

    The registry collapses to one row per (domain, host) before the join, so a
    host with a third of the catalog cannot multiply candidates.
    """
    cutoff = max(dims.MODEL_CUTOFFS.values())
    first = registry.groupBy("domain", F.expr(X.host("url")).alias("vhost")).agg(F.min_by("source_id", "seq").alias("dup_id")).where("vhost <> ''")
    c = cands.withColumn("key", F.expr(X.ledger_key("domain", "url_or_endpoint", "name"))).withColumn("vhost", F.expr(X.host("url_or_endpoint")))
    c = c.join(ledger.select("key", "first_proposed", "times_proposed", F.col("status").alias("led_status")), "key", "left")
    c = c.join(first, ["domain", "vhost"], "left")
    hay = "concat_ws(' ', coalesce(name, ''), coalesce(url_or_endpoint, ''), coalesce(contamination_reasoning, ''))"
    c = c.withColumn("_errs", schema_errors(cands.columns)).withColumn("_deny", F.expr(X.denylisted(hay)))
    soft = F.expr(f"""array_compact(array(
      CASE WHEN dup_id IS NOT NULL THEN concat("same host+domain as existing source '", dup_id, "' (", vhost, ')') END,
      CASE WHEN contamination_risk = 'low' AND NOT supports_live_future_tasks AND NOT (substr(first_available_date, 1, 10) > '{cutoff}')
        THEN 'low contamination claim without live data or post-cutoff start' END,
      CASE WHEN confidence = 'high' AND trim(verify) = '' THEN 'high confidence with an empty verify note' END))""")
    reasons = F.expr("""CASE WHEN led_status IS NOT NULL THEN array(concat('already proposed on ', first_proposed, ' (status=', led_status, ', seen ', times_proposed, 'x)'))
      WHEN size(_errs) > 0 THEN _errs WHEN _deny IS NOT NULL THEN array(concat("matches contamination denylist token '", _deny, "'")) ELSE _soft END""")
    c = c.withColumn("_soft", soft).withColumn("reasons", reasons)
    verdict = F.expr("CASE WHEN led_status IS NOT NULL OR size(_errs) > 0 OR _deny IS NOT NULL THEN 'reject' WHEN size(reasons) > 0 THEN 'flag' ELSE 'accept' END")
    return c.withColumn("verdict", verdict).drop("_errs", "_deny", "_soft", "vhost", "dup_id", "first_proposed", "times_proposed", "led_status")


def verdict_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.array_position(F.array(F.lit("accept"), F.lit("flag"), F.lit("reject")), F.col("verdict")))


STICKY = ("wired", "key-gated", "retired")


def ledger_upsert(ledger: DataFrame, batch: DataFrame, run_date: str) -> DataFrame:
    """Keyed full-outer merge of one vetted batch; sticky statuses are never downgraded.

    The batch is reduced per key first: a key proposed a million times in one
    run arrives at the join as one row.
    """
    b = batch.groupBy("key").agg(
        F.count(F.lit(1)).alias("b_times"), F.min_by("name", "seq").alias("b_name"), F.min_by("domain", "seq").alias("b_domain"),
        F.min_by("frequency", "seq").alias("b_freq"), F.min_by("verdict", "seq").alias("b_first_verdict"),
        F.max(F.when(F.col("verdict") == "reject", 1).otherwise(0)).alias("b_rej"))
    j = ledger.join(b, "key", "full_outer")
    new = F.col("first_proposed").isNull()
    # a later rejection downgrades a new entry too, exactly as a second upsert would
    status = (F.when(new, F.when(F.col("b_rej") == 1, "rejected").otherwise("proposed"))
              .when((F.col("b_rej") == 1) & ~F.col("status").isin(*STICKY), "rejected").otherwise(F.col("status")))
    return j.select(
        "key", F.coalesce("name", F.substring("b_name", 1, 80)).alias("name"), F.coalesce("domain", "b_domain").alias("domain"),
        F.coalesce("frequency", "b_freq").alias("frequency"), status.alias("status"), F.coalesce("first_proposed", F.lit(run_date)).alias("first_proposed"),
        (F.coalesce("times_proposed", F.lit(0)) + F.coalesce("b_times", F.lit(0))).alias("times_proposed"))


def settle_ledger(ledger: DataFrame, outcome: DataFrame) -> DataFrame:
    """Move entries still 'proposed' to their terminal status, matched by name."""
    rank = F.array_position(F.array(F.lit("rejected"), F.lit("key-gated"), F.lit("wired")), F.col("outcome"))
    o = outcome.groupBy("name").agg(F.max_by("outcome", rank).alias("outcome"))
    return ledger.join(o, "name", "left").withColumn("status", F.when(
        (F.col("status") == "proposed") & F.col("outcome").isNotNull(), F.col("outcome")).otherwise(F.col("status"))).drop("outcome")


def ledger_lines(ledger: DataFrame) -> DataFrame:
    """One terse line per entry, most proposed first."""
    host = "substr(key, instr(key, '|') + 1)"
    line = f"concat({host}, if(name <> '' AND name <> {host}, concat(' — e.g. ', name), ''), ' [', status, ']')"
    return ledger.orderBy(F.desc("times_proposed"), "key").select("key", F.expr(line).alias("line"))


def endpoint_identity() -> Column:
    """URL, canonical request body and the selected lane: two entries agreeing on all are duplicates."""
    sel = "named_struct('panel_field', panel_field, 'timestamp_field', timestamp_field, 'value_field', value_field)"
    return F.expr(f"concat(url, if(body IS NULL, '', concat('#', body)), if(coalesce(panel_field, timestamp_field, value_field) IS NULL, '', concat('@', to_json({sel}))))")


# --- admission -------------------------------------------------------------------------------
MAX_ADMISSION_PERIOD_S = 3600
EVAL_FLOOR = 320


def admission_gate(records: DataFrame, entries: DataFrame, now: str) -> DataFrame:
    """Cadence bar, volume (rows, stamps, numbers or entities) and freshness of fetched rows."""
    r = records.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("timestamp").alias("n_stamps"),
        F.count(F.expr("try_cast(value AS DOUBLE)")).alias("n_numeric"), F.count_distinct("entity").alias("n_entities"),
        F.max(F.expr("try_cast(timestamp AS TIMESTAMP)")).alias("newest"))
    e = entries.withColumn("period_s", F.expr(T.duration_seconds("frequency"))).withColumn(
        "limit_h", F.expr(f"coalesce(audit_slack_days * 24, {T.stale_after_hours('frequency', 'period_s')})"))
    j = e.join(r, "entry_id", "left").withColumn(
        "age_h", (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("newest")) / 3600)
    volume = "((n_rows >= 20 AND n_stamps >= 20 AND n_numeric >= 0.5 * n_rows) OR (n_entities >= 20 AND n_numeric >= 20))"
    return j.withColumn("gate", F.expr(f"""CASE WHEN period_s > {MAX_ADMISSION_PERIOD_S} AND NOT admit_slow THEN 'too slow'
      WHEN n_rows IS NULL OR NOT {volume} THEN 'too thin' WHEN newest IS NULL THEN 'no readable stamps'
      WHEN age_h > limit_h THEN 'stale' ELSE 'pass' END"""))


def wiring_decision(items: DataFrame, existing: DataFrame, gate: DataFrame) -> DataFrame:
    """Verdict per candidate: duplicate id or lane, bad domain, gate result, key-gated, rejected."""
    ids = existing.select("source_id").distinct().withColumn("_dup_id", F.lit(True))
    lanes = existing.select("lane").distinct().withColumn("_dup_lane", F.lit(True))
    j = (items.join(ids, items.entry_id == ids.source_id, "left").drop("source_id").join(lanes, "lane", "left")
         .join(gate.select("entry_id", "gate"), "entry_id", "left"))
    # of one batch's entries on a lane the first keeps the slot: reduced per lane, then joined
    twin = j.where((F.col("gate") == "pass") & F.col("wireable")).groupBy("lane").agg(F.min("seq").alias("_twin"))
    j = j.join(twin, "lane", "left")
    gated = F.lower("reason").rlike("api key|api-key|token|credential|registration|auth")
    return j.withColumn("verdict", F.when(~F.col("wireable"), F.when(gated, "key-gated").otherwise("rejected"))
                        .when(F.coalesce("_dup_id", "_dup_lane", F.lit(False)), "duplicate")
                        .when(~F.col("domain").isin(*dims.DOMAINS), "bad-domain")
                        .when(F.coalesce(F.col("_twin") < F.col("seq"), F.lit(False)), "duplicate")
                        .when(F.col("gate") == "pass", "wire").otherwise("verify-fail")).drop("_dup_id", "_dup_lane", "_twin")


def pool_mix(sources: DataFrame, cell: list[str], source: str, series: str) -> tuple[DataFrame, DataFrame]:
    """Expected mix and totals of a pool.

    ``sources`` has one row per live source with its number of eligible series
    (null: none). The mix has a row per cell with eligible series: their number
    and the share of draws it gets when all such cells weigh alike. The totals are one row.
    """
    s = freeze(sources.select(*cell, source, series))
    cells = s.where(F.col(series).isNotNull()).groupBy(*cell).agg(F.sum(series).alias("cell_series"))
    totals = s.agg(F.count(source).alias("live_sources"), F.count(series).alias("eligible_sources"), F.count_if(F.col(series).isNull()).alias("ineligible_sources"),
                   F.coalesce(F.sum(series), F.lit(0)).alias("eligible_series"))
    totals = totals.join(cells.agg(F.count(F.lit(1)).alias("cells")))  # two single rows
    mix = cells.join(F.broadcast(totals.select("cells"))).select(*cell, "cell_series", (1 / F.col("cells")).alias("draw_share"))
    return mix, totals
