"""Catalog coverage, vetting, admission and ledger queries.

Suppliers stand in for catalog entries (a third of them behind one host) and
customers for proposed candidates, so both sides grow with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import timeparse as T
from tidemark.operators import catalog as C
from tidemark.plans.text_rules import deny_sql
from tidemark.plans.views import R, load, rnd
from tidemark.registry import query

_DOM = "CASE r_name WHEN 'AFRICA' THEN 'nature' WHEN 'AMERICA' THEN 'econ_fin' WHEN 'ASIA' THEN 'transport' WHEN 'EUROPE' THEN 'energy' ELSE 'sales' END"
# text valid in both engines
_CAT = {
    "source_id": "s_name", "seq": "s_suppkey", "domain": _DOM, "dgp_class": "n_name",
    "frequency": "CASE s_suppkey % 8 WHEN 0 THEN 'PT30S' WHEN 1 THEN 'PT5M' WHEN 2 THEN 'PT1H' WHEN 3 THEN 'P1D' WHEN 4 THEN 'P1W' WHEN 5 THEN 'P1M' WHEN 6 THEN 'irregular' ELSE 'PT10S' END",
    "url": "CASE WHEN s_suppkey % 3 = 0 THEN concat('https://www.hub.example.org/s/', s_suppkey) ELSE concat('https://api-', lower(n_name), '.example.org:8443/v1/', s_suppkey) END",
    "auth": "CASE WHEN s_suppkey % 5 = 0 THEN 'env:KEY' ELSE 'none' END",
    "endpoint_type": "CASE WHEN s_suppkey % 7 = 0 THEN 'bulk_zip' ELSE 'rest_json' END",
    "cadence_note": "CASE WHEN s_suppkey % 11 = 0 THEN 'Near Real-Time' ELSE 'daily' END",
    "novelty": "CASE s_suppkey % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'Partial' WHEN 2 THEN 'contaminated' END",
    "last_verified": "CASE WHEN s_suppkey % 2 = 0 THEN '2024-05-01' ELSE 'never' END",
    "history": "CASE WHEN s_suppkey % 3 = 0 THEN '10y' END",
    "disabled": "(s_suppkey % 10 = 9)",
}
_BAND = ("CASE frequency WHEN 'PT30S' THEN 'sub-min' WHEN 'PT10S' THEN 'sub-min' WHEN 'PT5M' THEN 'few-min' WHEN 'PT1H' THEN 'hourly' "
         "WHEN 'P1D' THEN 'daily' WHEN 'P1W' THEN 'weekly' WHEN 'P1M' THEN 'monthly' ELSE 'irregular' END")
CAT_SQL = ("cat0 AS (SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in _CAT.items())
           + " FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
           f"cat AS (SELECT *, {_BAND} cadence, regexp_extract(url, '^https?://([^/?#]+)', 1) host FROM cat0 WHERE NOT disabled)")


def catalog(spark, sf):
    s, n, r = load(spark, sf, "supplier"), load(spark, sf, "nation"), load(spark, sf, "region")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.selectExpr(*[f"{v} AS {k}" for k, v in _CAT.items()])


def live_catalog(spark, sf):
    return C.with_labels(C.live(catalog(spark, sf)))


@query("catalog_labels", "A3 F9 F20 F34", f"""WITH {CAT_SQL} SELECT source_id, "domain", cadence, host,
 CASE WHEN cadence_note = 'Near Real-Time' THEN 'live_stream' WHEN auth LIKE 'env:%' THEN 'licensed' WHEN contains(endpoint_type, 'zip') THEN 'bulk_download' ELSE 'open_api' END access_method,
 CASE lower(novelty) WHEN 'clean' THEN 'low' WHEN 'contaminated' THEN 'high' ELSE 'medium' END contamination_risk,
 CASE WHEN last_verified LIKE '2%' THEN last_verified ELSE coalesce(history, 'unknown') END first_available_date FROM cat""")
def catalog_labels(spark, sf):
    return live_catalog(spark, sf).select("source_id", "domain", "cadence", "host", "access_method", "contamination_risk", "first_available_date")


@query("coverage_matrix", "G16", f"""WITH {CAT_SQL} SELECT coalesce("domain", 'TOTAL') "domain", coalesce(cadence, 'TOTAL') cadence, count(*) n FROM cat GROUP BY CUBE("domain", cadence)""")
def coverage_matrix(spark, sf):
    return C.coverage_matrix(live_catalog(spark, sf))


@query("coverage_summary", "G18", f"""WITH {CAT_SQL}, x AS (SELECT *, CASE WHEN cadence_note = 'Near Real-Time' THEN 'live_stream' WHEN auth LIKE 'env:%' THEN 'licensed' WHEN contains(endpoint_type, 'zip') THEN 'bulk_download' ELSE 'open_api' END am,
 CASE lower(novelty) WHEN 'clean' THEN 'low' WHEN 'contaminated' THEN 'high' ELSE 'medium' END cr FROM cat)
SELECT 'domain' axis, "domain" "label", count(*) n FROM x GROUP BY 2 UNION ALL SELECT 'cadence', cadence, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'contamination_risk', cr, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'access_method', am, count(*) FROM x GROUP BY 2""")
def coverage_summary(spark, sf):
    return C.coverage_summary(live_catalog(spark, sf))


_DIV = """hc AS (SELECT "domain", host, count(*) n FROM cat GROUP BY 1,2), dv AS (SELECT "domain", CAST(sum(n) AS BIGINT) sources, count(*) hosts, round(max(n)::DOUBLE/sum(n), 3) top_host_share, CAST(sum(least(n, 5)) AS BIGINT) effective FROM hc GROUP BY 1)"""


@query("provider_diversity", "G17 G27", f"WITH {CAT_SQL}, {_DIV} SELECT * FROM dv")
def provider_diversity(spark, sf):
    return C.diversity(live_catalog(spark, sf))


@query("host_counts", "G27", f"WITH {CAT_SQL} SELECT host, count(*) n FROM cat GROUP BY 1")
def host_counts(spark, sf):
    return C.host_counts(live_catalog(spark, sf))


_CELLS = ("cells AS (SELECT d.d \"domain\", b.b cadence FROM (SELECT unnest([" + ",".join(f"'{d}'" for d in dims.DOMAINS) + "]) d) d, (SELECT unnest(["
          + ",".join(f"'{b}'" for b in dims.CADENCE_BANDS) + "]) b) b)")
_HIGH = "(" + ",".join(f"'{b}'" for b in dims.HIGH_VALUE_BANDS) + ")"


@query("gap_cells", "T1", f"""WITH {CAT_SQL}, {_CELLS}, h AS (SELECT "domain", cadence, count(*) n FROM cat GROUP BY 1,2),
g AS (SELECT cells."domain", cells.cadence, coalesce(n, 0)::BIGINT have, cells.cadence IN {_HIGH} high_value, CAST(CASE WHEN cells.cadence IN {_HIGH} THEN 3 ELSE 2 END AS BIGINT) target FROM cells LEFT JOIN h USING ("domain", cadence))
SELECT *, target - have deficit FROM g WHERE have < target""")
def gap_cells(spark, sf):
    return C.gap_cells(live_catalog(spark, sf))


@query("weakest_domains", "T3", f"""WITH {CAT_SQL}, {_DIV} SELECT d.d "domain", coalesce(effective, 0)::BIGINT effective FROM (SELECT unnest([{','.join(f"'{d}'" for d in dims.DOMAINS)}]) d) d LEFT JOIN dv ON dv."domain" = d.d ORDER BY effective, d.d LIMIT 3""")
def weakest_domains(spark, sf):
    return C.weakest_domains(live_catalog(spark, sf))


_CAND = {
    "seq": "c_custkey", "name": "CASE WHEN c_custkey % 29 = 0 THEN '' ELSE c_name END", "domain": _DOM,
    "frequency": "CASE c_custkey % 3 WHEN 0 THEN 'PT5M' WHEN 1 THEN 'PT1H' ELSE 'P1D' END",
    "access_method": "CASE WHEN c_custkey % 31 = 0 THEN 'carrier pigeon' ELSE 'open_api' END",
    "url_or_endpoint": "CASE c_custkey % 4 WHEN 0 THEN 'hub.example.org/x' WHEN 1 THEN concat('https://api-', lower(n_name), '.example.org/zz') WHEN 2 THEN concat('https://new', c_custkey, '.org/p') ELSE concat('https://data', c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '.etth1' ELSE '' END, '.org/') END",
    "license": "'open'", "estimated_series_count": "c_custkey + 1", "estimated_length": "100",
    "first_available_date": "CASE WHEN c_custkey % 2 = 0 THEN '2025-01-01' ELSE '2010-01-01' END",
    "supports_live_future_tasks": "(c_custkey % 3 = 0)", "contamination_risk": "CASE WHEN c_custkey % 2 = 0 THEN 'medium' ELSE 'low' END",
    "contamination_reasoning": "CASE WHEN c_custkey % 13 = 0 THEN 'resembles noaa weather' WHEN c_custkey % 13 = 1 THEN 'M5 like' ELSE 'fresh' END",
    "gap_filled": "'cell'", "difficulty_note": "'n'", "adapter_notes": "'n'",
    "confidence": "CASE WHEN c_custkey % 7 = 0 THEN 'high' ELSE 'medium' END", "verify": "CASE WHEN c_custkey % 14 = 0 THEN '  ' ELSE 'check' END",
}


def candidates(spark, sf):
    c, n, r = load(spark, sf, "customer"), load(spark, sf, "nation"), load(spark, sf, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.selectExpr(*[f"{v} AS {k}" for k, v in _CAND.items()])


def ledger(spark, sf):
    """Earlier proposals: every 17th candidate, one entry per key."""
    from tidemark.functions import text as X
    c = candidates(spark, sf).where("seq % 17 = 0").withColumn("key", F.expr(X.ledger_key("domain", "url_or_endpoint", "name")))
    return c.groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.first("domain").alias("domain"), F.min_by("frequency", "seq").alias("frequency"),
                                F.count(F.lit(1)).alias("times_proposed"), F.expr("CASE min(seq) % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'wired' ELSE 'rejected' END").alias("status"),
                                F.lit("2024-01-01").alias("first_proposed"))


CAND_SQL = ("cand0 AS (SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in _CAND.items())
            + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
            """cand AS (SELECT *, concat("domain", '|', regexp_extract(url_or_endpoint, '^(?:https?://)?([^/?#]*)', 1)) key, regexp_extract(url_or_endpoint, '^(?:https?://)?([^/?#:]*)', 1) vhost FROM cand0),
led AS (SELECT key, min_by("name", seq) "name", any_value("domain") "domain", min_by(frequency, seq) frequency, count(*) times_proposed, CASE min(seq) % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'wired' ELSE 'rejected' END status, '2024-01-01' first_proposed FROM cand WHERE seq % 17 = 0 GROUP BY 1)""")
_VET_SQL = f"""{CAT_SQL}, {CAND_SQL}, reg AS (SELECT "domain", regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www[.]', '') vhost, min_by(source_id, seq) dup FROM cat0 WHERE NOT disabled GROUP BY 1,2),
v0 AS (SELECT cand.*, led.status ls, led.times_proposed lt, reg.dup, {deny_sql("lower(concat_ws(' ', cand.name, cand.url_or_endpoint, cand.contamination_reasoning))")} deny,
 (cand.name = '')::INT + (access_method = 'carrier pigeon')::INT + (verify = '')::INT errs,
 (dup IS NOT NULL)::INT + (contamination_risk = 'low' AND NOT supports_live_future_tasks AND NOT first_available_date > '2024-03-01')::INT + (confidence = 'high' AND trim(verify) = '')::INT soft
 FROM cand LEFT JOIN led USING (key) LEFT JOIN reg ON reg."domain" = cand."domain" AND reg.vhost = cand.vhost),
vet AS (SELECT *, CASE WHEN ls IS NOT NULL THEN 1 WHEN errs > 0 THEN errs WHEN deny IS NOT NULL THEN 1 ELSE soft END n_reasons,
 CASE WHEN ls IS NOT NULL OR errs > 0 OR deny IS NOT NULL THEN 'reject' WHEN soft > 0 THEN 'flag' ELSE 'accept' END verdict,
 CASE WHEN ls IS NOT NULL THEN concat('already proposed on 2024-01-01 (status=', ls, ', seen ', lt, 'x)') WHEN errs > 0 THEN CASE WHEN "name" = '' THEN 'missing/empty field ''name''' ELSE 'invalid access_method ''carrier pigeon''' END
  WHEN deny IS NOT NULL THEN concat('matches contamination denylist token ''', deny, '''') WHEN dup IS NOT NULL THEN concat('same host+domain as existing source ''', dup, ''' (', vhost, ')') END r0 FROM v0)"""


@query("vet_candidates", "Q6 J9 J10 F18 F35 T12", f"""WITH {_VET_SQL} SELECT seq, verdict, n_reasons::BIGINT n_reasons, coalesce(r0, CASE WHEN n_reasons > 0 THEN 'other' END) first_reason FROM vet""")
def vet_candidates(spark, sf):
    v = C.vet(candidates(spark, sf), C.live(catalog(spark, sf)), ledger(spark, sf))
    first = F.expr("get(reasons, 0)")
    known = first.rlike("^(already|missing|invalid|matches|same)")
    return C.verdict_order(v).select("seq", "verdict", F.size("reasons").cast("bigint").alias("n_reasons"),
                                     F.when(known, first).when(first.isNotNull(), "other").alias("first_reason"))


@query("ledger_upsert", "Q7 Z8 F29", f"""WITH {_VET_SQL}, b AS (SELECT key, count(*) n, min_by("name", seq) nm, min_by("domain", seq) dm, min_by(frequency, seq) fr, max(CASE WHEN verdict = 'reject' THEN 1 ELSE 0 END) rej FROM vet GROUP BY 1)
SELECT key, coalesce(led."name", nm) "name", coalesce(led."domain", dm) "domain", coalesce(led.frequency, fr) frequency,
 CASE WHEN led.key IS NULL THEN CASE WHEN rej = 1 THEN 'rejected' ELSE 'proposed' END WHEN rej = 1 AND status NOT IN ('wired', 'key-gated', 'retired') THEN 'rejected' ELSE status END status,
 coalesce(first_proposed, '2024-02-01') first_proposed, CAST(coalesce(times_proposed, 0) + coalesce(n, 0) AS BIGINT) times_proposed FROM led FULL JOIN b USING (key)""")
def ledger_upsert(spark, sf):
    led = ledger(spark, sf)
    v = C.vet(candidates(spark, sf), C.live(catalog(spark, sf)), led)
    return C.ledger_upsert(led, v, "2024-02-01")


@query("ledger_settlement", "Q7", f"""WITH {CAND_SQL} SELECT key, CASE WHEN status = 'proposed' AND "name" <> '' AND (SELECT count(*) FROM customer c WHERE c.c_name = led."name") > 0
 THEN CASE WHEN CAST(right("name", 9) AS BIGINT) % 2 = 0 THEN 'wired' ELSE 'rejected' END ELSE status END status FROM led""")
def ledger_settlement(spark, sf):
    out = load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'wired' ELSE 'rejected' END").alias("outcome"))
    return C.settle_ledger(ledger(spark, sf), out).select("key", "status")


@query("ledger_lines", "F34", f"""WITH {CAND_SQL} SELECT key, concat(substr(key, strpos(key, '|') + 1), CASE WHEN "name" <> '' THEN concat(' — e.g. ', "name") ELSE '' END, ' [', status, ']') line FROM led""")
def ledger_lines(spark, sf):
    return C.ledger_lines(ledger(spark, sf))


@query("rank_candidates", "T2 J1", f"""WITH {CAT_SQL}, {CAND_SQL}, h AS (SELECT "domain", cadence, count(*) have FROM cat GROUP BY 1,2),
k AS (SELECT seq, cand."domain", CASE frequency WHEN 'PT5M' THEN 'few-min' WHEN 'PT1H' THEN 'hourly' ELSE 'daily' END cadence, vhost FROM cand),
s AS (SELECT k.*, row_number() OVER (PARTITION BY vhost ORDER BY CASE WHEN k."domain" IN ('nature', 'energy') THEN 0 ELSE 1 END, coalesce(have, 0), CASE WHEN k.cadence IN {_HIGH} THEN 0 ELSE 1 END, seq) host_rank FROM k LEFT JOIN h USING ("domain", cadence))
SELECT seq, "domain", cadence, vhost host, CAST(host_rank AS INT) host_rank FROM s WHERE host_rank <= 2""")
def rank_candidates(spark, sf):
    from tidemark.functions import text as X
    c = candidates(spark, sf).select("seq", "domain", F.expr(T.cadence_band("frequency")).alias("cadence"), F.expr(X.host("url_or_endpoint")).alias("host"))
    cells = live_catalog(spark, sf).groupBy("domain", "cadence").agg(F.count(F.lit(1)).alias("have"))
    return C.rank_candidates(c, cells, ["nature", "energy"], 2).select("seq", "domain", "cadence", "host", "host_rank")


@query("lane_identity", "J11", """WITH l AS (SELECT l_orderkey, l_linenumber, concat('https://api/', l_suppkey % 20) url, CASE WHEN l_linenumber % 2 = 0 THEN concat('v', l_linenumber) END vf, l_linestatus pf FROM lineitem)
SELECT url, vf value_field, pf panel_field, count(*) n, CAST(min(l_orderkey * 10 + l_linenumber) AS BIGINT) first_seq FROM l GROUP BY 1,2,3""")
def lane_identity(spark, sf):
    li = load(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS seq", "concat('https://api/', l_suppkey % 20) AS url", "CAST(NULL AS STRING) AS body",
                                               "if(l_linenumber % 2 = 0, concat('v', l_linenumber), NULL) AS value_field", "CAST(NULL AS STRING) AS timestamp_field", "l_linestatus AS panel_field")
    lanes = li.withColumn("lane", C.endpoint_identity()).groupBy("lane").agg(
        F.first("url").alias("url"), F.first("value_field").alias("value_field"), F.first("panel_field").alias("panel_field"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return lanes.drop("lane")


GATE_NOW = "2001-09-01 00:00:00"
_GATE_SQL = """en AS (SELECT c_custkey entry_id, c_custkey seq, CASE c_custkey % 3 WHEN 0 THEN 'PT1H' WHEN 1 THEN 'P1D' ELSE 'PT5M' END frequency, c_custkey % 4 = 0 admit_slow, CASE WHEN c_custkey % 5 = 0 THEN 700 WHEN c_custkey % 5 = 1 THEN 30 END slack FROM customer),
rc AS (SELECT o_custkey entry_id, count(*) n_rows, count(DISTINCT o_orderdate) n_st, count(CASE WHEN o_orderkey % 3 <> 0 THEN 1 END) n_num, count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) n_ent, max(o_orderdate) newest FROM orders GROUP BY 1),
gt AS (SELECT en.*, CASE WHEN frequency = 'P1D' AND NOT admit_slow THEN 'too slow' WHEN n_rows IS NULL OR NOT ((n_rows >= 20 AND n_st >= 20 AND n_num >= 0.5*n_rows) OR (n_ent >= 20 AND n_num >= 20)) THEN 'too thin'
 WHEN (epoch(TIMESTAMP '2001-09-01') - epoch(newest))/3600 > coalesce(slack*24, CASE frequency WHEN 'P1D' THEN 192 ELSE 72 END) THEN 'stale' ELSE 'pass' END gate FROM en LEFT JOIN rc USING (entry_id))"""


def gate_inputs(spark, sf):
    e = load(spark, sf, "customer").selectExpr(
        "c_custkey AS entry_id", "c_custkey AS seq", "CASE c_custkey % 3 WHEN 0 THEN 'PT1H' WHEN 1 THEN 'P1D' ELSE 'PT5M' END AS frequency", "c_custkey % 4 = 0 AS admit_slow",
        "CAST(CASE WHEN c_custkey % 5 = 0 THEN 700 WHEN c_custkey % 5 = 1 THEN 30 END AS DOUBLE) AS audit_slack_days",
        "c_custkey % 7 <> 0 AS wireable", "CASE WHEN c_custkey % 14 = 0 THEN 'needs an API key' ELSE 'dead link' END AS reason",
        "concat('S', if(c_custkey % 11 = 0, 'upplier#', 'x'), lpad(c_custkey, 9, '0')) AS wanted_id", "CASE WHEN c_custkey % 13 = 0 THEN 'nowhere' ELSE 'sales' END AS domain",
        "concat('https://lane/', c_custkey div 3) AS lane")
    o = load(spark, sf, "orders").selectExpr("o_custkey AS entry_id", "CAST(o_orderdate AS STRING) AS timestamp", "if(o_orderkey % 3 = 0, 'x', CAST(o_totalprice AS STRING)) AS value", "if(o_orderkey % 2 = 0, o_orderkey, NULL) AS entity")
    return e, o


@query("admission_gate", "Q5 G32", f"WITH {_GATE_SQL} SELECT entry_id, gate FROM gt")
def admission_gate(spark, sf):
    e, o = gate_inputs(spark, sf)
    return C.admission_gate(o, e, GATE_NOW).select("entry_id", "gate")


@query("wiring_decisions", "Q7 J11", f"""WITH {_GATE_SQL}, k AS (SELECT gt.*, c_custkey % 7 <> 0 wireable, concat('https://lane/', c_custkey // 3) lane, c_custkey % 11 = 0 AND c_custkey < (SELECT count(*) FROM supplier) dup_id, c_custkey % 13 = 0 bad FROM gt JOIN customer ON c_custkey = entry_id),
t AS (SELECT *, min(CASE WHEN gate = 'pass' AND wireable THEN seq END) OVER (PARTITION BY lane) twin FROM k)
SELECT entry_id, CASE WHEN NOT wireable THEN CASE WHEN entry_id % 14 = 0 THEN 'key-gated' ELSE 'rejected' END WHEN dup_id THEN 'duplicate' WHEN bad THEN 'bad-domain' WHEN twin < seq THEN 'duplicate' WHEN gate = 'pass' THEN 'wire' ELSE 'verify-fail' END verdict FROM t""")
def wiring_decisions(spark, sf):
    e, o = gate_inputs(spark, sf)
    gate = C.admission_gate(o, e, GATE_NOW)
    existing = catalog(spark, sf).select("source_id", F.col("url").alias("lane"))
    items = e.withColumn("row_id", F.col("entry_id")).withColumn("entry_id", F.col("wanted_id")).drop("frequency")
    gate = gate.select(F.col("wanted_id").alias("entry_id"), "gate")
    return C.wiring_decision(items, existing, gate).select(F.col("row_id").alias("entry_id"), "verdict")


@query("host_listing", "Q10", f"""WITH {CAT_SQL} SELECT host, count(*) n, count(DISTINCT concat("domain", '/', cadence)) n_cells FROM cat GROUP BY 1""")
def host_listing(spark, sf):
    c = live_catalog(spark, sf).select("host", F.concat_ws("/", "domain", "cadence").alias("cell"))
    # one row per (host, cell) first: the set of cells is bounded by the taxonomy
    per = c.groupBy("host", "cell").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("host").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_cells"))


@query("synthesize_entries", "Q9 F12 F31 G22", f"""WITH g AS (SELECT l_suppkey, l_shipdate, epoch(l_shipdate) - epoch(lag(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate)) gap FROM (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem)),
m AS (SELECT l_suppkey, median(gap) med, max(l_shipdate) newest FROM g GROUP BY 1), p AS (SELECT *, (epoch(TIMESTAMP '2001-12-01') - epoch(newest))/86400 age FROM m),
f AS (SELECT *, CASE WHEN med <= 129600 THEN 'P1D' WHEN med <= 864000 THEN 'P1W' WHEN med <= 3888000 THEN 'P1M' WHEN med <= 11664000 THEN 'P1Q' ELSE 'P1Y' END frequency FROM p)
SELECT concat('supplies_supplier_', lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) entry_id, frequency, CAST(greatest(45, CAST(floor(age) AS INT) + 45) AS INT) audit_slack_days, CASE WHEN age > 2 THEN 'P1D' WHEN age > 0.25 THEN 'PT1H' ELSE 'P1D' END poll, {R('age', 3)} age_days FROM f JOIN supplier ON l_suppkey = s_suppkey WHERE med IS NOT NULL""")
def synthesize_entries(spark, sf):
    """A catalog entry per supplier feed: id, measured frequency, slack and poll cadence."""
    from tidemark.functions import text as X
    from tidemark.operators import series as Q
    li = load(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("timestamp").alias("ts"))
    prof = Q.cadence_profile(li, ["l_suppkey"], "ts", "2001-12-01 00:00:00").where("verdict = 'ok' AND median_gap_s > 0")
    s = load(spark, sf, "supplier")
    j = prof.join(s, prof.l_suppkey == s.s_suppkey)
    return j.select(F.expr(X.entry_id("'data.supplies.gov'", "s_name")).alias("entry_id"), "frequency", F.expr(T.slack_flat("age_days")).alias("audit_slack_days"),
                    F.expr(T.poll_cadence("frequency", "age_days")).alias("poll"), rnd(F.col("age_days"), 3).alias("age_days"))
