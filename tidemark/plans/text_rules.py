"""Host, folding, classification, denylist and reject-rule queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import text as X
from tidemark.plans.views import load
from tidemark.registry import query

_FOLD = "strip_accents(lower({c}))"
_STOP = "[" + ", ".join(f"'{s}'" for s in X.STOPWORDS) + "]"
_HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"


@query("url_hosts", "F15 F29", f"""SELECT page_id, regexp_replace(lower({_HOST}), '^www[.]', '') host, regexp_extract({_HOST}, '([^.]+)[.](com|net|org)$', 1) publisher,
 concat('nature|', {_HOST}) ledger_key FROM pages""")
def url_hosts(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.expr("if(page_id % 2 = 0, url, regexp_replace(url, '^https?://', ''))").alias("url"))
    p = p.withColumn("host", F.expr(X.host("url")))
    return p.select("page_id", "host", F.expr(X.host_label("host")).alias("publisher"), F.expr(X.ledger_key("'nature'", "url", "'none'")).alias("ledger_key"))


@query("topic_tokens", "F16", f"""SELECT doc_id, CAST(len(list_filter(string_split_regex({_FOLD.format(c='"text"')}, '[^a-z0-9]+'), lambda t: len(t) > 2 AND NOT list_contains({_STOP}, t))) AS BIGINT) n_tokens FROM documents""")
def topic_tokens(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.expr(f"CAST(size({X.topic_tokens('text')}) AS BIGINT)").alias("n_tokens"))


@query("slugs_and_ids", "F16 F33", f"""WITH t AS (SELECT p_partkey, concat(p_name, ' – ', p_type, ' Été') title, concat('data.', replace(lower(p_brand), '#', '-'), '.gov.fr') dom,
 CASE WHEN p_partkey % 3 = 0 THEN concat('A', p_partkey, '_met buoy') ELSE p_name END st FROM part),
s AS (SELECT *, trim(regexp_replace({_FOLD.format(c='title')}, '[^a-z0-9]+', '_', 'g'), '_') sl FROM t)
SELECT p_partkey, trim(substr(sl, 1, 44), '_') slug, concat('brand_', trim(substr(sl, 1, 40), '_')) entry_id,
 CASE WHEN p_partkey % 3 = 0 THEN concat('a', p_partkey, 'met') ELSE trim(regexp_replace(lower(st), '[^a-z0-9]+', '_', 'g'), '_') END platform FROM s""")
def slugs_and_ids(spark, sf):
    p = load(spark, sf, "part").selectExpr("p_partkey", "concat(p_name, ' – ', p_type, ' Été') AS title", "concat('data.', replace(lower(p_brand), '#', '-'), '.gov.fr') AS dom",
                                           "if(p_partkey % 3 = 0, concat('A', p_partkey, '_met buoy'), p_name) AS st")
    return p.select("p_partkey", F.expr(X.slug("title")).alias("slug"), F.expr(X.entry_id("dom", "title")).alias("entry_id"), F.expr(X.platform_key("st", "'x'")).alias("platform"))


CLASSES = [("small blue widget goods", "sales", "small_goods"), ("hot ring gear", "energy", "heat_parts"),
           ("red bolt standard promo", "transport", "fasteners"), ("gizmo economy large", "econ_fin", "bulk_parts")]


def _score_sql(words: str) -> str:
    toks = [t for t in words.split() if len(t) > 2]
    return "+".join(f"CAST(contains(h, '{t}') OR contains(h, '{t.rstrip('s')}') AS INT)" for t in toks)


def _class_sql(col: int, least: int) -> str:
    arms = []
    for i, c in enumerate(CLASSES):
        best = f"s{i} >= {least} AND " + " AND ".join([f"s{i} > s{j}" for j in range(i)] + [f"s{i} >= s{j}" for j in range(i + 1, len(CLASSES))])
        arms.append(f"WHEN {best} THEN '{c[col]}'")
    return f"CASE {' '.join(arms)} END"


@query("topic_classes", "F17", f"""WITH h AS (SELECT p_partkey, lower(concat(p_name, ' ', p_type)) h FROM part), s AS (SELECT p_partkey, {', '.join(f'{_score_sql(c[0])} s{i}' for i, c in enumerate(CLASSES))}, contains(h, 'ring') OR contains(h, 'gear') rel FROM h)
SELECT p_partkey, {_class_sql(1, 1)} "domain", {_class_sql(2, 1)} dgp_class, {_class_sql(2, 2)} strict_class, rel relevant FROM s""")
def topic_classes(spark, sf):
    p = load(spark, sf, "part").selectExpr("p_partkey", "concat(p_name, ' ', p_type) AS title")
    p = p.withColumn("c", F.expr(X.classify(CLASSES, "title"))).withColumn("c2", F.expr(X.classify(CLASSES, "title", 2)))
    return p.select("p_partkey", F.col("c.dom").alias("domain"), F.col("c.klass").alias("dgp_class"), F.col("c2.klass").alias("strict_class"),
                    F.expr(f"{X.token_hits(X.topic_tokens(chr(39) + 'ring gear' + chr(39)), X.fold('title'))} > 0").alias("relevant"))


def deny_sql(t: str) -> str:
    allow = " OR ".join(f"contains({t}, '{a}')" for a in dims.DENYLIST_ALLOW)
    arms, hard = [], []
    for d in dims.DENYLIST:
        short = len(d) <= 3 or (d.isalnum() and len(d) <= 4)
        arms.append(f"WHEN regexp_matches({t}, '(^|[^a-z0-9]){d}([^a-z0-9]|$)') THEN '{d}'" if short else f"WHEN contains({t}, '{d}') THEN '{d}'")
        if d not in dims.DENYLIST_SOFT:
            hard.append(f"WHEN contains({t}, '{d}') THEN '{d}'")
    return f"CASE WHEN {allow} THEN (CASE {' '.join(hard)} END) ELSE (CASE {' '.join(arms)} END) END"


@query("denylist_hits", "F18", f"""WITH d AS (SELECT doc_id, lower(concat("text", CASE doc_id % 9 WHEN 0 THEN ' ETT-small' WHEN 1 THEN ' the M4 set' WHEN 2 THEN ' noaa weather' WHEN 3 THEN ' pm4x traffic' WHEN 4 THEN ' Weather' ELSE '' END)) t FROM documents) SELECT doc_id, {deny_sql('t')} token FROM d""")
def denylist_hits(spark, sf):
    d = load(spark, sf, "documents").selectExpr("doc_id", "concat(text, CASE doc_id % 9 WHEN 0 THEN ' ETT-small' WHEN 1 THEN ' the M4 set' WHEN 2 THEN ' noaa weather' WHEN 3 THEN ' pm4x traffic' WHEN 4 THEN ' Weather' ELSE '' END) AS t")
    return d.select("doc_id", F.expr(X.denylisted("t")).alias("token"))


@query("reject_rules", "F30 F35", """SELECT p_partkey, p_partkey % 6 = 0 draw_result, p_partkey % 6 = 1 model_output, p_partkey % 6 = 2 deployment, p_partkey % 6 = 3 qc_variable,
 NOT p_partkey % 6 = 4 production, p_partkey % 6 = 5 shared_host FROM part""")
def reject_rules(spark, sf):
    p = load(spark, sf, "part").selectExpr(
        "p_partkey", "concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' lottery draw results' WHEN 1 THEN ' modelled reanalysis' ELSE ' lottery fund grants' END) AS title",
        "CASE p_partkey % 6 WHEN 2 THEN concat('SEA', p_partkey, '-20260804T0908') ELSE concat('STN', p_partkey) END AS dsid",
        "CASE p_partkey % 6 WHEN 3 THEN 'wind_qc_agg' ELSE concat('wind', p_partkey) END AS var",
        "CASE p_partkey % 6 WHEN 4 THEN 'budget-QA-reporting.data.example.com' WHEN 5 THEN 'services1.arcgis.com' ELSE 'laqa.data.gov' END AS h")
    return p.select("p_partkey", F.expr(X.matches("title", X.DRAW_TITLE)).alias("draw_result"), F.expr(X.matches("title", X.MODEL_TITLE)).alias("model_output"),
                    F.expr(X.matches("dsid", X.DEPLOYMENT_ID)).alias("deployment"), F.expr(X.matches("var", X.QC_VARIABLE)).alias("qc_variable"),
                    F.expr(X.is_production("h")).alias("production"), F.expr(X.matches("h", X.SHARED_HOST)).alias("shared_host"))


@query("error_reasons", "F19", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat('HTTP ', 400 + user_id % 30) WHEN 1 THEN 'timeout' WHEN 2 THEN 'connect error' WHEN 3 THEN 'TLS error' WHEN 4 THEN 'DNS failure' WHEN 5 THEN 'KeyError' ELSE 'unknown' END reason FROM events""")
def error_reasons(spark, sf):
    e = load(spark, sf, "events").selectExpr("event_id", """CASE event_id % 7 WHEN 0 THEN concat('HTTPError: HTTP ', 400 + user_id % 30, ' at https://x/', event_id) WHEN 1 THEN concat('Read timed out ', event_id)
      WHEN 2 THEN 'ConnectionRefused' WHEN 3 THEN 'SSL handshake' WHEN 4 THEN 'Name or service not known' WHEN 5 THEN concat("KeyError: '", event_id, "'") ELSE '' END AS msg""")
    return e.select("event_id", F.expr(X.error_reason("msg")).alias("reason"))
