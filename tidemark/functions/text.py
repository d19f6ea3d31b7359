"""Hosts, folding, tokens and rule predicates as Spark SQL text."""

from __future__ import annotations

import re
import unicodedata

from tidemark import dims


def quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def host(url: str) -> str:
    """Host of a URL, scheme optional, lower case, without 'www.', user or port; '' when absent."""
    h = f"regexp_extract({url}, r'^(?:[A-Za-z][A-Za-z0-9+.-]*://|//)?(?:[^/@?#]*@)?([^/:?#]*)', 1)"
    return f"coalesce(regexp_replace(lower({h}), '^www[.]', ''), '')"


def netloc(url: str) -> str:
    """Authority part of a URL as written (user and port kept)."""
    return f"coalesce(regexp_extract({url}, r'^(?:[A-Za-z][A-Za-z0-9+.-]*://|//)?([^/?#]*)', 1), '')"


# --- fixed values: host labels that name a platform, not a publisher -----------------
GENERIC_LABELS = (
    "data", "opendata", "open", "datos", "dados", "donnees", "api", "www", "portal", "catalog",
    "gov", "us", "org", "com", "net", "co", "ca", "city", "state", "county", "info", "public",
    "internal", "performance", "insights",
    "eu", "uk", "ie", "fr", "de", "es", "it", "nl", "be", "pt", "at", "ch", "no", "se", "fi", "dk",
    "is", "pl", "cz", "gr", "ro", "hu", "si", "sk", "au", "nz", "jp", "kr", "in", "sg", "za", "br",
    "mx", "cl", "ar", "il",
)
# --- fixed values: words without topic -------------------------------------------------
STOPWORDS = (
    "and", "the", "of", "by", "for", "in", "on", "to", "per", "data", "dataset", "open", "public",
    "city", "county", "state", "total", "number", "counts", "report", "reports", "current",
    "history", "historical", "monthly", "daily", "weekly", "annual", "yearly", "time", "times",
    "service", "services",
)


def _foldings() -> tuple[str, str]:
    """Lower-case letters that decompose to one ASCII letter or digit, and those; then combining marks, which fold to nothing."""
    letters, plain, marks = [], [], []
    for c in map(chr, range(0x80, 0x2000)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if unicodedata.combining(c):
            marks.append(c)
        elif c == c.lower() and len(base) == 1 and base.isascii() and base.isalnum():
            letters.append(c)
            plain.append(base)
    return "".join(letters + marks), "".join(plain)


ACCENTED, FOLDED = _foldings()


def sql_array(items) -> str:
    return "array(" + ", ".join(quote(i) for i in items) + ")"


def fold(s: str) -> str:
    return f"translate(lower({s}), '{ACCENTED}', '{FOLDED}')"


def slug(s: str, maxlen: int = 44) -> str:
    body = f"trim(BOTH '_' FROM regexp_replace({fold(s)}, '[^a-z0-9]+', '_'))"
    return f"trim(BOTH '_' FROM substr({body}, 1, {maxlen}))"


def topic_tokens(s: str) -> str:
    return (f"filter(split({fold(s)}, '[^a-z0-9]+'), t -> length(t) > 2 "
            f"AND NOT array_contains({sql_array(STOPWORDS)}, t))")


def host_label(domain: str) -> str:
    """Publisher part of a host: first non-generic label from the right."""
    labels = f"reverse(filter(split(lower({domain}), '[.]'), p -> p <> ''))"
    first = (f"transform({labels}, l -> get(filter(split(l, '[-_]'), s -> s <> '' AND NOT "
             f"array_contains({sql_array(GENERIC_LABELS)}, s)), 0))")
    hit = f"get(filter({first}, x -> x IS NOT NULL), 0)"
    return f"coalesce({slug(hit, 20)}, {slug(domain, 20)})"


def entry_id(domain: str, title: str) -> str:
    return f"trim(BOTH '_' FROM substr(concat({host_label(domain)}, '_', {slug(title, 40)}), 1, 64))"


def token_hits(tokens: str, hay: str) -> str:
    """How many tokens (or their singular) occur in the folded text."""
    return f"size(filter({tokens}, t -> contains({hay}, t) OR contains({hay}, rtrim('s', t))))"


def classify(classes: list[tuple[str, str, str]], text: str, min_score: int = 1) -> str:
    """First class with the highest token-hit score, NULL below ``min_score``."""
    stop = set(STOPWORDS)
    rows = []
    for words, dom, klass in classes:
        toks = [t for t in re.split(r"[^a-z0-9]+", words.lower()) if len(t) > 2 and t not in stop]
        rows.append(f"named_struct('tok', {sql_array(toks)}, 'dom', {quote(dom)}, 'klass', {quote(klass)})")
    table = f"array({', '.join(rows)})"
    hay = f"array_join({topic_tokens(text)}, ' ')"
    scored = f"transform({table}, c -> named_struct('s', {token_hits('c.tok', 'h_')}, 'dom', c.dom, 'klass', c.klass))"
    start = f"named_struct('s', {min_score - 1}, 'dom', CAST(NULL AS STRING), 'klass', CAST(NULL AS STRING))"
    best = f"aggregate({scored}, {start}, (b, c) -> if(c.s > b.s, c, b))"
    return f"transform(array({hay}), h_ -> {best})[0]"


def denylisted(text: str) -> str:
    """First offending token in list order, or NULL; short tokens need word boundaries."""
    t = f"lower({text})"
    allow = " OR ".join(f"contains({t}, {quote(a)})" for a in dims.DENYLIST_ALLOW)
    arms, hard = [], []
    for d in dims.DENYLIST:
        if len(d) <= 3 or (d.isalnum() and len(d) <= 4):
            arms.append(f"WHEN {t} RLIKE '(?<![a-z0-9]){re.escape(d)}(?![a-z0-9])' THEN {quote(d)}")
        else:
            arms.append(f"WHEN contains({t}, {quote(d)}) THEN {quote(d)}")
        if d not in dims.DENYLIST_SOFT:
            hard.append(f"WHEN contains({t}, {quote(d)}) THEN {quote(d)}")
    return f"CASE WHEN {allow} THEN (CASE {' '.join(hard)} END) ELSE (CASE {' '.join(arms)} END) END"


# --- fixed values: reject rules -----------------------------------------------------------
DRAW_TITLE = (
    r"(?i)\b(loto|lotto|keno|euromillions?|powerball|jackpots?|raffles?|sorteos?)\b"
    r"|\b(lottery|tirage|draw)\b[^,;]{0,24}\b(result|resultat|résultat|number|numero|winning|draw|gagnant)"
    r"|\b(winning|gagnant)\b[^,;]{0,16}\b(number|numero|combinaison)"
    r"|\b(dummy|sample[_ ]data|test[_ ]dataset|random[_ ]walk|dedicated[_ -]integers|all[_ ]geometries)\b"
)
MODEL_TITLE = (
    r"(?i)\b(forecast|hindcast|nowcast|prediction|predicted|model|modell?ed|simulation|reanalys[ie]s|"
    r"climatolog[a-z]*|projection|scenario|particle track|trajectory analysis)\b|^data from a (local|remote) source"
)
DEPLOYMENT_ID = r"\d{8}T\d{3,6}|[-_]\d{8}$"
QC_VARIABLE = (
    r"(?i)(?:^|_)(?:qc|qa|qartod|flag|flags|test|tests|agg|mask|status|instrument\d*|deployment|profile|"
    r"trajectory|rowsize|row_size)(?:$|_)"
    r"|^(?:latitude|longitude|lat|lon|depth|altitude|z|station|station_id|platform|crs|id|time_modified|"
    r"actual_time|time_created|precise_time|sample_time|obs_time|feature_type_instance)$"
)
SHARED_HOST = r"(?i)\.arcgis\.com$"
NON_PRODUCTION = ("demo", "qa", "beta", "test", "staging", "sandbox", "training", "internal")


def matches(s: str, pattern: str) -> str:
    return f"{s} RLIKE r'{pattern}'"


def is_production(h: str) -> str:
    """Token-wise: a marker inside a longer word does not count."""
    return f"NOT arrays_overlap(split(lower({h}), '[.\\\\-_]+'), {sql_array(NON_PRODUCTION)})"


def platform_key(title: str, fallback: str) -> str:
    """Leading title token when it carries a digit (a station code), else the slug."""
    first = f"split(trim({title}), ' ')[0]"
    return (f"if({first} RLIKE '[0-9]', regexp_replace(lower({first}), '[^a-z0-9]', ''), "
            f"{slug(f'coalesce(nullif({title}, {chr(39)*2}), {fallback})', 60)})")


def error_reason(msg: str) -> str:
    """Collapse an exception text to a groupable label."""
    low = f"lower({msg})"
    needles = (("timed out", "timeout"), ("timeout", "timeout"), ("connect", "connect error"),
               ("ssl", "TLS error"), ("dns", "DNS failure"), ("name or service not known", "DNS failure"))
    arms = " ".join(f"WHEN contains({low}, '{n}') THEN '{lab}'" for n, lab in needles)
    head = f"substr(trim(split({msg}, ':')[0]), 1, 48)"
    return (f"CASE WHEN {msg} RLIKE r'\\bHTTP (\\d{{3}})\\b' THEN concat('HTTP ', regexp_extract({msg}, r'\\bHTTP (\\d{{3}})\\b', 1)) "
            f"{arms} ELSE coalesce(nullif({head}, ''), 'unknown') END")


def ledger_key(domain: str, url: str, name: str) -> str:
    return f"concat({domain}, '|', coalesce(nullif({netloc(url)}, ''), {name}))"


def access_method(cadence_note: str, auth: str, kind: str) -> str:
    note, a, k = f"lower({cadence_note})", f"lower({auth})", f"lower({kind})"
    live = " OR ".join(f"contains({note}, '{w}')" for w in (
        "realtime", "real-time", "stream", "every ~", "every 1", "second"))
    return (f"CASE WHEN {live} THEN 'live_stream' WHEN {a} LIKE 'env:%' OR {a} IN ('key', 'token', 'oauth') THEN 'licensed' "
            f"WHEN contains({k}, 'bulk') OR contains({k}, 'zip') OR contains({k}, 'xlsx') THEN 'bulk_download' ELSE 'open_api' END")


def first_available(verified: str, history: str) -> str:
    return f"CASE WHEN {verified} RLIKE '^[0-9]{{4}}' THEN {verified} ELSE coalesce(nullif({history}, ''), 'unknown') END"
