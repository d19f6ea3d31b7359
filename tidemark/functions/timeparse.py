"""Timestamps, period labels and durations as Spark SQL text (no Python in the row path)."""

from __future__ import annotations

from tidemark import dims

def _x(s: str, pattern: str, group: int) -> str:
    return f"regexp_extract({s}, r'{pattern}', {group})"


def _xi(s: str, pattern: str, group: int) -> str:
    return f"try_cast({_x(s, pattern, group)} AS INT)"


def iso_monday(year: str, week: str) -> str:
    """Monday of an ISO week; NULL when the year has no such week."""
    jan4 = f"make_date({year}, 1, 4)"
    monday = f"date_add({jan4}, -weekday({jan4}) + 7 * ({week} - 1))"
    return f"CASE WHEN {week} BETWEEN 1 AND 53 AND extract(YEAROFWEEK FROM {monday}) = {year} THEN {monday} END"


# --- fixed values: accepted explicit formats, tried in this order -----------------
EXPLICIT_FORMATS = (
    "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d",
    "M/d/yyyy H:m:s", "M/d/yyyy H:m",
    "M.yyyy", "d.M.yyyy", "ddMMMyyyy", "d-MMM-yyyy H:m:s", "yyyy MMM",
    "M/d/yyyy h:m:s a", "yyyyMMdd H:m:s", "yyyyMMdd H:m",
)
DIGIT_FORMATS = {14: "yyyyMMddHHmmss", 10: "yyyyMMddHH", 8: "yyyyMMdd", 6: "yyyyMM", 4: "yyyy"}

QUARTER = r"^(\d{4})[- ]?[QK]([1-4])$"
YEAR_MONTH = r"^(\d{4})M{1,2}(\d{1,2})$"
ISO_WEEK = r"^(\d{4})-?W(\d{1,2})$"
SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:[ T](\d{1,2}))?$"
DTG = r"^(\d{2})(\d{2})(\d{2})Z ([A-Za-z]{3}) (\d{4})$"
DMY_HM = r"^(\d{2})-(\d{2})-(\d{4}) (\d{1,2}):(\d{2})$"


def slash_date(s: str, now: str) -> str:
    """Both readings of a slash date: the later one not in the future wins."""
    a, b, y = (_xi(s, SLASH, g) for g in (1, 2, 3))
    hour = f"greatest(coalesce({_xi(s, SLASH, 4)}, 0) - 1, 0)"

    def reading(m: str, d: str) -> str:
        return f"try_to_timestamp(concat_ws('-', {y}, {m}, {d}), 'yyyy-M-d') + make_interval(0,0,0,0,{hour})"

    cands = f"array_compact(array({reading(a, b)}, {reading(b, a)}))"
    past = f"filter({cands}, t -> t <= {now} + INTERVAL 31 DAYS)"
    return f"coalesce(array_max({past}), array_min({cands}))"


def parse_ts(s: str, now: str = "current_timestamp()") -> str:
    """One stored stamp of any known shape to an instant, NULL when unreadable."""
    s = f"trim({s})"
    digit = " ".join(
        f"WHEN length({s}) = {n} THEN try_to_timestamp({s}, '{f}')" for n, f in DIGIT_FORMATS.items())
    secs = f"try_cast({s} AS BIGINT)"
    zless = f"regexp_replace({s}, 'Z$', '')"
    explicit = ", ".join(f"try_to_timestamp({zless}, '{f}')" for f in EXPLICIT_FORMATS)
    mon_yy = (f"try_to_timestamp({zless}, 'MMM-yy')")
    return f"""CASE
WHEN {s} IS NULL OR {s} = '' THEN NULL
WHEN {s} RLIKE r'^\\d{{10}}\\.\\d+$' THEN timestamp_micros(CAST(try_cast({s} AS DOUBLE) * 1000000 AS BIGINT))
WHEN {s} RLIKE r'^\\d{{13}}$' THEN timestamp_millis({secs})
WHEN {s} RLIKE r'^\\d+$' THEN CASE
  WHEN length({s}) = 10 AND {secs} >= 100000000 AND {secs} < 2000000000 THEN timestamp_seconds({secs}) {digit} END
WHEN {s} RLIKE r'{QUARTER}' THEN CAST(make_date({_xi(s, QUARTER, 1)}, 3 * {_xi(s, QUARTER, 2)} - 2, 1) AS TIMESTAMP)
WHEN {s} RLIKE r'{YEAR_MONTH}' THEN try_to_timestamp(concat({_x(s, YEAR_MONTH, 1)}, '-', {_x(s, YEAR_MONTH, 2)}), 'yyyy-M')
WHEN {s} RLIKE r'{ISO_WEEK}' THEN CAST({iso_monday(_xi(s, ISO_WEEK, 1), _xi(s, ISO_WEEK, 2))} AS TIMESTAMP)
WHEN {s} RLIKE r'{SLASH}' THEN {slash_date(s, now)}
WHEN {s} RLIKE r'{DTG}' THEN try_to_timestamp(replace({s}, 'Z', ''), 'ddHHmm MMM yyyy')
WHEN {s} RLIKE r'{DMY_HM}' THEN try_to_timestamp(substr({s}, 1, 10), 'dd-MM-yyyy')
  + make_interval(0,0,0,0,{_xi(s, DMY_HM, 4)},{_xi(s, DMY_HM, 5)})
WHEN {s} RLIKE r'^[A-Za-z]{{3}}, ' THEN coalesce(try_to_timestamp(substr({s}, 6), 'd MMM yyyy H:m:s zzz'),
  try_to_timestamp(substr({s}, 6), 'd MMM yyyy H:m:s XX'), try_to_timestamp(substr({s}, 6), 'd MMM yyyy H:m zzz'),
  try_to_timestamp(substr({s}, 6), 'd MMM yyyy H:m XX'))
WHEN {s} RLIKE r'^[A-Za-z]{{3}} [A-Za-z]{{3}} ' THEN try_to_timestamp(substr({s}, 5), 'MMM d H:m:s yyyy zzz')
WHEN {s} RLIKE r'^\\d{{4}}-\\d{{1,2}}' THEN try_cast({s} AS TIMESTAMP)
WHEN {s} RLIKE r'^[A-Za-z]{{3}}-\\d{{2}}$' THEN CASE WHEN year({mon_yy}) >= 2069 THEN {mon_yy} - INTERVAL 100 YEARS ELSE {mon_yy} END
ELSE coalesce({explicit}) END"""


def epoch_or_label(s: str) -> str:
    """Text normal form: epochs become ISO, date labels stay labels."""
    s = f"trim({s})"
    n = f"try_cast({s} AS DOUBLE)"
    week = r"^(\d{4})[-_]?[Ww](\d{1,2})$"
    dec = r"^(\d{4})\.(\d{1,6})$"
    fmt = lambda t: f"concat(date_format({t}, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00')"
    return f"""CASE
WHEN {s} RLIKE r'^\\d+$' THEN CASE
  WHEN {n} >= 1e8 AND {n} < 2e9 THEN {fmt(f"timestamp_seconds(CAST({n} AS BIGINT))")}
  WHEN {n} >= 1e12 AND {n} < 2e12 THEN {fmt(f"timestamp_millis(CAST({n} AS BIGINT))")}
  ELSE {s} END
WHEN {s} RLIKE r'{week}' THEN coalesce(CAST({iso_monday(_xi(s, week, 1), _xi(s, week, 2))} AS STRING), {s})
WHEN {s} RLIKE r'{dec}' AND {_xi(s, dec, 1)} BETWEEN 1900 AND 2099 THEN concat({_x(s, dec, 1)}, '-',
  lpad(CAST(least(CAST(floor(CAST(concat('0.', {_x(s, dec, 2)}) AS DOUBLE) * 12) AS INT) + 1, 12) AS STRING), 2, '0'), '-01')
WHEN {s} LIKE '%Z' AND (substr({s}, 11) LIKE '%+%' OR substr({s}, 11) LIKE '%-%') THEN substr({s}, 1, length({s}) - 1)
ELSE {s} END"""


# --- fixed values: English month names -----------------------------------------------
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august",
          "september", "october", "november", "december")


def month_number(name: str) -> str:
    arms = " ".join(f"WHEN '{m[:3]}' THEN {i}" for i, m in enumerate(MONTHS, 1))
    return f"CASE substr(lower({name}), 1, 3) {arms} END"


def compose_ts(parts: str, hour_of_day: bool = False, year_week: bool = False) -> str:
    """One stamp from an array of text parts (date+hour, Y M D [h m], Y+month, Y+ISO week)."""
    p = [f"trim(try_element_at({parts}, {i}))" for i in range(1, 6)]
    two = f"size({parts}) = 2"
    num = lambda k: f"coalesce({p[k]} RLIKE r'^\\d+$', false)"
    year = f"{two} AND {p[0]} RLIKE r'^\\d{{4}}$'"
    h = f"CAST({p[1]} AS INT)"
    hod = f"{h} % 24" if hour_of_day else f"CASE WHEN {h} BETWEEN 1 AND 24 THEN ({h} - 1) % 24 ELSE {h} % 24 END"
    week = (f"WHEN {year} AND {num(1)} THEN coalesce(CAST({iso_monday(f'CAST({p[0]} AS INT)', h)} AS STRING), "
            f"concat_ws(' ', {parts}))" if year_week else "")
    month = f"WHEN {year} AND {num(1)} AND {h} BETWEEN 1 AND 12 THEN concat({p[0]}, '-', lpad({h}, 2, '0'))"
    named = month_number(p[1])
    pad = lambda k, n: f"lpad({p[k]}, greatest({n}, length({p[k]})), '0')"
    return f"""CASE {week}
WHEN {two} AND {p[0]} RLIKE r'^\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}$' AND {num(1)}
  THEN concat(replace({p[0]}, '/', '-'), 'T', lpad({hod}, 2, '0'), ':00:00')
WHEN size({parts}) >= 3 AND {num(0)} AND {num(1)} AND {num(2)} THEN concat({pad(0, 4)}, '-', {pad(1, 2)}, '-', {pad(2, 2)},
  CASE WHEN size({parts}) >= 5 AND {num(3)} AND {num(4)} THEN concat('T', {pad(3, 2)}, ':', {pad(4, 2)}, ':00') ELSE '' END)
{month}
WHEN {year} AND {named} IS NOT NULL THEN concat({p[0]}, '-', lpad({named}, 2, '0'))
ELSE concat_ws(' ', {parts}) END"""


def statbank_label(s: str) -> str:
    """1980M01 -> 1980-01, 2020K2/2020Q2 -> 2020-Q2, 2020W03 -> 2020-W03; the rest unchanged."""
    out = f"regexp_replace({s}, r'^(\\d{{4}})M(\\d{{2}})$', '$1-$2')"
    out = f"regexp_replace({out}, r'^(\\d{{4}})[KQ](\\d)$', '$1-Q$2')"
    return f"regexp_replace({out}, r'^(\\d{{4}})W(\\d{{2}})$', '$1-W$2')"


def compose_statbank(parts: str) -> str:
    """Join a split period; a range ('1. - 12.') or a part without digits stops the join."""
    stop = (f"array_position(transform({parts}, (p, i) -> i > 0 AND (p RLIKE r'\\d\\s*\\.?\\s*[-–]\\s*\\d' "
            f"OR regexp_replace(p, r'\\D', '') = '')), true)")
    kept = f"slice({parts}, 1, CAST(if({stop} > 0, {stop} - 1, size({parts})) AS INT))"
    head = statbank_label("p")
    return (f"array_join(transform({kept}, (p, i) -> if(i = 0, {head}, "
            f"lpad(CAST(CAST(regexp_replace(p, r'\\D', '') AS INT) AS STRING), 2, '0'))), '-')")


PERIOD = r"^(\d{4})(?:-?(?:(Q[1-4])|(S[12])|(W\d{2})|(\d{2})(?:-(\d{2}))?))?$"


def period_end(s: str) -> str:
    """Last day of a period label (year, quarter, semester, ISO week, month, date)."""
    g = [_x(s, PERIOD, i) for i in range(1, 7)]
    y = f"CAST({g[0]} AS INT)"
    n = lambda k: f"try_cast(substr({g[k]}, 2) AS INT)"
    month_end = lambda m: f"last_day(try_to_date(concat({g[0]}, '-', {m}), 'yyyy-M'))"
    return f"""CASE WHEN NOT ({s} RLIKE r'{PERIOD}') THEN NULL
WHEN {g[1]} <> '' THEN {month_end(f'3 * {n(1)}')}
WHEN {g[2]} <> '' THEN {month_end(f'6 * {n(2)}')}
WHEN {g[3]} <> '' THEN date_add({iso_monday(y, n(3))}, 6)
WHEN {g[5]} <> '' THEN try_to_date(concat({g[0]}, '-', {g[4]}, '-', {g[5]}), 'yyyy-MM-dd')
WHEN {g[4]} <> '' THEN {month_end(f'try_cast({g[4]} AS INT)')}
ELSE make_date({y}, 12, 31) END"""


def loose_date(s: str) -> str:
    """ISO first, then day-first national orders, then compact digits."""
    s = f"trim({s})"
    dmy = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
    ymd = r"^(\d{4})(\d{2})(\d{2})$"
    return f"""CASE WHEN {s} RLIKE r'^\\d{{4}}-\\d{{2}}-\\d{{2}}' THEN try_cast(substr({s}, 1, 10) AS DATE)
WHEN {s} RLIKE r'{dmy}' THEN try_to_date(concat_ws('-', {_x(s, dmy, 3)}, {_x(s, dmy, 2)}, {_x(s, dmy, 1)}), 'yyyy-M-d')
WHEN {s} RLIKE r'{ymd}' THEN try_to_date({s}, 'yyyyMMdd') END"""


DURATION = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"


def duration_seconds(s: str) -> str:
    """ISO-8601 duration to seconds with fixed calendar units; NULL when unparseable."""
    terms = " + ".join(
        f"coalesce(try_cast({_x(s, DURATION, i)} AS BIGINT), 0) * {u}"
        for i, u in enumerate(dims.DURATION_UNITS.values(), 1))
    return f"CASE WHEN trim({s}) RLIKE r'{DURATION}' AND {s} RLIKE r'\\d' THEN {terms} END"


def cadence_band(s: str, unknown: str = "irregular", sec: str | None = None) -> str:
    """Band of any frequency: the named table first, then the duration ladder.

    ``sec`` names a column already holding ``duration_seconds(s)``.
    """
    sec = sec or duration_seconds(s)
    ladder = " ".join(f"WHEN {sec} <= {top} THEN '{b}'" for top, b in dims.BAND_LADDER)
    named = dims.sql_case(s, dims.FREQ_BAND)
    return f"coalesce({named}, CASE WHEN {sec} IS NULL THEN '{unknown}' {ladder} ELSE 'yearly' END)"


def stale_after_hours(freq: str, sec: str | None = None) -> str:
    """How old the newest observation may be, in hours, before a source counts as stale."""
    sec = sec or duration_seconds(freq)
    sec = f"(CASE WHEN {freq} = 'P1Q' THEN {3 * dims.DURATION_UNITS['M']} ELSE {sec} END)"
    return (f"CASE WHEN {sec} IS NULL THEN 45 * 24.0D WHEN {sec} >= 7000000 THEN 550 * 24.0D "
            f"WHEN {sec} >= 2000000 THEN 100 * 24.0D WHEN {sec} >= 500000 THEN 35 * 24.0D "
            f"ELSE greatest({sec} * 8 / 3600.0D, 72.0D) END")


# --- fixed values: median gap ceiling (seconds) -> frequency label ---------------------
GAP_LADDER = (
    (90, "PT1M"), (450, "PT5M"), (1200, "PT15M"), (2700, "PT30M"), (7200, "PT1H"),
    (129600, "P1D"), (864000, "P1W"), (3888000, "P1M"), (11664000, "P1Q"),
)


def freq_from_gap(sec: str) -> str:
    arms = " ".join(f"WHEN {sec} <= {top} THEN '{f}'" for top, f in GAP_LADDER)
    return f"CASE {arms} ELSE 'P1Y' END"


def poll_cadence(freq: str, age_days: str) -> str:
    """How often to ask: publication lag first, then the series' own frequency."""
    return (f"CASE WHEN {age_days} > 2 THEN 'P1D' WHEN {age_days} > 0.25 THEN 'PT1H' "
            f"WHEN {freq} IN ('PT1M', 'PT5M', 'PT15M', 'PT30M', 'PT1H') THEN {freq} ELSE 'P1D' END")


def label_freq(p: str) -> str:
    """Frequency implied by a statbank period label."""
    return (f"CASE WHEN {p} RLIKE r'^\\d{{4}}$' THEN 'P1Y' WHEN {p} RLIKE r'M\\d{{2}}$' OR {p} RLIKE r'^\\d{{4}}-\\d{{2}}$' THEN 'P1M' "
            f"WHEN {p} RLIKE r'[QK]\\d$' THEN 'P3M' WHEN {p} RLIKE r'[HS]\\d$' THEN 'P6M' "
            f"WHEN {p} RLIKE r'W\\d{{2}}$' THEN 'P1W' ELSE 'P1M' END")


def label_age_days(p: str, today: str) -> str:
    """Days since the start of a statbank period; NULL for unknown shapes."""
    m, q, h = r"^(\d{4})(?:M|-)(\d{2})$", r"^(\d{4})[QK](\d)$", r"^(\d{4})[HS](\d)$"
    start = (f"CASE WHEN {p} RLIKE r'{m}' THEN make_date({_xi(p, m, 1)}, {_xi(p, m, 2)}, 1) "
             f"WHEN {p} RLIKE r'{q}' THEN make_date({_xi(p, q, 1)}, 1 + 3 * ({_xi(p, q, 2)} - 1), 1) "
             f"WHEN {p} RLIKE r'{h}' THEN make_date({_xi(p, h, 1)}, 1 + 6 * ({_xi(p, h, 2)} - 1), 1) "
             f"WHEN {p} RLIKE r'^\\d{{4}}$' THEN make_date(try_cast({p} AS INT), 1, 1) END")
    return f"datediff({today}, {start})"


# --- fixed values: staleness slack rules (days) ------------------------------------------
STATBANK_SLACK = {"P1Y": 500, "P6M": 300, "P3M": 180, "P1M": 75, "P1W": 30}
AGENCY_BASE = {"P1D": 10, "P1W": 30, "P1M": 75, "P3M": 200, "P6M": 320, "P1Y": 500}
AGENCY_PERIOD = {"P1D": 1, "P1W": 7, "P1M": 31, "P3M": 92, "P6M": 184, "P1Y": 366}


def slack_by_gap(gap: str, age: str) -> str:
    """Proportional to cadence: hours matter for a sub-daily feed."""
    a = f"CAST({age} AS INT)"
    return (f"CASE WHEN {gap} <= 7200 THEN greatest(3, {a} + 3) WHEN {gap} <= 129600 THEN greatest(14, {a} + 10) "
            f"ELSE greatest(45, {a} + 45) END")


def slack_flat(age: str) -> str:
    return f"greatest(45, CAST({age} AS INT) + 45)"


def slack_statbank(freq: str) -> str:
    return dims.sql_case(freq, STATBANK_SLACK, "90")


def slack_agency(freq: str, age: str) -> str:
    """Nominal period plus the agency's own publication lag, aged from the label."""
    label_age = f"CAST({age} AS INT) + {dims.sql_case(freq, AGENCY_PERIOD, '92')}"
    return f"greatest({dims.sql_case(freq, AGENCY_BASE, '120')}, {label_age} + 45)"
