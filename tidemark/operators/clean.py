"""Record cleaning, column profiling and window repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import arrays as A, timeparse as T
from tidemark.operators.bounded import running_total
from tidemark.sources.lake import panel_columns, value_columns

DECIMAL_COMMA = r"^-?\d{1,3}(\.\d{3})*,\d+$"


def rename_fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def stamp_snapshot(df: DataFrame, lists: list[str], now: str) -> DataFrame:
    """One poll, many entities: parallel lists to rows, short lists pad with NULL."""
    n = f"greatest({', '.join(f'size({c})' for c in lists)})" if len(lists) > 1 else f"size({lists[0]})"
    df = df.withColumn("_i", F.expr(f"explode(sequence(0, {n} - 1))"))
    return df.select(*[F.expr(f"get({c}, _i)").alias(c) if c in lists else F.col(c)
                       for c in df.columns if c not in ("_i", "timestamp")], F.lit(now).alias("timestamp"))


def decimal_comma(df: DataFrame, cols: list[str]) -> DataFrame:
    def fix(c: str) -> Column:
        return F.when(F.col(c).rlike(DECIMAL_COMMA), F.translate(F.translate(c, ".", ""), ",", ".")).otherwise(F.col(c))

    return df.select(*[fix(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_null_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep rows with at least one non-empty value field."""
    return df.where(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols]).isNotNull())


def regex_extract(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """First capture group where the pattern matches; other values stay."""
    return df.withColumn(col, F.when(F.col(col).rlike(pattern), F.regexp_extract(col, pattern, 1)).otherwise(F.col(col)))


def where_equals(df: DataFrame, want: dict[str, str]) -> DataFrame:
    """Equality on a field or its panel twin, compared as text."""
    for f, v in want.items():
        names = [F.col(c).cast("string") for c in (f, f"_panel_{f}") if c in df.columns]
        df = df.where(F.coalesce(*names) == F.lit(str(v)))
    return df


def drop_future(df: DataFrame, now: str, horizon_days: float = 1.0) -> DataFrame:
    """Drop rows dated past the horizon; an unreadable stamp is kept."""
    t = F.expr("try_cast(timestamp AS TIMESTAMP)")
    limit = F.expr(f"TIMESTAMP'{now}' + make_dt_interval({int(horizon_days)}, 0, 0, {(horizon_days % 1) * 86400})")
    return df.where(t.isNull() | (t <= limit))


def keep_stamps_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(F.col("timestamp").rlike("^(?:" + pattern.lstrip("^") + ")" if not pattern.startswith("^") else pattern))


def bin_records(df: DataFrame, ts: str, seconds: int, op: str, value: str | None, keys: list[str]) -> DataFrame:
    """Count, sum or mean per clock bin and panel; a bin without one numeric value is omitted."""
    t = F.expr(T.parse_ts(ts)) if dict(df.dtypes)[ts] == "string" else F.col(ts).cast("timestamp")
    df = df.withColumn("_t", t).where("_t IS NOT NULL")
    start = F.timestamp_seconds(F.floor(F.unix_seconds("_t") / seconds) * seconds)
    if op == "count" or value is None:
        return df.groupBy(*keys, start.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    v = F.expr(f"try_cast({value} AS DOUBLE)")
    agg = F.sum(v) if op == "sum" else F.avg(v)
    return df.groupBy(*keys, start.alias("bin")).agg(agg.alias("value"), F.count(v).alias("_n")).where("_n > 0").drop("_n")


def densest_column(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per series, the field with most finite numbers (first on a tie); NULL when none has any."""
    ok = lambda c: F.count_if(F.expr(f"try_cast({c} AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast({c} AS DOUBLE)) "  # noqa: E731
                                     f"AND abs(try_cast({c} AS DOUBLE)) < double('infinity')"))
    counts = df.groupBy(*keys).agg(*[ok(c).alias(f"_n_{c}") for c in fields])
    best = F.array_max(F.array(*[F.struct(F.col(f"_n_{c}").alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("field"))
                                 for i, c in enumerate(fields)]))
    return counts.select(*keys, F.when(best["n"] > 0, best["field"]).alias("field"), best["n"].alias("n_finite"))


def category_codes(df: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Rank code (0-based, sorted) of each category within its series."""
    cats = df.where(F.col(field).isNotNull()).groupBy(*keys, field).agg(F.lit(1).cast("bigint").alias("_one"))
    codes = running_total(cats, keys, field, "_one", "_upto")
    return df.join(codes.select(*keys, field, (F.col("_upto") - 1).cast("double").alias("code")), [*keys, field])


def median_fill(x: str) -> str:
    """Array text: non-finite points take the median of the finite ones, 0 when there are none."""
    fin = f"array_sort(filter({x}, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')))"
    med = A.let("f_", fin, "if(size(f_) = 0, 0D, (f_[CAST((size(f_) - 1) div 2 AS INT)] + f_[CAST(size(f_) div 2 AS INT)]) / 2)")
    return A.let("d_", med, f"transform({x}, v -> if(v IS NULL OR isnan(v) OR abs(v) >= double('infinity'), d_, v))")


def interpolate_gaps(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Linear repair of non-finite points, edges held; groups with under two finite points give none.

    For served windows and contexts, whose length the profile bounds.
    """
    v = F.col(value)
    fin = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    p = F.when(fin.isNotNull(), F.col(pos))
    w = Window.partitionBy(*keys).orderBy(pos)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.select("*", F.last(fin, True).over(back).alias("_v0"), F.last(p, True).over(back).alias("_p0"),
                   F.first(fin, True).over(ahead).alias("_v1"), F.first(p, True).over(ahead).alias("_p1"),
                   F.count(fin).over(Window.partitionBy(*keys)).alias("_n"))
    blend = F.expr(f"CASE WHEN _p0 IS NULL THEN _v1 WHEN _p1 IS NULL OR _p1 = _p0 THEN _v0 "
                   f"ELSE _v0 + (_v1 - _v0) * ({pos} - _p0) / (_p1 - _p0) END")
    return df.where("_n >= 2").withColumn(value, blend).drop("_v0", "_p0", "_v1", "_p1", "_n")


def degenerate_reason(x: str) -> str:
    """Why a window is no forecasting target, else NULL."""
    fin = f"filter({x}, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))"
    return A.let("f_", fin, "CASE WHEN size(f_) = 0 THEN 'all non-finite' WHEN "
                 f"{A.std_pop('f_')} <= 1e-6 * (abs({A.mean('f_')}) + 1e-12) THEN 'constant' END")


def zscore_or_ramp(x: str) -> str:
    """Whole-window z-score; a constant window becomes the standardised ramp -1..1."""
    fin = f"transform({x}, v -> if(v IS NULL OR isnan(v) OR abs(v) >= double('infinity'), 0D, v))"
    ramp = f"transform(sequence(1, size({x})), i -> -1D + 2D * (i - 1) / greatest(size({x}) - 1, 1))"
    z = lambda a: A.let("z_", f"named_struct('m', {A.mean(a)}, 's', {A.std_pop(a)})", f"transform({a}, v -> (v - z_.m) / if(z_.s = 0, 1D, z_.s))")
    return A.let("x_", fin, f"if({A.std_pop('x_')} < 1e-8, {A.let('r_', ramp, z('r_'))}, {z('x_')})")


# --- column profiling --------------------------------------------------------------------


LONG_VALUE = 40  # characters; a column with more than one long value in a hundred is text


def profile_columns(df: DataFrame, ts_parser: str = "loose") -> DataFrame:
    """Parse rates per column in one pass: rows, non-null, numeric, date-like."""
    cols = df.columns
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    aggs = []
    for c in cols:
        q = f"`{c}`"
        aggs += [F.count(q).alias(f"nn|{c}"), F.count(F.expr(f"try_cast(replace({q}, ',', '.') AS DOUBLE)")).alias(f"num|{c}"),
                 F.count(F.expr(T.loose_date(q))).alias(f"ts|{c}"), F.count_if(F.length(q) > LONG_VALUE).alias(f"long|{c}")]
    one = text.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"), F.col(f"nn|{c}").alias("non_null"),
                              F.col(f"num|{c}").alias("numeric"), F.col(f"ts|{c}").alias("datelike"),
                              F.col(f"long|{c}").alias("n_long")) for i, c in enumerate(cols)])
    return one.select("n", F.explode(rows).alias("r")).select("n", "r.*")


# --- fixed values: name hints for the observation time and for identifiers -----------------
TIME_PROMOTE = ("date", "datetime", "time", "week", "month", "period", "created", "occur", "report", "start",
                "incident", "observ", "collect", "sample")
TIME_DEMOTE = ("update", "modif", "load", "extract", "ingest", "process", "closed", "resolution")
IDENTIFIER_TOKENS = (
    "id", "_id", "key", "code", "zip", "zipcode", "postal", "lat", "latitude", "lon", "long", "longitude",
    "x_coord", "y_coord", "coordinate", "geoid", "fips", "tract", "block", "beat", "district", "precinct",
    "ward", "sector", "year", "month", "day", "hour", "quarter", "week", "number", "num", "objectid", "row",
    "seq", "phone", "badge", "unit", "council", "ansi",
)


def _hits(col: str, tokens: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(lower({col}), '{t}') AS INT)" for t in tokens)


def numeric_column(n: str = "n", non_null: str = "non_null", numeric: str = "numeric") -> str:
    return f"({numeric} >= 0.3 * {n} OR ({non_null} > 0 AND {numeric} >= 0.8 * {non_null}))"


def assign_roles(profile: DataFrame) -> DataFrame:
    """Observation time, value columns and panel dimensions from the profile."""
    score = F.expr(f"2 * ({_hits('column', TIME_PROMOTE)}) - 3 * ({_hits('column', TIME_DEMOTE)})")
    ident = F.expr("exists(split(lower(column), '[^a-z0-9]+'), t -> array_contains(array("
                   + ", ".join(f"'{t}'" for t in IDENTIFIER_TOKENS) + "), t))"
                   + "".join(f" OR lower(column) LIKE '%\\_{t}' OR lower(column) LIKE '{t}\\_%'" for t in ("key", "id")))
    p = profile.withColumn("is_ts", F.expr("datelike >= greatest(5, 0.8 * non_null)")).withColumn("ts_score", score)
    w = Window.partitionBy()  # one row per column of the table
    best = F.max(F.when(F.col("is_ts"), F.struct("ts_score", (-F.col("pos")).alias("o"), "column"))).over(w)
    p = p.withColumn("ts_col", best["column"])
    role = (F.when(F.col("column") == F.col("ts_col"), "timestamp").when(F.col("is_ts"), "other_time")
            .when(F.expr(numeric_column()) & ident, "identifier").when(F.expr(numeric_column()), "value")
            .when(F.expr("n_long <= 0.01 * non_null"), "panel").otherwise("text"))
    return p.withColumn("role", role).drop("ts_col", "is_ts")


def panel_check(df: DataFrame, ts: str, dims_: list[str], clean: float = 0.8) -> DataFrame:
    """Is one series interleaved per dimension? Distinct stamps against rows, whole and per pinned value."""
    pins = F.array(F.struct(F.lit("").alias("dim"), F.lit("").alias("pin")),
                   *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("pin")) for d in dims_])
    rows = df.select(F.col(ts).alias("t"), F.explode(pins).alias("p")).select("t", "p.*")  # one scan for all
    per = rows.groupBy("dim", "pin", "t").agg(F.count(F.lit(1)).alias("c")).groupBy("dim", "pin").agg(
        F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_stamps"))
    return per.withColumn("panelled", F.col("n_stamps") < clean * F.col("n_rows"))
