"""Payload decoders: a table of raw documents in, timestamped records out.

Every decoder is a projection plus an explode over one document per row, so a
corpus of documents of one kind is decoded in a single narrow stage. All values
stay text, as the lake stores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import jsonpath as J, timeparse as T


def _rows(df: DataFrame, keep: list[str], arrays: dict[str, str], count: str) -> DataFrame:
    """Zip equally indexed arrays to rows; shorter arrays pad with NULL, scalars repeat."""
    df = df.withColumn("_i", F.expr(f"explode(sequence(0, {count} - 1))"))
    return df.select(*keep, *[F.expr(e).alias(n) for n, e in arrays.items()])


def json_records(df: DataFrame, payload: str, keep: list[str], ts: str, values: list[str],
                 panel: list[str] = (), now: str = "current_timestamp()") -> DataFrame:
    """Aligned timestamp / value / panel paths to rows.

    A scalar timestamp is broadcast over list values; no timestamp path means a
    snapshot stamped ``now``; no list at all gives one row.
    """
    df = df.withColumn("_v", F.expr(f"try_parse_json({payload})"))
    names = J.value_names(list(values))
    paths = {n: p for n, p in zip(names, values)}
    paths.update({f"_panel_{J.leaf_name(p)}": p for p in panel})
    df = df.select("*", *[F.expr(J.walk("_v", p)).alias(f"_a_{n}") for n, p in paths.items()],
                   *([F.expr(J.walk("_v", ts)).alias("_ts")] if ts else []))
    lists = [f"size(_a_{n})" for n, p in paths.items() if J.is_list(p) and not n.startswith("_panel_")]
    if ts and J.is_list(ts):
        count, stamp = "size(_ts)", "get(_ts, _i)"
    else:
        count = f"greatest({', '.join(lists)}, 1)" if lists else "1"
        stamp = "_ts" if ts else None
    if stamp is None:
        out = {"timestamp": f"CAST({now} AS STRING)"}
    else:
        out = {"timestamp": T.epoch_or_label(stamp)}
    df = df.where(F.expr(f"{count} > 0"))
    for n, p in paths.items():
        out[n] = f"get(_a_{n}, _i)" if J.is_list(p) else f"_a_{n}"
    return _rows(df, keep, out, count)


def date_map_records(df: DataFrame, payload: str, keep: list[str], values: list[str]) -> DataFrame:
    """``{date: number}`` maps: keys are the timestamps, several maps union on key."""
    names = J.value_names(list(values))
    df = df.withColumn("_v", F.expr(f"try_parse_json({payload})"))
    maps = [F.expr(J.walk("_v", p, "map<string,string>")).alias(f"_m_{n}") for n, p in zip(names, values)]
    df = df.select(*keep, *maps)
    keys = ", ".join(f"coalesce(map_keys(_m_{n}), CAST(array() AS ARRAY<STRING>))" for n in names)
    df = df.withColumn("timestamp", F.expr(f"explode(array_distinct(concat({keys})))"))
    return df.select(*keep, "timestamp", *[F.try_element_at(f"_m_{n}", F.col("timestamp")).alias(n) for n in names])


def stepped_records(df: DataFrame, payload: str, keep: list[str], anchor: str, step: str,
                    values: list[str], newest_first: bool = False, skip: int = 0,
                    now: str = "current_timestamp()") -> DataFrame:
    """Start + fixed step (or newest-first from an end) to timestamped rows.

    ``anchor`` is a path or the word ``now`` (floored to the step); ``step`` is an
    ISO duration or a path to milliseconds. Skipping drops the head of the array
    and never moves the stamps of the rest.
    """
    import re

    df = df.withColumn("_v", F.expr(f"try_parse_json({payload})"))
    if re.match(r"^P", step):
        secs = T.duration_seconds(f"'{step}'")
    else:
        raw = J.walk("_v", step, "double")
        secs = f"CAST(if({raw} >= 1000, {raw} / 1000, {raw}) AS BIGINT)"
    df = df.withColumn("_step", F.expr(secs))
    if anchor == "now":
        start = f"unix_seconds({now}) - pmod(unix_seconds({now}), _step)"
    else:
        raw = J.walk("_v", anchor)
        start = (f"coalesce(if(try_cast({raw} AS DOUBLE) > 1e11, CAST(try_cast({raw} AS DOUBLE) / 1000 AS BIGINT), "
                 f"try_cast({raw} AS BIGINT)), unix_seconds(try_cast({raw} AS TIMESTAMP)))")
    names = J.value_names(list(values))
    arr = [F.expr(J.walk("_v", p + "[]" if not J.is_list(p) else p)).alias(f"_a_{n}") for n, p in zip(names, values)]
    df = df.select(*keep, "_step", F.expr(start).alias("_start"), *arr)
    n = f"least({', '.join(f'size(_a_{n})' for n in names)})" if len(names) > 1 else f"size(_a_{names[0]})"
    df = df.where(F.expr(f"{n} > {skip} AND _step > 0 AND _start IS NOT NULL"))
    df = df.withColumn("_i", F.expr(f"explode(sequence({skip}, {n} - 1))"))
    sign = "-" if newest_first else "+"
    out = ["value"] if len(names) == 1 else names
    return df.select(*keep, F.expr(f"timestamp_seconds(_start {sign} _step * _i)").alias("timestamp"),
                     *[F.expr(f"_a_{n}[_i]").alias(o) for n, o in zip(names, out)])


_CUBE = ("id array<string>, size array<int>, value array<double>, role struct<time: array<string>>, "
         "dimension map<string, struct<category: struct<index: map<string,int>, label: map<string,string>>>>")
_CUBE_LIST = "dimension map<string, struct<category: struct<index: array<string>>>>"


def cube_records(df: DataFrame, payload: str, keep: list[str], time_dims: list[str] | None = None) -> DataFrame:
    """Flat C-order array x dimensions to long rows; time dims compose, the rest is panel."""
    df = df.select(*keep, F.from_json(payload, _CUBE).alias("c"), F.from_json(payload, _CUBE_LIST).alias("cl"))
    codes = ("coalesce(transform(array_sort(map_entries(try_element_at(c.dimension, d).category.index), "
             "(a, b) -> a.value - b.value), e -> e.key), try_element_at(cl.dimension, d).category.index)")
    label = ("if(k RLIKE '^[0-9]{1,2}$', coalesce(try_element_at(try_element_at(c.dimension, d).category.label, k), k), k)")
    df = df.withColumn("labels", F.expr(f"transform(c.id, d -> transform({codes}, k -> {label}))"))
    df = df.withColumn("strides", F.expr(
        "transform(c.size, (s, i) -> aggregate(slice(c.size, i + 2, size(c.size)), 1, (a, v) -> a * v))"))
    if time_dims:
        tset = "array(" + ", ".join(f"'{d}'" for d in time_dims) + ")"
    else:
        tset = ("array(coalesce(get(filter(c.role.time, d -> array_contains(c.id, d)), 0), "
                "get(filter(c.id, d -> lower(d) IN ('tid', 'time', 'time_period', 'date', 'period')), 0)))")
    df = df.withColumn("tdims", F.expr(tset)).where("size(c.id) = size(c.size)")
    df = df.select(*keep, "c.id", "c.size", "labels", "strides", "tdims", F.posexplode("c.value").alias("f", "value"))
    at = "element_at(element_at(labels, array_position(id, d)), CAST(f div element_at(strides, array_position(id, d)) % element_at(size, array_position(id, d)) AS INT) + 1)"
    parts = f"transform(tdims, d -> {at})".replace("array_position(id, d)", "CAST(array_position(id, d) AS INT)")
    others = f"filter(id, d -> NOT array_contains(tdims, d) AND element_at(size, CAST(array_position(id, d) AS INT)) > 1)"
    pvals = f"transform(others, d -> {at})".replace("array_position(id, d)", "CAST(array_position(id, d) AS INT)")
    df = df.where("value IS NOT NULL").withColumn("others", F.expr(others)).withColumn("_parts", F.expr(parts))
    return df.select(*keep, F.expr(T.compose_statbank("_parts")).alias("timestamp"), "value",
                     F.expr(f"map_from_arrays(others, {pvals})").alias("panel"))


_SDMX = ("dataSets array<struct<series: map<string, struct<observations: map<string, array<double>>>>, "
         "observations: map<string, array<double>>>>, structure struct<dimensions: struct<observation: "
         "array<struct<id: string, values: array<struct<id: string>>>>>>")


def sdmx_records(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Series / observation index maps to (period, value); flat observations when no series exist.

    A message is parsed once, and its rows leave it with their periods: no row carries the list of them.
    """
    df = df.select(*keep, F.from_json(payload, _SDMX).alias("s"))
    df = df.select(*keep, F.expr("get(s.dataSets, 0)").alias("d"), F.expr(
        "transform(get(filter(s.structure.dimensions.observation, d -> d.id = 'TIME_PERIOD'), 0).values, v -> v.id)").alias("periods"))
    cells = ("transform(coalesce(map_entries({obs}), array()), o -> named_struct('series_key', {key}, "
             "'i', CAST(element_at(split(o.key, ':'), {part}) AS INT), 'value', get(o.value, 0)))")
    series = f"flatten(transform(map_entries(d.series), e -> {cells.format(obs='e.value.observations', key='e.key', part=1)}))"
    flat = cells.format(obs="d.observations", key="''", part=-1)
    rows = F.expr(f"transform(if(size(coalesce(d.series, map())) > 0, {series}, {flat}), "
                  "c -> named_struct('series_key', c.series_key, 'timestamp', coalesce(get(periods, c.i), CAST(c.i AS STRING)), 'value', c.value))")
    # outer, else the optimizer filters by the whole expression before it explodes it
    df = df.select(*keep, F.explode_outer(rows).alias("c")).where("c IS NOT NULL")
    return df.select(*keep, "c.series_key", "c.timestamp", "c.value")


# --- delimited text -------------------------------------------------------------------
DELIMITERS = (",", ";", "\\t", "|")


def _cells(line: str, delim: str) -> str:
    """Quote-aware split of one line; quotes around a cell are removed."""
    rx = f"concat('[', {delim}, '](?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)')"
    return f"transform(split({line}, {rx}, -1), c -> trim(regexp_replace(trim(c), '^\"|\"$', '')))"


def _table(df: DataFrame, payload: str, keep: list[str], comment: str | None, skip_rows: int,
           delim: str | None, columns: list[str] | None) -> DataFrame:
    drop = f" AND NOT startswith(l, '{comment}')" if comment else ""
    df = df.withColumn("_lines", F.expr(f"filter(split({payload}, '\\r?\\n'), l -> trim(l) <> ''{drop})"))
    if skip_rows:
        df = df.withColumn("_lines", F.expr(f"slice(_lines, {skip_rows + 1}, size(_lines))"))
    if delim is None:
        counts = ", ".join(f"named_struct('n', size(split(get(_lines, 0), '[{d}]')), 'o', {-i}, 'd', '{d}')"
                           for i, d in enumerate(DELIMITERS))
        df = df.withColumn("_d", F.expr(f"array_max(array({counts})).d"))
    else:
        df = df.withColumn("_d", F.lit(delim))
    if columns is None:
        df = df.withColumn("_head", F.expr(_cells("get(_lines, 0)", "_d"))).withColumn("_body", F.expr("slice(_lines, 2, size(_lines))"))
    else:
        df = df.withColumn("_head", F.array(*[F.lit(c) for c in columns])).withColumn("_body", F.col("_lines"))
    return df.select(*keep, "_head", "_d", F.posexplode("_body").alias("line_no", "_line")).withColumn(
        "_cells", F.expr(_cells("_line", "_d")))


def _col(name: str) -> str:
    return f"get(_cells, CAST(array_position(_head, '{name}') AS INT) - 1)"


def csv_records(df: DataFrame, payload: str, keep: list[str], ts: str, values: list[str], panel: list[str] = (),
                comment: str | None = None, skip_rows: int = 0, delim: str | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """Delimited text to records; a timestamp named as 'A B' composes columns A and B."""
    t = _table(df, payload, keep, comment, skip_rows, delim, columns)
    parts = ts.split(" ")
    stamp = _col(ts) if len(parts) == 1 else T.compose_ts("_parts")
    t = t.withColumn("_parts", F.expr(f"array({', '.join(_col(p) for p in parts)})"))
    return t.select(*keep, "line_no", F.expr(stamp).alias("timestamp"),
                    *[F.expr(f"nullif({_col(v)}, '')").alias(v) for v in values],
                    *[F.expr(_col(p)).alias(f"_panel_{p}") for p in panel])


def wide_records(df: DataFrame, payload: str, keep: list[str], id_fields: list[str]) -> DataFrame:
    """One column per date: melt to (timestamp, value, panel), blank cells skipped."""
    t = _table(df, payload, keep, None, 0, None, None)
    t = t.select(*keep, *[F.expr(_col(i)).alias(f"_panel_{i}") for i in id_fields],
                 F.explode(F.arrays_zip("_head", "_cells")).alias("z"))
    t = t.where(F.expr("z._head RLIKE '^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$' AND z._cells <> ''"))
    return t.select(*keep, *[f"_panel_{i}" for i in id_fields], F.col("z._head").alias("timestamp"), F.col("z._cells").alias("value"))


def whitespace_records(df: DataFrame, line: str, keep: list[str], date_cols: list[int], value_col: int,
                       missing: tuple[str, ...] = ("MM", "-999", "99.00")) -> DataFrame:
    """Whitespace table with sentinel-missing cells."""
    bad = ", ".join(f"'{m}'" for m in missing)
    df = df.withColumn("_c", F.expr(f"split(trim({line}), '\\\\s+')"))
    parts = ", ".join(f"get(_c, {i})" for i in date_cols)
    v = f"get(_c, {value_col})"
    return df.where(F.expr(f"NOT startswith({line}, '#') AND {v} NOT IN ({bad}) AND try_cast({v} AS DOUBLE) IS NOT NULL")).select(
        *keep, F.expr(T.compose_ts(f"array({parts})")).alias("timestamp"), F.expr(f"try_cast({v} AS DOUBLE)").alias("value"))


def minute_counts(df: DataFrame, line: str) -> DataFrame:
    """NDJSON event log to per-minute counts without decoding the objects."""
    minute = F.regexp_extract(line, r'"created_at":"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})', 1)
    return df.select(minute.alias("m")).where("m <> ''").groupBy("m").agg(F.count(F.lit(1)).alias("value")).select(
        F.concat("m", F.lit(":00Z")).alias("timestamp"), "value")


# --- markup -----------------------------------------------------------------------------


def _xml_schema(paths: list[str]) -> str:
    """Row schema covering the fields: '_x' holds attribute x, '_VALUE' the text beside attributes."""
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.split("/"):
            node = node.setdefault(part, {})

    def ddl(node: dict, top: bool) -> str:
        if not node:
            return "string"
        cols = [f"`{'_' + k[1:] if k.startswith('@') else k}`: {ddl(v, False)}" for k, v in node.items()]
        if not top and any(k.startswith("@") for k in node):
            cols.append("`_VALUE`: string")
        return f"struct<{', '.join(cols)}>"

    return ddl(tree, True)[len("struct<"):-1].replace("`: ", "` ")


def _xml_field(p: str, paths: list[str]) -> str:
    has_attr = any(q != p and q.startswith(p + "/@") for q in paths)
    cols = [f"`_{k[1:]}`" if k.startswith("@") else f"`{k}`" for k in p.split("/")]
    return "x." + ".".join(cols + (["`_VALUE`"] if has_attr else []))


def xml_records(df: DataFrame, payload: str, keep: list[str], record: str, ts: str, values: list[str],
                panel: list[str] = ()) -> DataFrame:
    """Every record element to a row; '@x' reads an attribute, 'a/b' a child path, 'a/@x' its attribute.

    Each record is cut out of its document and parsed once with a schema made
    from the declared fields.
    """
    recs = f"regexp_extract_all({payload}, r'(?s)<{record}\\b[^>]*?(?:/>|>.*?</{record}>)', 0)"
    paths = [ts, *values, *panel]
    df = df.select(*keep, F.expr(f"explode({recs})").alias("_r")).select(
        *keep, F.from_xml("_r", _xml_schema(paths)).alias("x"))
    name = lambda p: p.split("/")[-1].lstrip("@")
    return df.select(*keep, F.expr(T.epoch_or_label(_xml_field(ts, paths))).alias("timestamp"),
                     *[F.expr(_xml_field(v, paths)).alias(name(v)) for v in values],
                     *[F.expr(_xml_field(p, paths)).alias(f"_panel_{name(p)}") for p in panel])


def feed_records(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """RSS items and Atom entries: time and category, else title."""
    def one(tag: str) -> str:
        return f"regexp_extract_all({payload}, r'(?s)<{tag}\\b[^>]*>.*?</{tag}>', 0)"

    df = df.select(*keep, F.expr(f"explode(if(size({one('item')}) > 0, {one('item')}, {one('entry')}))").alias("_r"))
    df = df.select(*keep, F.from_xml("_r", "pubDate string, updated string, title string, "
                                     "category struct<_term: string, _VALUE: string>").alias("x"))
    val = "coalesce(x.category._VALUE, x.category._term, x.title, '')"
    return df.select(*keep, F.expr(T.epoch_or_label("coalesce(x.pubDate, x.updated)")).alias("timestamp"),
                     F.expr(val).alias("value"))


def html_table_records(df: DataFrame, html: str, keep: list[str], ts: str | None = None, value: str | None = None) -> DataFrame:
    """First table of each page: header names pick the columns, short rows are dropped."""
    cell = "transform(regexp_extract_all({r}, r'(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>', 1), c -> trim(regexp_replace(c, r'(?s)<[^>]+>', '')))"
    df = df.select(*keep, F.expr(f"regexp_extract({html}, r'(?is)<table\\b[^>]*>(.*?)</table>', 1)").alias("_t"))
    df = df.withColumn("_rows", F.expr("regexp_extract_all(_t, r'(?is)<tr\\b[^>]*>(.*?)</tr>', 1)")).where("size(_rows) > 1")
    df = df.withColumn("_head", F.expr(cell.format(r="_rows[0]")))
    df = df.select(*keep, "_head", F.expr("posexplode(slice(_rows, 2, size(_rows)))").alias("row_no", "_r"))
    df = df.withColumn("_cells", F.expr(cell.format(r="_r"))).where("size(_cells) >= size(_head)")
    t = _col(ts) if ts else "_cells[0]"
    v = _col(value) if value else "get(_cells, 1)"
    return df.select(*keep, "row_no", F.expr(t).alias("timestamp"), F.expr(f"coalesce(CAST(try_cast(replace({v}, ',', '') AS DOUBLE) AS STRING), {v})").alias("value"))
