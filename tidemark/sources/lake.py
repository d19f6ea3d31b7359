"""The dated, append-only observation lake: partitioned parquet of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PANEL_PREFIX = "_panel_"


def panel_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(PANEL_PREFIX)]


def value_columns(df: DataFrame, *other: str) -> list[str]:
    skip = {"timestamp", "source_id", "scrape_date", "seq", *other}
    return [c for c in df.columns if c not in skip and not c.startswith(PANEL_PREFIX)]


def read_lake(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """All day-files, union by name over drifting columns; unreadable files are skipped.

    ``source_id`` and ``scrape_date`` are partition columns, so ``since`` prunes
    folders and never opens an old file.
    """
    df = (spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True)
          .option("basePath", root).parquet(root))
    return df.where(F.col("scrape_date") >= F.lit(since).cast("date")) if since else df


def as_text(df: DataFrame, keep: tuple[str, ...] = ("source_id", "scrape_date")) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).cast("string").alias(c) for c in df.columns])


def merge_day(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Today's rows after an append: whole-row distinct, so a repeated poll folds away."""
    new = as_text(new)
    both = new if existing is None else as_text(existing).unionByName(new, allowMissingColumns=True)
    return both.dropDuplicates()


def write_day(df: DataFrame, root: str) -> None:
    """Replace exactly the touched (source, day) partitions; the committer makes it atomic."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source_id", "scrape_date").parquet(root))


def last_write_wins(df: DataFrame, order: tuple[str, ...] = ("scrape_date", "seq")) -> DataFrame:
    """Across day-files the newest report of (source, panel, raw timestamp) wins.

    A source with a single day-file is left as it is: there the arrival number
    joins the key, so every row is its own group. One pass over the rows;
    ``max_by`` combines before the shuffle, so a group of copies never gathers
    in one task.
    """
    keys = ["source_id", *panel_columns(df), "timestamp"]
    days = df.select("source_id", "scrape_date").distinct().groupBy("source_id").agg(
        F.count(F.lit(1)).alias("_days"))
    tagged = df.join(days, "source_id").withColumn("_own", F.when(F.col("_days") == 1, F.col(order[-1])))
    rest = [c for c in df.columns if c not in keys]
    best = tagged.groupBy(*keys, "_own").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def series_key(df: DataFrame) -> Column:
    """Identity of a series: source and its sorted panel items; NULL panel keys give NULL."""
    cols = sorted(panel_columns(df))
    parts = [F.concat(F.lit(c[len(PANEL_PREFIX):] + "="), F.col(c)) for c in cols]
    key = F.concat_ws("|", "source_id", *parts)
    return F.when(F.array_contains(F.array(*[F.col(c).isNull() for c in cols]), True), F.lit(None)).otherwise(key) if cols else key


def series_index(df: DataFrame, min_rows: int, per_source: int | None = None) -> DataFrame:
    """Row count per series, the minimum-length gate, and the first N panels per source in key order."""
    counts = (df.withColumn("series_key", series_key(df)).where("series_key IS NOT NULL")
              .groupBy("source_id", "series_key").agg(F.count(F.lit(1)).alias("n_rows"))
              .where(F.col("n_rows") >= min_rows))
    if per_source is None:
        return counts
    w = Window.partitionBy("source_id").orderBy("series_key")
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_source).drop("_r")


def cap_panels(df: DataFrame, cap: int) -> DataFrame:
    """Keep the first ``cap`` panel groups per source in key order.

    The ranking runs over distinct groups; the kept list joins back, so rows of
    a huge panel are never sorted.
    """
    cols = panel_columns(df)
    groups = df.select("source_id", *cols).distinct()
    w = Window.partitionBy("source_id").orderBy(*cols)
    kept = groups.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    return df.join(kept, ["source_id", *cols], "left_semi")


def snapshot_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Files that need a copy: absent on the other side, or of another size."""
    r = remote.select("key", F.col("length").alias("_remote"))
    return local.join(r, "key", "left").where("_remote IS NULL OR _remote <> length").select(
        "key", "length", F.when(F.col("_remote").isNull(), "missing").otherwise("size").alias("why"))


def file_listing(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """Path below ``root`` and size of every file, without reading contents."""
    f = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
         .option("recursiveFileLookup", True).load(root).select("path", "length"))
    # listed paths carry a scheme that ``root`` may lack; what follows the root's own path is the key
    tail = "/" + "/".join(root.rstrip("/").split("://")[-1].split("/")[1:]).strip("/") + "/"
    return f.select(F.expr(f"substring(path, locate({_quoted(tail)}, path) + {len(tail)})").alias("key"), "length")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
