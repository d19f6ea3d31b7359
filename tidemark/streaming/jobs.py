"""Structured Streaming forms of ingest, binning, sessions, state and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tidemark.session import freeze


def open_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("recursiveFileLookup", True).parquet(path))


def drain(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything available, into a parquet sink, exactly once."""
    q = (df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def drain_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = (df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def dedup_append(df: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Idempotent re-polls: an identical report inside the watermark is written once."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def tumbling_bins(df: DataFrame, ts: str, keys: list[str], value: str, width: str, delay: str) -> DataFrame:
    """Count, sum and mean per clock bin; a bin appears once, when the watermark has passed it."""
    g = df.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("window.start").alias("bin"), *keys, "n", "total", "mean")


def gap_sessions(df: DataFrame, ts: str, keys: list[str], gaps: DataFrame, gap_s: str, delay: str) -> DataFrame:
    """Contiguous runs per series with that series' own gap limit, from a static table."""
    j = df.join(gaps, keys).withWatermark(ts, delay)
    width = F.expr(f"CAST(concat(CAST(greatest({gap_s}, 0.000001) AS DECIMAL(18, 6)), ' seconds') AS STRING)")
    g = j.groupBy(F.session_window(ts, width).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return g.select(*keys, "n", "first", "last")


class VersionedTable:
    """A keyed table of one folder per version; the folders are its only state.

    A version counts once its writer has left the success marker. A batch reads
    the newest version below its own number, so after a restart, or when a batch
    is tried again, it builds on what the batch before it left.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root, schema

    def _versions(self) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(hadoop.Path(f"{self.root}/{n}/_SUCCESS")))

    def read(self, below: int | None = None) -> DataFrame:
        """The newest complete version, or the newest one below ``below``."""
        found = [v for v in self._versions() if below is None or v < below]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={found[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")


class KeyedTable(VersionedTable):
    """A durable table of one row per key; a version holds only the keys that its batch changed.

    What is written follows the batch and not the table. A read takes each
    key's newest row from the last whole table and the versions after it; after
    every ``fold`` versions they are folded into a new whole table.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], fold: int = 16) -> None:
        super().__init__(spark, root, schema)
        self.keys, self.fold = keys, fold
        self.whole = VersionedTable(spark, f"{root}-whole", schema)

    def _parts(self, below: int | None) -> tuple[int, list[int]]:
        bases = [v for v in self.whole._versions() if below is None or v < below]
        base = bases[-1] if bases else -1
        return base, [v for v in self._versions() if v > base and (below is None or v < below)]

    def read(self, below: int | None = None) -> DataFrame:
        base, parts = self._parts(below)
        rows = self.whole.read(base + 1).withColumn("_v", F.lit(base).cast("long"))
        for v in parts:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.root}/v={v}").withColumn("_v", F.lit(v).cast("long")))
        cols = [c for c in rows.columns if c not in [*self.keys, "_v"]]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*cols), "_v").alias("_r")).select(*self.keys, "_r.*")

    def rows_of(self, batch: DataFrame, below: int) -> DataFrame:
        """The present rows of the keys in ``batch``."""
        return self.read(below).join(batch.select(*self.keys).distinct(), self.keys, "left_semi")

    def write(self, df: DataFrame, version: int) -> None:
        """The changed rows of a batch; a batch tried again rewrites its version."""
        super().write(df, version)
        if len(self._parts(version + 1)[1]) >= self.fold:
            self.whole.write(self.read(version + 1), version)


def upsert_latest(table: KeyedTable, keys: list[str], order: str, horizon: str | None = None) -> Callable[[DataFrame, int], None]:
    """Last-write-wins merge of each batch; rows planned past the horizon never enter.

    Only the keys of the batch are written. A retried batch rewrites the same
    version, so a lost executor or driver does not apply it twice.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch if horizon is None else batch.where(F.col(order) <= F.lit(horizon).cast("timestamp"))
        old = table.rows_of(rows, epoch)
        cols = [c for c in old.columns if c not in keys]
        both = old.unionByName(rows.select(*keys, *cols))
        best = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*keys, "_r.*")
        table.write(best, epoch)

    return merge


def served_memory(table: KeyedTable, id_: str, vec: str, dim: int, threshold: float) -> Callable[[DataFrame, int], None]:
    """Admit only vectors unlike anything ever served, and remember the admitted ones."""
    from tidemark.operators.novelty import admit_batch

    def admit(batch: DataFrame, epoch: int) -> None:
        seen = table.read(epoch)
        fresh = batch.select(id_, vec).join(admit_batch(batch.select(id_, vec), seen, id_, vec, dim, threshold).select(id_), id_, "left_semi")
        table.write(fresh.select(*seen.columns), epoch)

    return admit


def level_maps(rows: DataFrame, key: str, ts: str, value: str, alpha: float, bucket_seconds: int) -> DataFrame:
    """(key, n, first, gain): what the rows of a batch do to a running exponential level.

    A row is the affine map level -> alpha * value + (1 - alpha) * level, so n
    rows in order are level -> gain + (1 - alpha)^n * level. Rows are combined
    within (key, clock bucket), where each weighs by how many follow it there;
    then the few bucket maps of a key in order of their buckets. No task meets
    a key's rows of a whole trigger.
    """
    later = Window.partitionBy(key, "_b").orderBy(F.col(ts).desc(), F.col(value).desc())
    r = rows.withColumn("_b", F.floor(F.unix_micros(ts) / (bucket_seconds * 1_000_000))).withColumn("_k", F.row_number().over(later) - 1)
    weight = alpha * F.pow(F.lit(1 - alpha), F.col("_k"))
    bucket = r.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("n"), F.sum(weight * F.col(value)).alias("gain"), F.min_by(value, F.struct(ts, value)).alias("first"))
    behind = Window.partitionBy(key).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.withColumn("_after", F.coalesce(F.sum("n").over(behind), F.lit(0)))
    return bucket.groupBy(key).agg(F.sum("n").alias("n"), F.min_by("first", "_b").alias("first"), F.sum(F.col("gain") * F.pow(F.lit(1 - alpha), F.col("_after"))).alias("gain"))


def ewma_levels(table: KeyedTable, key: str, ts: str, value: str, alpha: float = 0.3, bucket_seconds: int = 60) -> Callable[[DataFrame, int], None]:
    """Running exponential level per series over batches in time order; ``table`` holds (key, level double, n long).

    A series' first value is its first level. Rows of one instant go by value.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        maps = level_maps(batch.where(F.col(value).isNotNull()), key, ts, value, alpha, bucket_seconds)
        old = table.read(epoch).select(key, "level", F.col("n").alias("_n"))
        new = maps.join(old, key, "left")
        level = F.col("gain") + F.pow(F.lit(1 - alpha), F.col("n")) * F.coalesce("level", "first")
        table.write(new.select(key, level.alias("level"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), epoch)

    return fold


def silence_alerts(table: KeyedTable, key: str, ts: str, limit_ms: int, delay: str) -> Callable[[DataFrame, int], None]:
    """Series are silent once event time, less the delay, has moved past their last row by more than the limit.

    ``table`` holds (key, ts timestamp, silent boolean): the last row of every
    series and whether it was alerted. The rows of a batch meet as one maximum
    per series; a version holds the series of its batch and those that fell
    silent with it, which are its alerts. A series that returns is silent no more.
    """

    def watch(batch: DataFrame, epoch: int) -> None:
        old = table.read(epoch).select(key, ts, "silent", F.lit(False).alias("_new"))
        rows = batch.groupBy(key).agg(F.max(ts).alias(ts)).withColumns({"silent": F.lit(False), "_new": F.lit(True)})
        both = old.unionByName(rows)
        seen = freeze(both.groupBy(key).agg(F.max(F.struct(ts, "silent")).alias("_r"), F.max("_new").alias("_new")).select(key, "_r.*", "_new"))
        edge = F.lit(seen.agg(F.unix_micros(F.max(ts) - F.expr(f"INTERVAL {delay}"))).first()[0]).cast("long")
        now = F.coalesce(F.unix_micros(ts) + limit_ms * 1000 < edge, F.lit(False))
        table.write(seen.where(F.col("_new") | (now & ~F.col("silent"))).select(key, ts, (F.col("silent") | now).alias("silent")), epoch)

    return watch
