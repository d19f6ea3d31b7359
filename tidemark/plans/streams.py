"""Streaming queries: events replayed as files, drained, and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog as C, series as Q
from tidemark.plans.gate_checks import _EMB, EMB_DIM, NEAR, greedy_sql, unit_vectors
from tidemark.plans.lake_reads import _UG
from tidemark.plans.views import R, load, rnd
from tidemark.registry import query
from tidemark.session import scratch_path
from tidemark.streaming import jobs as J

SPLITS = ("2024-01-11", "2024-01-21")
ROWS_PER_FILE = 500_000


def arrivals(spark, df, ts="ts", splits=SPLITS):
    """Write ``df`` as consecutive arrivals (one folder per period, oldest first) and open them as a stream.

    Every arrival has as many files as a trigger takes, so one micro-batch is one arrival.
    """
    root = scratch_path(spark, "arrivals")
    files = max(4, -(-df.count() // ROWS_PER_FILE))
    edges = [None, *splits, None]
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        part = df
        if lo:
            part = part.where(F.col(ts) >= F.lit(lo).cast("timestamp"))
        if hi:
            part = part.where(F.col(ts) < F.lit(hi).cast("timestamp"))
        part.repartition(files).write.parquet(f"{root}/p{i}")
    return J.open_stream(spark, root, df.schema, files)


def events(spark, sf):
    return load(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _run(spark, df, out_schema_from=None, mode="append"):
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    J.drain(df, sink, ck, mode)
    return spark.read.schema(df.schema).parquet(sink)


@query("stream_dedup", "Z1", "SELECT event_type, count(*) n, round(sum(\"value\"), 2) total FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    """Every report arrives twice inside its period; the sink keeps one."""
    e = events(spark, sf)
    s = arrivals(spark, e.unionByName(e.where("event_id % 2 = 0")))
    got = _run(spark, J.dedup_append(s, "ts", ["event_id"], "2 days"))
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("stream_bins", "Z2", f"""WITH b AS (SELECT date_trunc('hour', ts) h, event_type, count(*) n, sum("value") s FROM events GROUP BY 1,2) SELECT CAST(epoch(h) AS BIGINT) bin, event_type, n, {R('s', 4)} total FROM b WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_bins(spark, sf):
    e = events(spark, sf)
    s = arrivals(spark, e)
    got = _run(spark, J.tumbling_bins(s, "ts", ["event_type"], "value", "1 hour", "1 hour"))
    return got.select(F.unix_seconds("bin").alias("bin"), "event_type", "n", rnd(F.col("total"), 4).alias("total"))


@query("stream_upsert", "Z3", """WITH o AS (SELECT user_id, event_type, ts, "value" FROM events WHERE ts <= TIMESTAMP '2024-01-28') SELECT user_id, event_type, CAST(epoch_us(max(ts)) AS BIGINT) last_us, arg_max("value", ts) "value" FROM o GROUP BY 1,2""")
def stream_upsert(spark, sf):
    """Later reports win per (user, type); rows dated past the horizon never enter."""
    e = events(spark, sf)
    s = arrivals(spark, e)
    t = J.KeyedTable(spark, scratch_path(spark, "latest"), "user_id long, event_type string, ts timestamp, value double", ["user_id", "event_type"])
    J.drain_batches(s, J.upsert_latest(t, ["user_id", "event_type"], "ts", "2024-01-28 00:00:00"), scratch_path(spark, "ck"))
    return t.read().select("user_id", "event_type", F.unix_micros("ts").alias("last_us"), "value")


@query("stream_sessions", "Z4 W2", f"""WITH {_UG}, w AS (SELECT max(ts) - INTERVAL 1 HOUR wm FROM events), s AS (SELECT g.user_id, ts, round(8*med, 6) lim, sum(CASE WHEN gap >= round(8*med, 6) THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY ts) seg FROM g JOIN m USING (user_id))
SELECT user_id, count(*) n, CAST(epoch_us(min(ts)) AS BIGINT) first_us FROM s, w GROUP BY user_id, seg HAVING max(ts) + to_microseconds(CAST(any_value(lim)*1000000 AS BIGINT)) <= any_value(wm)""")
def stream_sessions(spark, sf):
    e = events(spark, sf).select("user_id", "ts").distinct()
    gaps = Q.median_gap(Q.gap_table(e, ["user_id"], "ts"), ["user_id"]).select("user_id", F.round(F.col("median_gap_s") * 8, 6).alias("lim"))
    s = arrivals(spark, e)
    got = _run(spark, J.gap_sessions(s, "ts", ["user_id"], gaps, "lim", "1 hour"))
    return got.select("user_id", "n", F.unix_micros("first").alias("first_us"))


@query("stream_novelty", "Z5 L2", f"""WITH RECURSIVE {_EMB}, f1 AS (SELECT * FROM e WHERE vec_id % 2 = 0), {greedy_sql("g1", "f1")}, a1 AS MATERIALIZED (SELECT e.* FROM e JOIN g1 USING (vec_id)),
f2 AS (SELECT * FROM e WHERE vec_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM a1 WHERE list_dot_product(e.v, a1.v) >= {NEAR})), {greedy_sql("g2", "f2")}
SELECT vec_id FROM a1 UNION ALL SELECT vec_id FROM g2""")
def stream_novelty(spark, sf):
    """Two arrivals of vectors: each is admitted against everything served so far."""
    v = unit_vectors(spark, sf).withColumn("ts", F.expr("if(vec_id % 2 = 0, TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-02')"))
    s = arrivals(spark, v, splits=("2024-01-02",))
    t = J.KeyedTable(spark, scratch_path(spark, "served"), "vec_id long, vec array<double>", ["vec_id"])
    J.drain_batches(s, J.served_memory(t, "vec_id", "vec", EMB_DIM, NEAR), scratch_path(spark, "ck"))
    return t.read().select("vec_id")


@query("stream_ewma", "Z6 M3", f"""WITH s AS (SELECT event_type, list("value" ORDER BY ts) v, count(*) n FROM events GROUP BY 1) SELECT event_type, n, {R('list_reduce(v, lambda a, x: 0.7::DOUBLE*a + 0.3::DOUBLE*x)')} "level" FROM s""")
def stream_ewma(spark, sf):
    e = events(spark, sf).select("event_type", "ts", "value")
    s = arrivals(spark, e)
    t = J.KeyedTable(spark, scratch_path(spark, "levels"), "event_type string, level double, n long", ["event_type"])
    J.drain_batches(s, J.ewma_levels(t, "event_type", "ts", "value"), scratch_path(spark, "ck"))
    return t.read().select("event_type", "n", rnd(F.col("level")).alias("level"))


@query("stream_silence", "Z7 O1", """SELECT user_id, CAST(epoch_us(max(ts)) // 1000 AS BIGINT) last_ms FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 1 DAY < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_silence(spark, sf):
    """Users quiet for more than a day of event time when the replay ends."""
    e = events(spark, sf).select("user_id", "ts")
    s = arrivals(spark, e)
    t = J.KeyedTable(spark, scratch_path(spark, "seen"), "user_id long, ts timestamp, silent boolean", ["user_id"])
    J.drain_batches(s, J.silence_alerts(t, "user_id", "ts", 86_400_000, "1 hour"), scratch_path(spark, "ck"))
    return t.read().where("silent").select("user_id", F.expr("unix_micros(ts) div 1000").alias("last_ms"))


@query("stream_ledger", "Z8 Q7", """SELECT concat(event_type, '|', user_id % 20) key, concat('u', arg_min(user_id, event_id)) "name", count(*) times_proposed, CASE WHEN count(CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 END) > 0 THEN 'rejected' ELSE 'proposed' END status FROM events GROUP BY 1""")
def stream_ledger(spark, sf):
    """Proposals arriving in batches merge into one ledger."""
    p = events(spark, sf).selectExpr("ts", "event_id AS seq", "concat(event_type, '|', user_id % 20) AS key", "concat('u', user_id) AS name", "event_type AS domain",
                                     "'PT1H' AS frequency", "if(event_type = 'error' AND event_id % 5 = 0, 'reject', 'accept') AS verdict")
    s = arrivals(spark, p)
    t = J.KeyedTable(spark, scratch_path(spark, "ledger"), "key string, name string, domain string, frequency string, status string, first_proposed string, times_proposed long", ["key"])
    J.drain_batches(s, lambda b, i: t.write(C.ledger_upsert(t.rows_of(b, i), b, f"batch-{i}"), i), scratch_path(spark, "ck"))
    return t.read().select("key", "name", "times_proposed", "status")
