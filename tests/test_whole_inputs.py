"""Cases that caps, rounding or driver memory once dropped."""

import unicodedata

import numpy as np
import pandas as pd

from pyspark.sql import functions as F
from tidemark.functions import text as X, timeparse as T
from tidemark.operators import novelty as N, series as Q
from tidemark.sources import lake as L
from tidemark.streaming import jobs as J


def test_gaps_below_a_millisecond(spark):
    t = spark.range(100).select(F.lit("s").alias("s"), F.expr("timestamp_micros(1000000000 + id * 200 + if(id >= 60, 100000, 0))").alias("ts"))
    assert Q.median_gap(Q.gap_table(t, ["s"], "ts"), ["s"]).first().median_gap_s == 0.0002
    r = Q.longest_segment(Q.segments(t, ["s"], "ts"), ["s"], "ts").first()
    assert (r.longest, r.n_segments) == (60, 2)


def test_every_query_point_gets_a_distance(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e13, 0.0), (3, float("nan"), 0.0)], "id int, x double, y double")
    base = spark.createDataFrame([(0.3, 0.4), (0.0, 1.0)], "x double, y double")
    assert {r.id: r.distance for r in N.nearest_distance(q, base, "id", ["x", "y"], 0.05).collect()} == {1: 0.5, 2: 1e13 - 0.3, 3: None}
    assert {r.distance for r in N.nearest_distance(q, base.limit(0), "id", ["x", "y"], 0.05).collect()} == {None}


def test_tables_survive_a_restart_and_a_retried_batch(spark, tmp_path):
    schema = "k string, ts timestamp, v long"
    row = lambda k, day, v: spark.sql(f"SELECT '{k}' k, TIMESTAMP'2024-01-{day:02d}' ts, {v}L v")

    def merge():
        t = J.KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], fold=2)
        return t, J.upsert_latest(t, ["k"], "ts")

    merge()[1](row("a", 1, 1), 0)
    merge()[1](row("b", 1, 2), 1)  # a new object, as after a restart
    t, again = merge()
    again(row("b", 1, 2), 1)  # the same batch tried again
    assert {(r.k, r.v) for r in t.read().collect()} == {("a", 1), ("b", 2)}
    (tmp_path / "t" / "v=2").mkdir()  # a version whose writer did not finish
    assert t.read().count() == 2


def test_dates_without_seconds_and_folding(spark):
    p = lambda s: spark.sql(f"SELECT CAST({T.parse_ts(repr(s))} AS STRING) t").first().t
    assert p("Fri, 3 Jul 2026 12:57 GMT") == "2026-07-03 12:57:00" == p("Fri, 3 Jul 2026 12:57:00 GMT")
    word = "Počet obyvatel ąęś Ünïțe"
    assert spark.createDataFrame([(word,), (unicodedata.normalize("NFD", word),)], "s string").select(F.expr(X.slug("s"))).distinct().first()[0] == "pocet_obyvatel_aes_unite"


def test_files_of_one_name_in_two_folders_are_two(spark, tmp_path):
    for d in ("a", "b"):
        spark.range(1).coalesce(1).write.parquet(str(tmp_path / d))
        next((tmp_path / d).glob("part-*")).rename(tmp_path / d / "day.parquet")
    got = {r.key for r in L.file_listing(spark, str(tmp_path), "day.parquet").collect()}
    assert got == {"a/day.parquet", "b/day.parquet"}


def test_versions_hold_only_changed_keys(spark, tmp_path):
    t = J.KeyedTable(spark, str(tmp_path / "t"), "k int, ts int, v string", ["k"], fold=3)
    merge = J.upsert_latest(t, ["k"], "ts")
    merge(spark.createDataFrame([(k, 0, "old") for k in range(500)], "k int, ts int, v string"), 0)
    want = {k: (0, "old") for k in range(500)}
    for e in range(1, 9):
        rows = [(e, e, f"new{e}"), (e + 1, -1, "late"), (600 + e, e, "added")]
        merge(spark.createDataFrame(rows, "k int, ts int, v string"), e)
        for k, ts, v in rows:
            if k not in want or ts > want[k][0]:
                want[k] = (ts, v)
        assert spark.read.parquet(f"{t.root}/v={e}").count() == 3
        assert {r.k: (r.ts, r.v) for r in t.read().collect()} == want
    assert len(t._parts(None)[1]) < 3  # folded on the way


def test_levels_equal_a_plain_fold_over_batches_and_buckets(spark, tmp_path):
    rng = np.random.default_rng(5)
    t0 = pd.Timestamp("2024-01-01")
    rows = [("hot", t0 + pd.Timedelta(seconds=int(s)), float(v)) for s, v in zip(np.sort(rng.choice(40_000, 3000, replace=False)), rng.normal(size=3000))]
    rows += [("cold", t0 + pd.Timedelta(seconds=17), 4.0)]
    rows = sorted(rows, key=lambda r: r[1])
    table = J.KeyedTable(spark, str(tmp_path / "levels"), "k string, level double, n long", ["k"])
    fold = J.ewma_levels(table, "k", "ts", "v", 0.3, bucket_seconds=600)
    for e, cut in enumerate(np.array_split(np.arange(len(rows)), 4)):
        batch = spark.createDataFrame(pd.DataFrame([rows[i] for i in cut], columns=["k", "ts", "v"]))
        fold(batch, e)
        fold(batch, e)  # a batch tried again counts once
    want = {}
    for k, _, v in rows:
        want[k] = (v, 1) if k not in want else (0.3 * v + 0.7 * want[k][0], want[k][1] + 1)
    got = {r.k: (r.level, r.n) for r in table.read().collect()}
    assert set(got) == set(want) and all(got[k][1] == n and abs(got[k][0] - x) < 1e-9 for k, (x, n) in want.items())


def test_source_verdicts_of_repeating_series(spark, tmp_path):
    """Sixty months with the same values: long enough, but too few distinct values to pass; query and SQL say so."""
    import os

    from compare import DATA, diff, duck
    from tidemark.registry import load_all

    for name in os.listdir(f"{DATA}/sf0.001"):
        if name != "events.parquet":
            os.symlink(f"{DATA}/sf0.001/{name}", tmp_path / name)
    con = duck(f"{DATA}/sf0.001")
    con.execute(f"COPY (SELECT * REPLACE (event_id + 1000*i AS event_id, ts + to_days((30*i)::INT) AS ts) FROM events, range(60) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    q = load_all()["source_verdicts"]
    df = q.run(spark, str(tmp_path)).localCheckpoint()
    assert {r.reasons for r in df.collect() if r.source_id == "event_hour"} == {"too few series pass"}
    assert diff(df, duck(str(tmp_path)), q.sql) is None
