"""Skew-safe operators against brute force, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bounded as B, series as Q


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 6000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"k": key, "v": np.round(rng.normal(size=n), 2)})
    return pdf, spark.createDataFrame(pdf)


def test_exact_percentiles(skewed):
    pdf, df = skewed
    got = B.exact_percentiles(df, ["k"], "v", {"p0": 0.0, "p33": 0.33, "med": 0.5, "p1": 1.0}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k, ["p0", "p33", "med", "p1"]].astype(float), np.percentile(g["v"], [0, 33, 50, 100]))


def test_percentiles_without_key(skewed):
    pdf, df = skewed
    got = B.exact_percentiles(df, [], "v", {"med": 0.5}).first()["med"]
    assert got == pytest.approx(pdf["v"].median())


def test_average_ranks(skewed):
    pdf, df = skewed
    got = B.value_ranks(df, ["k"], "v").toPandas()
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).drop_duplicates(["k", "v"])
    m = got.merge(want, on=["k", "v"])
    assert len(m) == len(want) and np.allclose(m["avg_rank"], m["r"])


def test_previous_and_running_count_cross_buckets(spark):
    rng = np.random.default_rng(5)
    sec = np.sort(rng.choice(500_000, 4000, replace=False))
    pdf = pd.DataFrame({"k": np.where(np.arange(4000) % 3 > 0, "hot", "cold"), "ts": pd.to_datetime(sec, unit="s")})
    df = spark.createDataFrame(pdf)
    got = B.previous_in_time(df, ["k"], "ts", {"ts": "prev"}).toPandas().sort_values(["k", "ts"])
    want = pdf.sort_values(["k", "ts"]).groupby("k")["ts"].shift()
    assert (got["prev"].isna().to_numpy() == want.isna().to_numpy()).all()
    assert (got["prev"].dropna().astype("datetime64[ns]").to_numpy() == want.dropna().astype("datetime64[ns]").to_numpy()).all()
    flagged = df.withColumn("f", (F.unix_seconds("ts") % 7 == 0).cast("bigint"))
    run = B.running_count_in_time(flagged, ["k"], "ts", "f", "c").toPandas().sort_values(["k", "ts"])
    exp = pdf.assign(f=(sec % 7 == 0).astype(int)).sort_values(["k", "ts"]).groupby("k")["f"].cumsum()
    assert (run["c"].to_numpy() == exp.to_numpy()).all()


def test_longest_segment_takes_first_on_tie(spark):
    base = pd.Timestamp("2024-01-01")
    ts = [base + pd.Timedelta(hours=h) for h in (0, 1, 2, 100, 101, 102)]
    df = spark.createDataFrame(pd.DataFrame({"k": "s", "ts": ts}))
    r = Q.longest_segment(Q.segments(df, ["k"], "ts"), ["k"], "ts").first()
    assert (r["longest"], r["n_segments"]) == (3, 2)
    assert r["start"] == base.to_pydatetime()
