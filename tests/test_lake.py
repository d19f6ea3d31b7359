import os

from tidemark.sources import lake as L


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_append_is_idempotent_and_columns_drift(spark, tmp_path):
    root = str(tmp_path / "lake")
    day1 = rows(spark, [("s", "2024-01-01", "t1", "1"), ("s", "2024-01-01", "t1", "1")], "source_id string, scrape_date string, timestamp string, value string")
    day2 = rows(spark, [("s", "2024-01-02", "t2", "2", "x")], "source_id string, scrape_date string, timestamp string, value string, _panel_k string")
    L.write_day(L.merge_day(None, day1), root)
    L.write_day(L.merge_day(day2, day2), root)
    with open(os.path.join(root, "source_id=s", "scrape_date=2024-01-02", "broken.parquet"), "wb") as f:
        f.write(b"not parquet")
    back = L.read_lake(spark, root)
    assert back.count() == 2
    assert "_panel_k" in back.columns
    assert L.read_lake(spark, root, since="2024-01-02").count() == 1


def test_single_file_source_keeps_duplicates(spark):
    data = [("one", "2024-01-01", 1, "t", "a"), ("one", "2024-01-01", 2, "t", "b"),
            ("two", "2024-01-01", 1, "t", "a"), ("two", "2024-01-02", 1, "t", "b")]
    df = rows(spark, data, "source_id string, scrape_date string, seq long, timestamp string, value string")
    got = {(r["source_id"], r["value"]) for r in L.last_write_wins(df).collect()}
    assert got == {("one", "a"), ("one", "b"), ("two", "b")}


def test_null_panel_key_gives_no_series(spark):
    df = rows(spark, [("s", "a"), ("s", None)], "source_id string, _panel_k string")
    assert [r["series_key"] for r in L.series_index(df, 1).collect()] == ["s|k=a"]


def test_snapshot_diff(spark):
    a = rows(spark, [("x", 1), ("y", 2), ("z", 3)], "key string, length long")
    b = rows(spark, [("x", 1), ("y", 9)], "key string, length long")
    assert {(r["key"], r["why"]) for r in L.snapshot_diff(a, b).collect()} == {("y", "size"), ("z", "missing")}
