"""Silence alerts: who is quiet when the replay ends, whatever happened before."""

from pyspark.sql import functions as F

from tidemark.plans import streams as S
from tidemark.session import scratch_path


def test_a_returning_user_is_silent_no_more(spark):
    """User 1 misses a whole arrival and returns; 2 stays away; 3 is quiet for exactly the limit, 4 for a microsecond more."""
    rows = [(1, 1, "2024-01-02 00:00:00"), (2, 2, "2024-01-03 00:00:00"), (3, 5, "2024-01-12 00:00:00"), (4, 5, "2024-01-22 00:00:00"),
            (9, 5, "2024-01-10 00:00:00"), (5, 1, "2024-01-30 10:00:00"), (6, 3, "2024-01-29 09:00:00"), (7, 4, "2024-01-29 08:59:59.999999"), (8, 5, "2024-01-30 09:59:00")]
    rows += [(10 + i, 5, f"2024-01-{d} 01:{i % 60:02}:00") for d in ("05", "15", "25") for i in range(60)]  # every arrival fills its files
    path = scratch_path(spark, "silence")
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.withColumns({"event_type": F.lit("view"), "value": F.lit(1.0)}).write.parquet(f"{path}/events.parquet")
    got = {r.user_id: r.last_ms for r in S.stream_silence(spark, path).collect()}
    assert got == {2: 1_704_240_000_000, 4: 1_706_518_799_999}
