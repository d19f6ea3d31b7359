"""Decoders: odd messages, and that no message is parsed more than once."""

import json

from tidemark.plans import payload_reads as R
from tidemark.sources import payloads as P


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sdmx_messages_are_parsed_once(spark):
    plan = _plan(R.sdmx_records(spark, "/root/testdata/sf0.001"))
    assert plan.count("from_json(") == 1


def test_sdmx_series_flat_and_odd_messages(spark):
    dims = {"dimensions": {"observation": [{"id": "OTHER", "values": [{"id": "x"}]}, {"id": "TIME_PERIOD", "values": [{"id": "2020"}, {"id": "2021"}]}]}}
    rows = [
        (1, json.dumps({"dataSets": [{"series": {"0:1": {"observations": {"1": [2.5, 9.0], "0": [None], "7": []}}, "0:2": {}}}], "structure": dims})),
        (2, json.dumps({"dataSets": [{"observations": {"0:3:1": [4.0], "0:3:0": None}}], "structure": dims})),
        (3, json.dumps({"dataSets": [], "structure": dims})), (4, "no message"), (5, None),
        (6, json.dumps({"dataSets": [{"series": {"a": {"observations": {"3": [1.0]}}}}]})),
    ]
    got = P.sdmx_records(spark.createDataFrame(rows, "page long, payload string"), "payload", ["page"])
    assert got.columns == ["page", "series_key", "timestamp", "value"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        (1, "0:1", "2021", 2.5), (1, "0:1", "2020", None), (1, "0:1", "7", None), (2, "", "2021", 4.0), (2, "", "2020", None), (6, "a", "3", 1.0)], key=repr)
