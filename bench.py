"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every result is fully computed through the no-op sink, first cold, then once more warm.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.registry import load_all  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = (
    "leaderboard", "challenge_scores", "metrics_by_model", "panel_batch_forecasts", "friedman_omnibus",
    "bin_records", "last_write_wins", "series_index", "gap_segments", "cadence_profile", "series_quality",
    "motif_extraction", "json_path_records", "csv_records", "parse_timestamps", "freshness_audit",
    "vet_candidates", "coverage_matrix", "stratified_draw", "near_duplicates",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "tidemark-bench")
    spark.sparkContext.setLogLevel("OFF")
    catalogue = load_all()
    spark.read.parquet(f"{sf}/nation.parquet").count()  # start the engine before the clock
    cold, warm = {}, {}
    for times in (cold, warm):
        for name in HEADLINE:
            t = time.perf_counter()
            catalogue[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(cold.values()), 3), "unit": "sec",
                      "queries": cold, "warm": warm, "warm_total": round(sum(warm.values()), 3), "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
