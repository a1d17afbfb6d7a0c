"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from filecensus.operators.scale import release
from filecensus.queries import QUERIES
from filecensus.session import local_session

HEADLINE = [
    "proposal_rollup", "exact_duplicates", "duplicate_members", "verify_detail", "incremental_diff", "unique_paths",
    "route_default", "near_duplicates", "build_paths", "walk", "failure_runs", "progress_snapshot", "rate_history",
    "route_into_existing", "assign_paths", "expand_folders", "mirror_repair_plan", "live_catalog", "breaker_alerts",
]


def run(spark, folder: str, name: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, folder, "status_counts")  # start executors and code generation
    times = {}
    for name in names:
        run(spark, folder, name)
        times[name] = round(min(run(spark, folder, name) for _ in range(2)), 3)
    release(spark)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
