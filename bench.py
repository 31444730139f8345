"""Time the headline queries: median of the repeats (BENCH_REPEATS, 1 by default) after one warm-up, one JSON line.

Each result is written to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from plantpulse.plans.catalog import CATALOG
from plantpulse.session import local_session

HEADLINE = [
    "upsert_measurements", "rollup_1m", "rollup_15m", "rollup_1h", "rollup_refresh", "backfill_summary",
    "asset_health", "telemetry_window", "telemetry_window_all", "alarm_list", "threshold_alarms", "ingest_status",
    "asset_detail", "site_tree", "command_log", "command_log_from_messages", "contract_telemetry", "route_telemetry",
    "quarantine", "topic_parse", "delivery_log", "backlog_trend", "sliding_windows", "window_mse", "pca_scores",
    "stream_features_1m", "stream_ingest",
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "1"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores))

    def run(name: str) -> float:
        started = time.perf_counter()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times = {}
    for name in names:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(REPEATS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    arrivals = spark.read.parquet(f"{folder}/events.parquet").count() * 1.1
    result = {
        "metric": "headline queries, total of medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if "stream_ingest" in times:
        result["stream_ingest_rows_per_sec"] = round(arrivals / times["stream_ingest"])
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
