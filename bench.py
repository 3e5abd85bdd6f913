"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and is then timed; every result row is computed and dropped by the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from barlake.plans import registry, registry_io  # noqa: F401
from barlake.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "ticks_to_m1",
    "ticks_to_h1",
    "bars_m1_to_m5",
    "ladder_from_ticks",
    "ladder_from_bars",
    "ladder_from_line_ticks",
    "ladder_raw_protected",
    "coverage_catalog",
    "bar_stats",
    "lake_summary",
    "gaps",
    "top_gaps",
    "collapse_offset_bars",
    "snap_bucket",
    "latest_tick_per_key",
    "upsert_bars",
    "upsert_ticks",
    "upsert_counts",
    "timestamp_coercion",
    "bar_number_coercion",
    "range_bars",
    "next_page_of_bars",
    "shift_bars_berlin",
    "files_plain_ticks",
    "store_ticks_after_ticks",
    "refresh_job",
    "snapshot_round_trip",
    "store_shifted",
]


def main() -> None:
    spark = build_session(
        "barlake-bench",
        f"local[{CPUS}]",
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):
            started = time.perf_counter()
            registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    scale = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
