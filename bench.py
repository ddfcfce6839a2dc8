"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens.queries import all_queries  # noqa: E402
from fleetlens.session import build_session  # noqa: E402

HEADLINE = (
    "onset_codes",
    "onsets",
    "labelled_points",
    "correlated_failures",
    "coincidence",
    "window_stats",
    "job_features",
    "precursors",
    "latch_lengths",
    "burst_centers",
    "incident_cards",
    "ranking_metrics",
    "alert_budgets",
    "single_feature_auc",
    "monitor_report",
    "miss_events",
    "vector_search",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = all_queries()
    # JVM and Python workers warm up on the smallest query; it is not timed
    runs["left_censored"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
