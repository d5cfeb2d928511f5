"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from trailmark.plans import QUERIES
from trailmark.session import session

#: Read models, search, review signals, schedules and writes: what a user waits for.
HEADLINE = (
    "session_list_recent", "dominant_repo", "token_totals", "project_summary", "sync_status", "visibility_filter",
    "facets_distinct", "search_match", "search_prefix_or", "search_best_source", "error_loops", "session_signals",
    "gaps_over_5min", "merge_runs", "coalesce_upsert", "replace_set", "learning_rollup", "nightly_pick", "due_projects",
    "fix_decisions", "quote_check", "session_window",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):  # the second run is warm
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
