"""Headline queries timed on a warm session: one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from civitas.plans.registry import QUERIES
from civitas.session import session

HEADLINE = ["heatmap_grid", "nearest_demographic", "master_events", "master_venues", "high_value_predictions", "collection_health", "data_summary", "top20_predictions", "feature_matrix", "event_adjustment", "upsert_merge", "status_rollup", "validate_scores", "html_strip", "json_clean", "hourly_counts", "master_venue_view", "high_value_view", "collection_health_view", "upsert_venues", "places_json", "map_layers"]


def main() -> None:
    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):  # the first warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(median(took[1:]), 4)
    print(json.dumps({"metric": "total_seconds_of_medians", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
