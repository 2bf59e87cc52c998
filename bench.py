"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from panelworks.catalogue import all_queries

HEADLINE = (
    "building_join", "weather_join", "feature_table", "scaled_target", "daily_meter_overview", "table_profile",
    "exact_median_price", "time_split", "contiguous_days", "evaluable_rows", "panel_grid", "panel_forward_fill",
    "lag_features", "rolling_statistics", "seasonal_additive", "zero_runs", "regression_metrics", "zero_state_metrics",
    "profile_forecast_scores", "attribute_similarity", "embedding_similarity", "neighbour_features",
    "per_meter_training", "rollout_daily_series", "minimal_removal", "streaming_daily_profile",
    "fused_graph", "panel_rollout", "autoregressive_forecast", "boosted_trees_forecast", "streaming_continuity",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
