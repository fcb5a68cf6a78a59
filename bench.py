"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of local cores,
``BENCH_RUNS`` how often each query is timed (the best run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from limner.catalog import REGISTRY

HEADLINE = [
    "unique_image_index",
    "duplicate_records",
    "image_header_dims",
    "geometry_features",
    "class_balance",
    "numeric_profile",
    "correlation_matrix",
    "style_genre_crosstab",
    "metric_histograms",
    "box_stats_by_orientation",
    "quality_by_style",
    "outliers_by_megapixels",
    "stratified_split",
    "split_data_card",
    "seeded_sample",
    "budgeted_prefix",
    "prompt_scores",
    "predicted_class_and_rank",
    "accuracy_summary",
    "per_class_accuracy",
    "confusion_matrix",
    "precision_recall_f1",
    "average_precision",
    "training_history",
    "contrastive_loss",
    "ridge_linear_map",
    "leaderboard",
    "best_run_per_model",
    "best_run_per_family",
    "detect_and_grade",
    "graded_items",
    "streamed_class_counts",
    "streamed_unique_hashes",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(cpus)
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
