"""Wall-clock seconds of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; ``BENCH_QUERIES=all`` times every query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = (
    "tables_to_triples",
    "entity_dictionary",
    "encode_triples",
    "literal_matrix",
    "match_names",
    "fit_quantiles",
    "interp_embedding",
    "corrupt_triples",
    "score_relation_scaled",
    "random_walks",
    "frequent_entities",
    "numeric_child_features",
    "categorical_child_features",
    "two_hop_features",
    "three_hop_features",
    "deep_features_depth2",
    "recipe_donations",
    "recipe_courses",
    "recipe_places",
    "stratified_folds",
    "average_precision",
    "roc_auc",
    "cv_linear",
    "attribute_target_Q1",
    "knn_regression",
    "best_epoch",
    "report_rows",
    "fit_vectors_relation_scaled",
    "flagship",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from factloom.plans import QUERIES

    shared = tempfile.TemporaryDirectory(prefix="bench-")  # local master; removed with all stored tables at the end
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", shared.name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    QUERIES["count_by_key"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "total wall-clock of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
