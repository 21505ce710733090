"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

Every query runs once to warm up (``cold`` has that time) and is then timed three times; the
median counts. Queries that take more than ``ONCE_FROM`` seconds are timed once after warm-up.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from prequenta.plans import catalog, fixtures

HEADLINE = (
    "scan_labelled_csv",
    "labelled_points",
    "hash_split",
    "score_two_models",
    "predict_fixed",
    "confusion_counts",
    "accuracy",
    "sgd_first_step",
    "sgd_fit_10",
    "offline_training",
    "lbfgs_fit",
    "model_roundtrip",
    "stream_confusion",
    "stream_compacted",
    "stream_prequential",
    "running_accuracy",
    "last_n_points",
)

TIMES = 3
ONCE_FROM = 8.0  # seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("prequenta-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action) -> float:
        start = time.perf_counter()
        action()
        return round(time.perf_counter() - start, 3)

    # Deriving the lines is input preparation: timed, but not part of any query.
    prepare = timed(lambda: [build(spark, sf_dir) for build in (fixtures.item_lines, fixtures.stream_lines, fixtures.vector_lines)])
    cold, seconds = {}, {}
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        run = lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        cold[name] = timed(run)
        seconds[name] = median(timed(run) for _ in range(TIMES if cold[name] < ONCE_FROM else 1))
    rows, events = fixtures.item_lines(spark, sf_dir).count(), fixtures.stream_lines(spark, sf_dir).count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold": cold,
                "prepare": prepare,
                "rows_per_sec": {
                    name: round(n / seconds[name])
                    for n, names in (
                        (rows, ("predict_fixed", "confusion_counts", "sgd_fit_10")),
                        (events, ("stream_confusion", "stream_compacted", "stream_prequential")),
                    )
                    for name in names
                },
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
