"""The report job: accuracy of the latest run, in total and over its last batches.

    spark-submit prequenta/plans/serving.py --out runs/
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from prequenta.operators.evaluate import accuracy_json
from prequenta.operators.report import POINTS
from prequenta.streaming.prequential import latest_run, newest_points, read_totals


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Report the accuracy of the latest run")
    args.add_argument("--out", required=True)
    args.add_argument("--points", type=int, default=POINTS)
    opt = args.parse_args(argv)

    spark = SparkSession.builder.appName("prequenta-report").getOrCreate()
    run = latest_run(spark, opt.out)
    if run is None:
        raise SystemExit(f"there is no run below {opt.out}")
    print(accuracy_json(read_totals(spark, run)).first()["json"])
    points = newest_points(spark, run, opt.points, seed_zeros=True).orderBy("model", "seq")
    points.show(points.count(), truncate=False)


if __name__ == "__main__":
    main()
