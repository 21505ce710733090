"""The publishing job: send the lines of a file to the topic.

    spark-submit prequenta/plans/publish.py --input test.csv --servers host:9092
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from prequenta.operators.split import bootstrap_sample
from prequenta.sources.text import read_lines
from prequenta.sources.topic import TOPIC, write_topic


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Publish lines to the topic")
    args.add_argument("--input", required=True)
    args.add_argument("--servers", required=True)
    args.add_argument("--topic", default=TOPIC)
    args.add_argument("--resample", type=float, help="send a draw with replacement, this times the input's size")
    opt = args.parse_args(argv)

    spark = SparkSession.builder.appName("prequenta-publish").getOrCreate()
    lines = read_lines(spark, opt.input)
    if opt.resample is not None:
        lines = bootstrap_sample(lines, opt.resample)
    write_topic(lines, opt.servers, opt.topic)


if __name__ == "__main__":
    main()
