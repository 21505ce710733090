"""The online job: score and learn from a stream with a warm and a cold model side by side.

    spark-submit prequenta/plans/online.py --models models/ --out runs/ --servers host:9092
    spark-submit prequenta/plans/online.py --models models/ --out runs/ --lines incoming/
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from prequenta.model import N_FEATURES, PRETRAINED, Model, cold_model
from prequenta.operators.fit import ONLINE, UPDATERS, SgdSettings
from prequenta.sources.models import load_any
from prequenta.sources.text import stream_lines
from prequenta.sources.topic import TOPIC, read_topic
from prequenta.streaming.prequential import open_run, run_prequential


def warm_and_cold(spark: SparkSession, models: str, n_features: int = N_FEATURES) -> list[Model]:
    """The saved model of the warm name (or the only one saved) under that name, and a model that has seen nothing.

    ``models`` is a model table or a folder that Spark's own ``LogisticRegressionModel.save`` wrote.
    """
    saved = load_any(spark, models)
    if PRETRAINED not in saved and len(saved) != 1:
        raise ValueError(f"no saved model is named {PRETRAINED!r}, and there is not just one: {sorted(saved)}")
    warm = saved.get(PRETRAINED) or next(iter(saved.values()))
    if warm.n_features != n_features:
        raise ValueError(f"the saved model has {warm.n_features} features, the stream {n_features}")
    return [replace(warm, name=PRETRAINED), cold_model(n_features=n_features)]


def online_settings(opt: argparse.Namespace) -> SgdSettings:
    return SgdSettings(
        iterations=opt.iterations,
        step=opt.step,
        reg_param=opt.reg_param,
        mini_batch_fraction=opt.mini_batch_fraction,
        reg_type=None if opt.reg_type == "none" else opt.reg_type,
        tol=opt.tol,
        intercept={"auto": None, "learn": True, "refuse": False}[opt.intercept],
    )


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Score and learn from a stream")
    args.add_argument("--models", required=True, help="model table, or a folder of Spark's own LogisticRegressionModel")
    args.add_argument("--out", required=True)
    source = args.add_mutually_exclusive_group(required=True)
    source.add_argument("--servers", help="Kafka bootstrap servers")
    source.add_argument("--lines", help="folder that text files arrive in")
    args.add_argument("--topic", default=TOPIC)
    args.add_argument("--max-per-batch", type=int, help="messages or files per micro-batch")
    args.add_argument("--features", type=int, default=N_FEATURES)
    args.add_argument("--interval", default="1 second")
    args.add_argument("--available-now", action="store_true", help="stop after the present input")
    args.add_argument("--reset", action="store_true", help="start a new run instead of resuming")
    args.add_argument("--permissive", action="store_true", help="keep lines that do not parse as rejects and go on")
    args.add_argument("--progress", action="store_true", help="write a table of rows and duration per batch")
    args.add_argument("--no-train", action="store_true", help="only score")
    args.add_argument("--iterations", type=int, default=ONLINE.iterations, help="of the update per batch")
    args.add_argument("--step", type=float, default=ONLINE.step)
    args.add_argument("--reg-param", type=float, default=ONLINE.reg_param)
    args.add_argument("--reg-type", choices=[r or "none" for r in UPDATERS], default=ONLINE.reg_type)
    args.add_argument("--mini-batch-fraction", type=float, default=ONLINE.mini_batch_fraction)
    args.add_argument("--tol", type=float, default=ONLINE.tol)
    args.add_argument("--intercept", choices=("auto", "learn", "refuse"), default="auto")
    opt = args.parse_args(argv)

    spark = SparkSession.builder.appName("prequenta-online").getOrCreate()
    if opt.servers:
        lines = read_topic(spark, opt.servers, opt.topic, max_per_batch=opt.max_per_batch)
    else:
        lines = stream_lines(spark, opt.lines, opt.max_per_batch)
    run_prequential(
        lines,
        warm_and_cold(spark, opt.models, opt.features),
        open_run(spark, opt.out, opt.reset),
        online_settings(opt),
        train=not opt.no_train,
        n_features=opt.features,
        interval=opt.interval,
        available_now=opt.available_now,
        mode="permissive" if opt.permissive else "strict",
        progress=opt.progress,
    ).awaitTermination()


if __name__ == "__main__":
    main()
