"""The offline job: scan a headed file, fit on a share of it, save the model.

    spark-submit prequenta/plans/offline.py --input data.csv --models models/
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.model import N_FEATURES, PRETRAINED, Model, cold_model
from prequenta.operators.evaluate import confusion_counts
from prequenta.operators.fit import OFFLINE, SgdSettings, lbfgs_fit, sgd_fit
from prequenta.operators.score import score
from prequenta.operators.split import SEED, TRAIN_FRACTION, hash_split, random_split
from prequenta.sources.models import save_models, save_platform_model
from prequenta.sources.text import read_labelled_csv


def train_offline(
    points: DataFrame,
    keys: list[str | Column],
    fraction: float = TRAIN_FRACTION,
    settings: SgdSettings = OFFLINE,
    name: str = PRETRAINED,
    n_features: int = N_FEATURES,
) -> tuple[Model, DataFrame]:
    """The model fitted on a repeatable share of ``points``, and the rows held out."""
    train, rest = hash_split(points, keys, fraction)
    return sgd_fit(train, [cold_model(name, n_features)], settings)[name], rest


def holdout_confusion(rest: DataFrame, model: Model) -> DataFrame:
    """Confusion counts on held-out rows; no prediction leaves the executors."""
    return confusion_counts(score(rest, [model]), [model.name])


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Fit a model offline and save it")
    args.add_argument("--input", required=True, help="headed delimited file or folder")
    args.add_argument("--models", required=True, help="model table to write a new version to")
    args.add_argument("--features", type=int, default=N_FEATURES)
    args.add_argument("--fraction", type=float, default=TRAIN_FRACTION)
    args.add_argument("--seed", type=int, default=SEED)
    args.add_argument("--split", choices=("random", "hash"), default="hash")
    args.add_argument("--trainer", choices=("sgd", "lbfgs"), default="sgd")
    args.add_argument("--platform", action="store_true", help="write --models as Spark's own LogisticRegressionModel does, into a new folder")
    args.add_argument("--holdout", action="store_true", help="also print counts on the rest")
    opt = args.parse_args(argv)

    spark = SparkSession.builder.appName("prequenta-offline").getOrCreate()
    points = read_labelled_csv(spark, opt.input, n_features=opt.features)
    if opt.split == "random":
        train, rest = random_split(points, opt.fraction, opt.seed)
    else:
        train, rest = hash_split(points, [F.xxhash64("label", "features")], opt.fraction, opt.seed)
    if opt.trainer == "sgd":
        model = sgd_fit(train, [cold_model(PRETRAINED, opt.features)])[PRETRAINED]
    else:
        model = lbfgs_fit(train, PRETRAINED)
    if opt.platform:
        save_platform_model(spark, model, opt.models)
    else:
        save_models(spark, [model], opt.models)
    if opt.holdout:
        holdout_confusion(rest, model).show()


if __name__ == "__main__":
    main()
