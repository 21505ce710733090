"""Train/test splits and resampling."""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prequenta.functions.hashing import BUCKETS, key_bucket, scattered_bucket, share_limit

# The share of rows trained on and the seed.
TRAIN_FRACTION = 0.02
SEED = 1800009193


def random_split(
    df: DataFrame, fraction: float = TRAIN_FRACTION, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """A random ``(train, rest)`` split.

    Which rows go where depends on how the input is partitioned; use ``hash_split`` where
    a run has to be repeatable.
    """
    train, rest = df.randomSplit([fraction, 1.0 - fraction], seed)
    return train, rest


def in_train_share(keys: list[Column], fraction: float, seed: int = SEED) -> Column:
    return key_bucket(keys, seed) < F.lit(share_limit(fraction)).cast("bigint")


def hash_split(
    df: DataFrame, keys: list[str | Column], fraction: float = TRAIN_FRACTION, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """A ``(train, rest)`` split decided by integer keys alone, as two plain filters.

    Rows with equal keys stay together, and the same rows are chosen under any
    partitioning, retry or engine. For text keys pass ``xxhash64(column)``.
    """
    columns = [df[k] if isinstance(k, str) else k for k in keys]
    chosen = F.coalesce(in_train_share(columns, fraction, seed), F.lit(False))
    return df.where(chosen), df.where(~chosen)


def poisson_limits(mean: float) -> list[int]:
    """The buckets from which on 1, 2, 3, ... draws are taken: the distribution function of a Poisson number.

    Ends where no bucket is left, so the list has about ``mean`` plus some twenty entries.
    """
    if not 0 < mean <= 500:
        raise ValueError(f"draws per row have to be above 0 and at most 500 in the mean: {mean}")
    limits, k = [], 0
    with localcontext() as precise:
        precise.prec = 60
        share = below = (-Decimal(mean)).exp()
        while (limit := int((below * BUCKETS).to_integral_value())) < BUCKETS:
            limits.append(limit)
            k += 1
            share = share * Decimal(mean) / k
            below += share
    return limits


def bootstrap_sample(
    df: DataFrame, fraction: float = 1.0, seed: int = SEED, keys: list[str | Column] | None = None
) -> DataFrame:
    """Rows drawn with replacement; about ``fraction`` times the input's rows.

    With integer ``keys``, each row is drawn a Poisson number of times, found by inverting the
    distribution function at the key's bucket, and ``draw`` counts them from 1: the same rows
    under any partitioning, retry or engine, with no shuffle. Rows with equal keys are drawn
    equally often; rows whose key is NULL never. Without keys, the draw is Spark's own and
    depends on how the input is partitioned.
    """
    if keys is None:
        return df.sample(withReplacement=True, fraction=fraction, seed=seed)
    columns = [df[k] if isinstance(k, str) else k for k in keys]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    placed = scattered_bucket(df.where(known), columns, "_bucket", seed)
    drawn = [F.when(F.col("_bucket") >= F.lit(limit).cast("bigint"), 1).otherwise(0) for limit in poisson_limits(fraction)]
    counted = placed.withColumn("_draws", reduce(Column.__add__, drawn)).where("_draws > 0")
    return counted.withColumn("draw", F.explode(F.sequence(F.lit(1), "_draws"))).drop("_draws", "_bucket")
