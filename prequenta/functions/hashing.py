"""A portable bucket number for key columns."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Multiplicative steps modulo a Mersenne prime: products stay below 2^62, so plain
# bigint arithmetic in any engine gives the same bucket. Two multipliers give 62 bits.
MODULUS = 2147483647
MULTIPLIERS = (1103515245, 48271)
BUCKETS = MODULUS * MODULUS


def key_states(keys: list[Column], seed: int = 0) -> tuple[Column, Column]:
    """The two residues a bucket is made of."""
    modulus = F.lit(MODULUS).cast("bigint")

    def folded(multiplier: int) -> Column:
        def step(state: Column, key: Column) -> Column:
            return ((state + F.pmod(key.cast("bigint"), modulus)) % modulus) * F.lit(multiplier).cast("bigint") % modulus

        return reduce(step, keys, F.lit(seed % MODULUS).cast("bigint"))

    high, low = map(folded, MULTIPLIERS)
    return high, low


def key_bucket(keys: list[Column], seed: int = 0) -> Column:
    """A bucket in [0, BUCKETS) that depends on the keys and the seed alone.

    Buckets of keys in a row are spread evenly, which is what a share wants. They are not
    independent of each other; see ``scattered_bucket``.
    """
    high, low = key_states(keys, seed)
    return high * F.lit(MODULUS).cast("bigint") + low


def scattered_bucket(df: DataFrame, keys: list[Column], name: str, seed: int = 0) -> DataFrame:
    """``df`` with a bucket in ``name`` that looks random from one key to the next.

    The residues go through four rounds that add the square of one to the other, each of which can
    be undone, so every bucket stays as likely as any other. Squares stay below 2^62.
    """
    modulus = F.lit(MODULUS).cast("bigint")
    high, low = key_states(keys, seed)
    df = df.withColumns({f"{name}_h": high, f"{name}_l": low})
    for _ in range(2):
        for changed, by in (("h", "l"), ("l", "h")):
            square = F.col(f"{name}_{by}") * F.col(f"{name}_{by}") % modulus
            df = df.withColumn(f"{name}_{changed}", (F.col(f"{name}_{changed}") + square) % modulus)
    return df.withColumn(name, F.col(f"{name}_h") * modulus + F.col(f"{name}_l")).drop(f"{name}_h", f"{name}_l")


def share_limit(fraction: float) -> int:
    """The bucket below which a share of all buckets lies, computed without rounding of the share."""
    return min(BUCKETS, round(Fraction(fraction) * BUCKETS))
