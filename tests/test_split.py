import math
from collections import Counter

import pytest

import prequenta as q
from prequenta.functions.hashing import MODULUS, MULTIPLIERS, key_bucket, scattered_bucket, share_limit
from pyspark.sql import functions as F


def test_random_split_is_disjoint_and_complete(spark):
    df = spark.range(20_000)
    train, rest = q.random_split(df)
    a, b = {r[0] for r in train.collect()}, {r[0] for r in rest.collect()}
    assert not a & b and len(a | b) == 20_000
    assert 300 < len(a) < 500


@pytest.mark.parametrize("fraction", [0.02, 0.5, 0.8])
def test_hash_split_ignores_partitioning(spark, fraction):
    df = spark.range(20_000).withColumn("k", F.col("id") % 977 - 400)
    chosen = {tuple(r) for r in q.hash_split(df, ["id", "k"], fraction)[0].collect()}
    again = {tuple(r) for r in q.hash_split(df.repartition(7), ["id", "k"], fraction)[0].collect()}
    rest = {tuple(r) for r in q.hash_split(df, ["id", "k"], fraction)[1].collect()}
    assert chosen == again and not chosen & rest and len(chosen) + len(rest) == 20_000
    assert abs(len(chosen) / 20_000 - fraction) < 0.02


def test_hash_split_keeps_equal_keys_together_and_null_keys(spark):
    df = spark.createDataFrame([(k,) for k in [1, 1, 2, 2, 3, None]], "k bigint")
    train, rest = q.hash_split(df, ["k"], 0.5)
    a, b = Counter(r[0] for r in train.collect()), Counter(r[0] for r in rest.collect())
    assert not set(a) & set(b) and sum(a.values()) + sum(b.values()) == 6


def test_bootstrap_repeats_rows(spark):
    drawn = Counter(r[0] for r in q.bootstrap_sample(spark.range(5_000), 1.0, seed=3).collect())
    assert max(drawn.values()) > 1 and 4_500 < sum(drawn.values()) < 5_500
    assert set(drawn) <= set(range(5_000))


def test_bucket_arithmetic(spark):
    keys = [(0, 0), (1, -1), (-(2**63), 2**63 - 1), (MODULUS, -MODULUS), (123456789012, 7)]
    df = spark.createDataFrame(keys, "a bigint, b bigint")
    got = [r[0] for r in df.select(key_bucket([F.col("a"), F.col("b")], seed=5)).collect()]
    want = []
    for row in keys:
        states = []
        for multiplier in MULTIPLIERS:
            state = 5
            for key in row:
                state = (state + key % MODULUS) % MODULUS * multiplier % MODULUS
            states.append(state)
        want.append(states[0] * MODULUS + states[1])
    assert got == want


def test_a_share_has_no_smallest_value():
    assert share_limit(0.0) == 0 and share_limit(1.0) == MODULUS**2
    assert 0 < share_limit(1e-15) < share_limit(2e-15) and share_limit(0.5) == MODULUS**2 // 2


@pytest.mark.parametrize("fraction", [1e-3, 1e-4])
def test_small_shares_are_kept(spark, fraction):
    chosen = q.hash_split(spark.range(200_000), ["id"], fraction)[0].count()
    assert 0.3 < chosen / (200_000 * fraction) < 2


def test_keyed_draws_ignore_partitioning_and_follow_poisson(spark):
    df = spark.range(20_000)
    drawn = Counter(tuple(r) for r in q.bootstrap_sample(df, 1.0, keys=["id"]).collect())
    assert drawn == Counter(tuple(r) for r in q.bootstrap_sample(df.repartition(7), 1.0, keys=["id"]).collect())
    assert set(drawn.values()) == {1}
    times = Counter(Counter(i for i, _ in drawn).values())
    times[0] = 20_000 - sum(times.values())
    for k in range(5):
        share = math.exp(-1) / math.factorial(k)
        assert abs(times[k] - 20_000 * share) < 5 * math.sqrt(20_000 * share)
    other = Counter(i for i, _ in map(tuple, q.bootstrap_sample(df, 1.0, seed=5, keys=["id"]).collect()))
    assert other != Counter(i for i, _ in drawn)


def test_keyed_draws_of_neighbours_are_independent(spark):
    """Totals of blocks of neighbouring keys vary as sums of independent draws do."""
    sums = Counter(r[0] // 50 for r in q.bootstrap_sample(spark.range(50_000), 1.0, keys=["id"]).collect())
    totals = [sums[b] for b in range(1000)]
    spread = sum((t - 50) ** 2 for t in totals) / 1000
    assert 40 < spread < 60


@pytest.mark.parametrize("mean", [0.01, 0.5, 30.0])
def test_keyed_draws_of_any_mean(spark, mean):
    n = q.bootstrap_sample(spark.range(5_000), mean, keys=["id"]).count()
    assert abs(n - 5_000 * mean) < 6 * math.sqrt(5_000 * mean)


def test_keyed_draws_of_equal_and_missing_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k bigint, v string")
    drawn = Counter(r["v"] for r in q.bootstrap_sample(df, 3.0, keys=["k"]).collect())
    assert drawn["a"] == drawn["b"] and drawn["d"] == 0
    with pytest.raises(ValueError, match="draws per row"):
        q.bootstrap_sample(df, 0.0, keys=["k"])


def test_scattered_buckets_are_a_permutation(spark):
    """Rounds that can be undone: different residues never meet."""
    df = spark.range(30_000).withColumn("k", F.col("id") * 71)
    placed = scattered_bucket(df, [F.col("k")], "b", 9)
    assert placed.select("b").distinct().count() == 30_000
    assert placed.where(f"b < 0 OR b >= {MODULUS**2}").count() == 0
