import random

import pytest

import prequenta as q


@pytest.fixture(scope="module")
def history():
    rng = random.Random(5)
    return [
        (b, m, p, a, rng.randint(1, 50))
        for m in ("pretrained", "cold")
        for b in range(0, 90, 1 if m == "cold" else 3)
        for p in (0, 1)
        for a in (0, 1)
        if rng.random() < 0.8
    ]


def brute_force(history):
    out = {}
    for b, m in {(b, m) for b, m, *_ in history}:
        past = [(p, a, n) for bb, mm, p, a, n in history if mm == m and bb <= b]
        out[b, m] = sum(n for p, a, n in past if p == a) / sum(n for *_, n in past)
    return out


@pytest.fixture(scope="module")
def counts(spark, history):
    return spark.createDataFrame(history, "batch_id bigint, model string, predicted int, actual int, n bigint")


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_running_accuracy_across_blocks(counts, history, block):
    got = {(r["batch_id"], r["model"]): r["accuracy"] for r in q.running_accuracy(counts, block).collect()}
    assert got == pytest.approx(brute_force(history))


def test_last_points(counts):
    series = q.running_accuracy(counts)
    points = q.last_points(series, 20).collect()
    for model, newest in (("cold", list(range(70, 90))), ("pretrained", list(range(30, 90, 3)))):
        mine = sorted((r["seq"], r["batch_id"]) for r in points if r["model"] == model)
        assert [s for s, _ in mine] == list(range(-19, 1))
        assert mine[-1][1] in (newest[-1], newest[-1] - 3)
        assert [b for _, b in mine] == sorted(b for _, b in mine)


def test_short_series_is_filled_with_zeros(spark):
    series = spark.createDataFrame([(4, "cold", 0.5), (6, "cold", 0.75)], "batch_id bigint, model string, accuracy double")
    points = sorted(tuple(r) for r in q.last_points(series, 5, seed_zeros=True).collect())
    assert points == [(-4, "cold", None, 0.0), (-3, "cold", None, 0.0), (-2, "cold", None, 0.0),
                      (-1, "cold", 4, 0.5), (0, "cold", 6, 0.75)]
    assert q.last_points(series, 2, seed_zeros=True).count() == 2


def test_top_points_are_cut_before_the_shuffle(counts):
    plan = q.last_points(counts.selectExpr("batch_id", "model", "1D AS accuracy"))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
