"""Whitened embeddings against a dense solver, and the counts that cut the spectrum."""

import numpy as np
import pytest

from prequenta.llm import whitening
from prequenta.llm.common import table


def dense(vectors, most):
    x = np.floor(np.array(vectors, float) * 64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    spread = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(spread)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    whole = x.astype(int).astype(object)
    return n, ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1), (x - sums / n) @ axes / np.sqrt(values), values / np.trace(spread)


def compare(rows, ids, vectors, most=32):
    n, deviation, whitened, explained = dense(vectors, most)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * most
    found = np.array([[got[i, k]["whitened"] for k in range(1, most + 1)] for i in ids])
    turn = np.sign((found * whitened).sum(axis=0))
    assert np.allclose(found * turn, whitened, atol=1e-8)
    for row, i in enumerate(ids):
        for k in range(1, most + 1):
            r = got[i, k]
            assert (r["n"], r["deviation"]) == (n, int(deviation[row])) and np.isclose(r["explained"], explained[k - 1], rtol=1e-9)
            assert 0 <= r["identity_error"] < 1e-6


def test_query_equals_a_dense_solver(spark, sf_dir):
    rows = sorted((r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect())
    compare(whitening.op13_whitened_embeddings(spark, sf_dir).collect(), *zip(*rows, strict=True))


def test_counts_follow_the_eigenvalues():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        a = rng.standard_normal((int(rng.integers(1, 30)),) * 2)
        a = a + a.T
        if seed % 3 == 0:
            np.fill_diagonal(a, 0)  # needs blocks of two
        for shift in rng.standard_normal(4):
            assert whitening.count_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


def test_iteration_converges_cubically():
    a = np.diag([9.0, 5, 4, 1]) + 0.1
    value, vector = whitening.rayleigh(a, 4.6, 1)
    assert np.linalg.norm(a @ vector - value * vector) < 1e-13


@pytest.mark.parametrize("values", [[4.0, 3, 3, 3, 2, 1, 1, 0, 0], [1.0] * 7, [5.0, 5 - 1e-9, 1, 1e-3], [2.0, 0, 0], [7.0]])
@pytest.mark.parametrize("turned", [False, True])
def test_repeated_and_zero_eigenvalues(spark, values, turned):
    turn = np.linalg.qr(np.random.default_rng(0).standard_normal((len(values),) * 2))[0] if turned else np.eye(len(values))
    matrix = turn @ np.diag(values) @ turn.T
    found, axes = whitening.leading(spark, (matrix + matrix.T) / 2, 6)
    positive = [v for v in values if v][:6]
    assert np.allclose(found, positive, atol=1e-12)
    assert np.allclose(axes.T @ axes, np.eye(len(positive)), atol=1e-7)
    assert np.allclose(matrix @ axes, axes * found, atol=1e-12)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((50, 3)).tolist()
    good += [good[0], [1e5, -1e5, 0.5]]
    ids = [*range(50), 900, 901]
    odd = [(None, None), (70, None), (71, [1.0, None, 2.0]), (72, [float("nan"), 0.0, 0.0]), (73, [float("inf"), 0.0, 0.0])]
    frame = spark.createDataFrame([*zip(ids, good, strict=True), *odd], "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS component")
    compare(whitening.whiten(frame, components=2).collect(), ids, good, 2)
    assert whitening.whiten(frame.where("embedding IS NULL")).count() == 0
    assert whitening.whiten(frame.where("false")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(frame.where("vec_id = 3")).count() == 0  # nothing varies
    repeated = frame.where("vec_id < 20").unionAll(frame.where("vec_id < 20")).selectExpr("nullif(vec_id, 3) AS vec_id", "embedding")
    rows = whitening.whiten(repeated, components=3).collect()
    assert len(rows) == 120 and sum(r["vec_id"] is None for r in rows) == 6


def test_vectors_of_two_lengths_are_named(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    for f in (frame.coalesce(1), frame.repartition(2, "vec_id")):
        with pytest.raises(Exception, match="one length"):
            whitening.whiten(f).collect()
    huge = spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\*\\*40"):
        whitening.whiten(huge).collect()
    wide = spark.createDataFrame([(i, [i * 1e9, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(wide).collect()
