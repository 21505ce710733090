from dataclasses import replace

import numpy as np
import pytest

import prequenta as q
from prequenta.operators import fit as fit_module
from prequenta.operators.fit import SgdSettings
from replica import as_lines, descend, sample


@pytest.fixture(scope="module")
def data(spark):
    x, y = sample(np.random.default_rng(7), 400)
    df = spark.createDataFrame([(line,) for line in as_lines(x, y)], "value string")
    return q.parse_labelled(df, n_features=3), x, y


@pytest.mark.parametrize("settings", [q.OFFLINE, q.ONLINE, SgdSettings(iterations=25, step=0.5, reg_param=0.1, tol=0.0)])
def test_descent_rule(data, settings):
    points, x, y = data
    start = [q.cold_model(n_features=3), q.Model.of("warm", [0.25, 1.0, -0.5])]
    fitted = q.sgd_fit(points, start, settings)
    assert set(fitted) == {"cold", "warm"}
    for model in start:
        want = descend(x, y, model.weights, settings.iterations, settings.step, settings.reg_param, settings.tol)
        assert np.allclose(fitted[model.name].weights, want, atol=1e-9)
        assert fitted[model.name].intercept == 0.0


@pytest.mark.parametrize("settings", [q.OFFLINE, q.ONLINE])
def test_intercept_is_learned_where_it_starts(data, settings):
    """As the weight of a constant feature, beside a model that has none."""
    points, x, y = data
    start = [q.Model.of("m", [0.1, 0, 0], 0.7), q.cold_model(n_features=3)]
    fitted = q.sgd_fit(points, start, settings)
    rule = settings.iterations, settings.step, settings.reg_param, settings.tol
    want = descend(np.c_[x, np.ones(len(x))], y, [0.1, 0, 0, 0.7], *rule)
    assert np.allclose([*fitted["m"].weights, fitted["m"].intercept], want, atol=1e-9)
    assert np.allclose(fitted["cold"].weights, descend(x, y, [0] * 3, *rule), atol=1e-9) and fitted["cold"].intercept == 0.0
    assert list(fitted) == ["m", "cold"]


def test_intercept_of_all_models_or_of_none(data):
    points, x, y = data
    always = replace(q.ONLINE, intercept=True)
    fitted = q.sgd_fit(points, [q.cold_model(n_features=3)], always)["cold"]
    want = descend(np.c_[x, np.ones(len(x))], y, [0] * 4, 50, 0.1, 0.0, 0.001)
    assert np.allclose([*fitted.weights, fitted.intercept], want, atol=1e-9)
    with pytest.raises(ValueError, match="intercept 0.7"):
        q.sgd_fit(points, [q.Model.of("m", [0, 0, 0], 0.7)], replace(q.ONLINE, intercept=False))


@pytest.mark.parametrize("reg_param, elastic_net", [(0.0, 1.0), (0.05, 1.0), (0.3, 0.0), (0.1, 0.5), (10.0, 1.0)])
def test_optimality_is_zero_at_the_optimum_only(data, reg_param, elastic_net):
    points, x, y = data
    best = q.lbfgs_fit(points, reg_param=reg_param, elastic_net=elastic_net, tol=1e-12, max_iter=500)
    rows = sorted(q.optimality(points, best, reg_param, elastic_net).collect())
    assert max(r["residual"] for r in rows) < 1e-5
    error, spread = 1 / (1 + np.exp(-(x @ np.array(best.weights)))) - y, x.std(axis=0, ddof=1)
    for k, r in enumerate(rows):
        slope = error @ x[:, k] / len(y) + reg_param * (1 - elastic_net) * spread[k] ** 2 * best.weights[k]
        assert r["k"] == k + 1 and np.isclose(r["gradient"], slope) and np.isclose(r["bound"], reg_param * elastic_net * spread[k])
    if reg_param == 10.0:
        assert set(best.weights) == {0.0}
    away = q.Model.of("away", [w + 0.3 for w in best.weights])
    assert max(r["residual"] for r in q.optimality(points, away, reg_param, elastic_net).collect()) > 1e-3


def test_uneven_partitions_do_not_change_the_fit(data):
    points, x, y = data
    spread = points.repartition(13)
    want = descend(x, y, [0] * 3, 100, 1.0, 0.01, 0.001)
    assert np.allclose(q.sgd_fit(spread, [q.cold_model(n_features=3)])["cold"].weights, want, atol=1e-9)


def test_intermediate_points_are_removed(spark, data):
    q.sgd_fit(data[0], [q.cold_model(n_features=3)], SgdSettings(1, 1.0, 0.0))
    import glob

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert glob.glob(f"{shared}/prequenta/points-*") == []


def test_empty_points_are_an_error(data):
    with pytest.raises(Exception):
        q.sgd_fit(data[0].where("false"), [q.cold_model(n_features=3)])


def test_quasi_newton_reaches_the_optimum(data):
    points, x, y = data
    weights = np.array(q.lbfgs_fit(points).weights)

    def gradient(w):
        return (1 / (1 + np.exp(-(x @ w))) - y) @ x / len(y)

    def loss(w):
        margins = x @ w
        return np.mean(np.log1p(np.exp(-margins)) + (1 - y) * margins)

    assert np.abs(gradient(weights)).max() < 1e-4
    assert loss(weights) <= loss(np.array(q.sgd_fit(points, [q.cold_model(n_features=3)])["cold"].weights)) + 1e-9
    assert np.mean((x @ weights > 0) == y) > max(y.mean(), 1 - y.mean())


def test_l1_penalty_removes_the_idle_feature(data):
    weights = q.lbfgs_fit(data[0], reg_param=0.05).weights
    assert weights[2] == 0.0 and weights[1] > 0.1


def test_saved_models(spark, tmp_path):
    path = f"{tmp_path}/models"
    first = [q.Model.of("pretrained", [0.1, 1 / 3], 0.25), q.cold_model(n_features=2)]
    assert q.save_models(spark, first, path) == 0
    assert q.load_models(spark, path) == {m.name: m for m in first}
    newer = q.Model.of("pretrained", [5, 6])
    assert q.save_models(spark, [newer], path) == 1
    loaded = q.load_models(spark, path)
    assert loaded["pretrained"] == newer.at_version(1) and loaded["cold"] == first[1]
    assert q.load_models(spark, path, before=1)["pretrained"] == first[0]
    assert q.save_models(spark, [newer.at_version(9)], path, version=1) == 1
    assert q.load_models(spark, path)["pretrained"].version == 1


def test_points_stay_held_until_the_last_model_is_done(spark, data, monkeypatch):
    """The warm model stops after a few steps; the cold one still reads the held points."""
    held, over = [], []
    sampled = fit_module.Model

    def done(name, weights, *rest, **more):
        over.append(name)
        held.append(spark.sparkContext._jsc.sc().getPersistentRDDs().size())
        return sampled(name, weights, *rest, **more)

    monkeypatch.setattr(fit_module, "Model", done)
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    quick = q.Model.of("warm", [0.25, 1.0, -0.5])
    q.sgd_fit(data[0], [quick, q.cold_model(n_features=3)], SgdSettings(60, 1.0, 0.0, tol=0.2))
    assert set(over) == {"warm", "cold"} and held == [before + 1] * 2
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_repeated_names_are_an_error(data):
    with pytest.raises(ValueError, match="repeat"):
        q.sgd_fit(data[0], [q.cold_model(n_features=3)] * 2)


@pytest.mark.parametrize("row", [(None, [1.0, 2.0, 3.0]), (1, [1.0, None, 3.0]), (1, None)])
def test_incomplete_points_are_an_error(spark, row):
    points = spark.createDataFrame([row, (0, [1.0, 0.0, 1.0])], "label int, features array<double>")
    with pytest.raises(Exception):
        q.sgd_fit(points, [q.cold_model(n_features=3)])


def test_points_are_held_as_bytes_without_a_shuffle(spark, data):
    """Small whole numbers take a byte each; other numbers keep all their digits."""
    points, x, y = data
    with fit_module.held_points(points.repartition(3)) as held:
        rows = held.collect()
        assert sum(r["n"] for r in rows) == len(y) and sum(len(r["features"]) for r in rows) == x.size
        want = descend(x, y, [0] * 3, 100, 1.0, 0.01, 0.001)
        assert np.allclose(q.sgd_fit(held, [q.cold_model(n_features=3)])["cold"].weights, want, atol=1e-9)
        best = q.lbfgs_fit(held, tol=1e-12)
        assert max(r["residual"] for r in q.optimality(held, best).collect()) < 1e-6
    for value in (0.5, 0.1, 128.0, float("inf"), -129.0):
        assert fit_module._narrow(np.array([[value, 1.0]])).tolist() == [[value, 1.0]]


@pytest.mark.parametrize("reg_type, fraction", [("l1", 1.0), (None, 1.0), ("l2", 0.5)])
def test_penalties_and_mini_batches(data, reg_type, fraction):
    points, x, y = data
    rule = SgdSettings(5, 1.0, 0.05, fraction, reg_type, 0.0)
    w = np.zeros(3)
    for i in range(1, 6):
        w = w - 1 / i**0.5 * ((1 / (1 + np.exp(-(x @ w))) - y) @ x / len(y) + (0.05 * w if reg_type == "l2" else 0))
        w = np.sign(w) * np.maximum(np.abs(w) - 0.05 / i**0.5, 0) if reg_type == "l1" else w
    fitted = q.sgd_fit(points, [q.cold_model(n_features=3)], rule)["cold"].weights
    assert np.allclose(fitted, w, atol=1e-9 if fraction == 1.0 else 0.3)
    assert fraction == 1.0 or not np.allclose(fitted, w, atol=1e-9)


@pytest.mark.parametrize("row", [(2, [1.0, 2.0, 3.0]), (1, [1.0, 2.0])])
def test_points_of_another_shape_are_an_error(spark, row):
    points = spark.createDataFrame([row, (0, [1.0, 0.0, 1.0])], "label int, features array<double>").coalesce(1)
    with pytest.raises(Exception):
        q.sgd_fit(points, [q.cold_model(n_features=3)])


def test_held_blocks_are_not_decoded_again(spark, data):
    """Blocks are held as Python pickles bytes; as the JVM does, they are a text that every step turns into bytes."""
    with fit_module.held_points(data[0]) as held:
        assert held.is_cached and {type(r[name]) for r in held.collect() for name in ("labels", "features")} == {bytes}
