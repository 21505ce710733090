"""Fitting logistic regression over points held as compact blocks.

Points are packed once into blocks of a few thousand rows, features in the narrowest type that
holds them exactly (a byte each for small whole numbers), written to the shared folder without a
shuffle and held by the executors. Every step is one job that sums loss or gradient over the
blocks; what comes to the driver is one number per weight.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from prequenta.functions import cells as C
from prequenta.model import Model
from prequenta.session import drop_folder, shared_folder


@dataclass(frozen=True)
class SgdSettings:
    iterations: int
    step: float
    reg_param: float
    mini_batch_fraction: float = 1.0
    reg_type: str | None = "l2"
    tol: float = 0.001
    # Whether the intercept is learned: of all models, of none, or (None) of those that start with one.
    intercept: bool | None = None

    def learns_intercept(self, model: Model) -> bool:
        if self.intercept is False and model.intercept:
            raise ValueError(f"model {model.name} has the intercept {model.intercept}, which these settings do not carry")
        return bool(self.intercept or model.intercept)


# The settings of the offline fit and of the update per micro-batch.
OFFLINE = SgdSettings(iterations=100, step=1.0, reg_param=0.01)
ONLINE = SgdSettings(iterations=50, step=0.1, reg_param=0.0)

UPDATERS = ("l2", "l1", None)
BLOCKS = "n int, kind string, labels binary, features binary"
ROW_GROUP_BYTES = 8 << 20  # small enough that a file of blocks is read by several tasks
MEMORY = 10  # steps the quasi-Newton fit remembers
SEED = 42


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them exactly."""
    if x.size and -128 <= x.min() and x.max() <= 127 and (x == np.rint(x)).all():
        return x.astype(np.int8)
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short if (short == x).all() else x


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, features = batch.columns
        if not len(label):
            continue
        if label.null_count or features.null_count or features.flatten().null_count:
            raise ValueError("a point without label or with a missing feature")
        y, x = label.to_numpy(), features.flatten().to_numpy()
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError(f"a label is neither 0 nor 1: {y[~np.isin(y, (0.0, 1.0))][0]}")
        if (widths := np.unique(features.value_lengths().to_numpy())).size > 1:
            raise ValueError(f"points have different numbers of features: {widths.tolist()}")
        x = _narrow(x)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(y)], pa.int32()), "kind": [x.dtype.str], "labels": [y.astype(np.int8).tobytes()], "features": [x.tobytes()]})


def _unpacked(block: Row) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a block."""
    x = np.frombuffer(block["features"], block["kind"]).reshape(block["n"], -1)
    return x.astype(np.float64), np.frombuffer(block["labels"], np.int8).astype(np.float64)


def _raw(block: Row) -> Row:
    """The block with its bytes as Python's, which a step reads as they are.

    What comes straight from the JVM is pickled as text, so that every step would decode each byte again.
    """
    return Row(**block.asDict() | {name: bytes(block[name]) for name in ("labels", "features")})


@contextmanager
def held_points(points: DataFrame | RDD) -> Iterator[RDD]:
    """The blocks of ``points`` in memory and on disk of the executors, read from a copy in the shared folder.

    What it yields can be given to the fits and to ``optimality`` in place of the points, so that
    several of them share one copy. A lost executor re-reads that copy instead of the input. Small
    files of a share of a large input are read together, so that no step starts a sliver of a task
    per input split.
    """
    if isinstance(points, RDD):
        yield points
        return
    spark = points.sparkSession
    path = shared_folder(spark, "points")
    try:
        plain = points.select(F.col("label").cast("double"), F.col("features").cast("array<double>"))
        written = plain.mapInArrow(_packed, BLOCKS).write.option("compression", "none").option("parquet.block.size", ROW_GROUP_BYTES)
        written.parquet(path)
        blocks = spark.read.schema(BLOCKS).parquet(path).rdd.map(_raw).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield blocks
        finally:
            blocks.unpersist()
    finally:
        drop_folder(spark, path)


def _total(blocks: RDD, summands: Callable[[np.ndarray, np.ndarray, int], np.ndarray], combine: Callable = np.add) -> np.ndarray:
    """The sum over all blocks of what ``summands(features, labels, place)`` gives; no block at all is an error."""

    def part(index: int, rows: Iterator[Row]) -> Iterator[np.ndarray]:
        total = None
        for i, row in enumerate(rows):
            found = summands(*_unpacked(row), index << 32 | i)
            total = found if total is None else combine(total, found)
        if total is not None:
            yield total

    if combine is not np.add:
        return blocks.mapPartitionsWithIndex(part).treeReduce(combine)
    # One row of a few numbers per partition, added up by size, so that the order of files does not show in a replay.
    parts = blocks.mapPartitionsWithIndex(part).collect()
    if not parts:
        raise ValueError("no points to fit")
    return np.sort(np.stack(parts), axis=0).sum(axis=0)


def _errors(margins: np.ndarray, labels: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-margins)) - labels


def _gradients(weights: np.ndarray, fraction: float = 1.0, iteration: int = 0):
    """Rows, and for each column of weights the sum of gradients; the last weight is that of a feature that is always 1."""

    def summands(x: np.ndarray, y: np.ndarray, place: int) -> np.ndarray:
        if x.shape[1] != len(weights) - 1:
            raise ValueError(f"points have {x.shape[1]} features, models {len(weights) - 1}")
        if fraction < 1.0:
            drawn = np.random.default_rng([SEED + iteration, place]).random(len(y)) < fraction
            x, y = x[drawn], y[drawn]
        errors = _errors(x @ weights[:-1] + weights[-1], y[:, None])
        return np.concatenate([[len(y)], np.vstack([x.T @ errors, errors.sum(axis=0)]).ravel()])

    return summands


def _updated(w: np.ndarray, gradient: np.ndarray, settings: SgdSettings, iteration: int) -> np.ndarray:
    step = settings.step / iteration**0.5
    if settings.reg_type == "l2":
        return w * (1.0 - step * settings.reg_param) - step * gradient
    moved = w - step * gradient
    if settings.reg_type == "l1":
        return np.sign(moved) * np.maximum(np.abs(moved) - step * settings.reg_param, 0.0)
    return moved


def sgd_fit(points: DataFrame | RDD, start: Iterable[Model], settings: SgdSettings = OFFLINE) -> dict[str, Model]:
    """Gradient descent from each model's weights over all of ``points``.

    The update rule is that of Spark's ``LogisticRegressionWithSGD``, which holds every point as
    objects of several hundred bytes. Here a step is one job over the held blocks, for all models
    that have not converged; all models fit on one written copy.

    The intercept of a model that starts with one is learned with its weights, as the weight
    of a feature that is always 1; ``settings.intercept`` says so for all models, or refuses
    such a model. Models without learn weights alone, and their intercept stays 0. Empty
    ``points`` are an error, and so are labels other than 0 and 1.
    """
    models = list(start)
    if len({m.name for m in models}) < len(models):
        raise ValueError(f"model names repeat: {[m.name for m in models]}")
    if settings.reg_type not in UPDATERS:
        raise ValueError(f"unknown penalty {settings.reg_type!r}")
    learns = {m.name: settings.learns_intercept(m) for m in models}
    weights = {m.name: np.array([*m.weights, m.intercept]) for m in models}
    with held_points(points) as blocks:
        active = list(weights)
        for iteration in range(1, settings.iterations + 1):
            if not active:
                break
            together = np.stack([weights[name] for name in active], axis=1)
            rows, *sums = _total(blocks, _gradients(together, settings.mini_batch_fraction, iteration))
            if not rows:
                continue
            gradients, left = np.reshape(sums, together.shape) / rows, []
            for i, name in enumerate(active):
                before, gradient = weights[name], gradients[:, i]
                if not learns[name]:
                    gradient[-1] = 0.0
                weights[name] = now = _updated(before, gradient, settings, iteration)
                if iteration == 1 or np.linalg.norm(before - now) >= settings.tol * max(np.linalg.norm(now), 1.0):
                    left.append(name)
            active = left
        return {m.name: Model(m.name, tuple(weights[m.name][:-1].tolist()), float(weights[m.name][-1])) for m in models}


def _spreads(blocks: RDD) -> np.ndarray:
    """The standard deviation of each feature, 0 for a single point; means are merged, not squares summed."""

    def moments(x: np.ndarray, y: np.ndarray, place: int) -> np.ndarray:
        mean = x.mean(axis=0)
        return np.stack([np.full(x.shape[1], float(len(y))), mean, ((x - mean) ** 2).sum(axis=0)])

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, apart = a[0] + b[0], b[1] - a[1]
        return np.stack([n, a[1] + apart * b[0] / n, a[2] + b[2] + apart**2 * a[0] * b[0] / n])

    n, _, squares = _total(blocks, moments, merged)
    return np.sqrt(squares / np.maximum(n - 1, 1))


def _loss(weights: np.ndarray):
    """Rows, the sum of losses, and the sum of gradients."""

    def summands(x: np.ndarray, y: np.ndarray, place: int) -> np.ndarray:
        margins = x @ weights
        losses = np.logaddexp(0.0, margins) - y * margins
        return np.concatenate([[len(y), losses.sum()], x.T @ _errors(margins, y)])

    return summands


def _steepest(u: np.ndarray, gradient: np.ndarray, l1: float) -> np.ndarray:
    """The sub-gradient of least length of the loss with its absolute part."""
    at_zero = np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0.0)
    return np.where(u == 0, at_zero, gradient + l1 * np.sign(u))


def _quasi_newton(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], width: int, l1: float, max_iter: int, tol: float) -> np.ndarray:
    """The minimum of a smooth convex loss plus ``l1`` times the absolute weights: L-BFGS, kept within one orthant a step."""
    u, past = np.zeros(width), deque(maxlen=MEMORY)
    value, gradient = loss(u)
    values = deque([value], maxlen=MEMORY)
    for _ in range(max_iter):
        slope = _steepest(u, gradient, l1)
        if np.linalg.norm(slope) <= max(tol * abs(value), 1e-8):
            break
        direction, factors = -slope, []
        for s, y in reversed(past):
            factors.append(s @ direction / (s @ y))
            direction = direction - factors[-1] * y
        if past:
            s, y = past[-1]
            direction = direction * (s @ y) / (y @ y)
        for s, y in past:
            direction = direction + s * (factors.pop() - y @ direction / (s @ y))
        if l1:
            direction = np.where(direction * slope < 0, direction, 0.0)
        if not direction @ slope < 0:
            past.clear()
            direction = -slope
        side = np.where(u == 0, -np.sign(slope), np.sign(u))
        step = 1.0 if past else min(1.0, 1.0 / np.linalg.norm(slope))
        for _ in range(40):
            new = u + step * direction
            if l1:
                new = np.where(new * side > 0, new, 0.0)
            smooth, new_gradient = loss(new)
            new_value = smooth + l1 * np.abs(new).sum()
            if new_value <= value + 1e-4 * slope @ (new - u):
                break
            step /= 2
        else:
            break  # no decrease that numbers of this size can show
        s, y = new - u, new_gradient - gradient
        if s @ y > 0:
            past.append((s, y))
        u, value, gradient = new, new_value, new_gradient
        if len(values) == MEMORY and values[0] - value <= tol * abs(value):
            break
        values.append(value)
    return u


def lbfgs_fit(
    points: DataFrame | RDD,
    name: str = "lbfgs",
    max_iter: int = 100,
    reg_param: float = 0.0,
    elastic_net: float = 1.0,
    tol: float = 1e-6,
) -> Model:
    """Quasi-Newton fit without intercept; ``elastic_net=1`` makes the penalty L1.

    The penalty is on the weights of standardised features, as in Spark's ``LogisticRegression``;
    a feature that never changes gets the weight 0. Every evaluation is one job over the held blocks.
    """
    absolute, square = reg_param * elastic_net, reg_param * (1 - elastic_net)
    with held_points(points) as blocks:
        spreads = _spreads(blocks)
        scale = np.divide(1.0, spreads, out=np.zeros_like(spreads), where=spreads > 0)

        def loss(u: np.ndarray) -> tuple[float, np.ndarray]:
            rows, losses, *gradient = _total(blocks, _loss(u * scale))
            return losses / rows + square / 2 * u @ u, np.array(gradient) / rows * scale + square * u

        return Model.of(name, _quasi_newton(loss, len(scale), absolute, max_iter, tol) * scale)


def optimality(points: DataFrame | RDD, model: Model, reg_param: float = 0.0, elastic_net: float = 1.0) -> DataFrame:
    """``(k, weight, gradient, bound, residual)``: how far each weight is from satisfying the conditions of an optimum.

    Two passes over all points give the gradient of the mean loss and each feature's spread.
    The penalty of ``lbfgs_fit`` is on the weights of standardised features: its smooth part adds to
    the gradient, and its absolute part allows a sub-gradient of up to ``bound``. At the optimum of
    this convex problem, and nowhere else, all residuals are 0: a weight that is not 0 needs the
    gradient opposite to the bound, and a weight at 0 a gradient within it.
    """
    with held_points(points) as blocks:
        spreads = _spreads(blocks)
        count, *sums = _total(blocks, _gradients(np.array([[*model.weights, model.intercept]]).T))
    absolute, square = reg_param * elastic_net, reg_param * (1 - elastic_net)
    rows = [(k, float(w), float(g / count), float(s)) for k, (w, g, s) in enumerate(zip(model.weights, sums[:-1], spreads, strict=True), 1)]
    listed = SparkSession.active().createDataFrame(rows, "k bigint, weight double, g double, s double")
    smooth = listed.selectExpr("k", "weight", f"g + {C.double_sql(square)} * s * s * weight AS gradient", f"{C.double_sql(absolute)} * s AS bound")
    residual = "IF(weight = 0, greatest(abs(gradient) - bound, 0D), abs(gradient + signum(weight) * bound))"
    return smooth.selectExpr("*", f"{residual} AS residual")
