"""Whitening of embeddings on leading eigenvectors that are found by spectrum slicing.

Entries c become integers x = floor(64 * c) + 1000000. Everything up to the covariance is exact:
one pass gives the number of vectors n and the sums S, a second one the products of the entries
centred by the whole number c nearest to S / n, and what rounding of the centre left is taken off
in integers. So the covariance is the correctly rounded one under any partitioning.

The spectrum is cut by counting: the pivots of LDL' of the covariance minus a shift have as many
positive ones as there are eigenvalues above the shift (Sylvester), whatever the matrix. Bisection
with these counts isolates the k-th eigenvalue, Rayleigh quotient iteration from the middle of its
interval converges cubically, and two more counts on either side of the value found certify that
it is the k-th. Components are independent, so each is found in a task of its own. Eigenvalues
that rounding cannot tell apart are solved together, as one invariant subspace with an orthonormal
basis.

Passed to the driver and to all tasks: sums and products of at most ``MAX_WIDTH`` dimensions and
the components, whose size the width bounds and not the rows.

Edge cases: vectors that are NULL or hold a NULL or non-finite entry take no part. Rows with a NULL
or repeated id are rows like others; other columns are ignored. No vectors, or none that differ,
give no rows; eigenvalues that are zero to rounding are no components. Vectors of different
lengths, more than ``MAX_WIDTH`` entries, entries of 2**40 and more, and a deviation beyond 64 bits
stop the query with a message.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.llm.common import table

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
MAX_WIDTH = 1024
MAX_ENTRY = 2.0**40
ROWS_AT_ONCE = 4096
EPS = float(np.finfo(float).eps)
PIVOT = (1 + sqrt(17)) / 8  # of Bunch and Kaufman: bounds the growth of entries
SUMS = "i int, j int, n long, total decimal(38,0)"


def lattice(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows that take part, and their entries as integers, one row each."""
    length = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    odd = np.repeat(np.arange(len(length)), length)[~np.isfinite(values)]
    part = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    part[odd] = False
    widths = np.unique(length[part])
    if len(widths) > 1 or widths.max(initial=0) > MAX_WIDTH:
        raise ValueError(f"vectors need one length of at most {MAX_WIDTH}: {widths[-5:].tolist()}")
    entries = values[np.repeat(part, length)].reshape(int(part.sum()), int(widths.max(initial=0)))
    if np.abs(entries).max(initial=0) >= MAX_ENTRY:
        raise ValueError("an entry is 2**40 or more")
    return np.flatnonzero(part), np.floor(entries * SCALE).astype(np.int64) + OFFSET


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            piece = batch.slice(start, ROWS_AT_ONCE)
            rows, x = lattice(piece.column("v"))
            if len(rows):
                yield piece, rows, x


def _exact_rows(i, j, n: int, totals) -> pa.RecordBatch:
    numbers = pa.array([Decimal(int(t)) for t in totals], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([n] * len(numbers), pa.int64()), numbers], ["i", "j", "n", "total"]
    )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one row for each dimension."""
    n, totals = 0, None
    for _, rows, x in _pieces(batches):
        n += len(rows)
        here = x.sum(axis=0).astype(object)
        if totals is not None and len(here) != len(totals):
            raise ValueError(f"vectors need one length: {len(totals)} and {len(here)}")
        totals = here if totals is None else totals + here
    if n:
        yield _exact_rows(np.arange(len(totals)), np.zeros(len(totals), int), n, totals)


def _products(centre: np.ndarray):
    """Per task one row for each pair of dimensions: the sum of products of centred entries."""
    i, j = np.triu_indices(len(centre))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, np.zeros((len(centre), len(centre)), object)
        for _, rows, x in _pieces(batches):
            y = x - centre
            if float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2.0**53:
                here = (y.T.astype(float) @ y.astype(float)).astype(np.int64).astype(object)
            else:
                here = y.T.astype(object) @ y.astype(object)
            totals = totals + here
            n += len(rows)
        if n:
            yield _exact_rows(i, j, n, totals[i, j])

    return run


def _collected(frame: DataFrame, run) -> list:
    sums = frame.mapInArrow(run, SUMS).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.collect()  # at most MAX_WIDTH * (MAX_WIDTH + 1) / 2 rows


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix are above ``shift``: positive pivots of LDL' of the shifted matrix."""
    a = matrix - shift * np.eye(len(matrix))
    above = k = 0

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while k < len(a):
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        largest = abs(a[r, k]) if r > k else 0.0
        single = abs(a[k, k]) >= PIVOT * largest
        if not single:
            others = np.abs(a[k:, r])
            others[r - k] = 0.0
            rest = others.max()
            if abs(a[k, k]) * rest >= PIVOT * largest**2:
                single = True
            elif abs(a[r, r]) >= PIVOT * rest:
                swap(k, r)
                single = True
        if single:
            pivot = a[k, k]
            above += pivot > 0
            if pivot:
                below = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(below, below / pivot)
            k += 1
        else:  # a block of two with one eigenvalue on either side of zero
            swap(k + 1, r)
            above += 1
            below = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(a[k : k + 2, k : k + 2], below.T)
            k += 2
    return int(above)


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Inverse iteration step; a shift that is an eigenvalue to the last bit is moved by rounding's size."""
    size = float(np.abs(matrix).max())
    for nudge in (0.0, 1.0, 4.0, 16.0):
        try:
            found = np.linalg.solve(matrix - (shift + nudge * EPS * size) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    raise ArithmeticError("a shifted covariance cannot be solved")


def rayleigh(matrix: np.ndarray, shift: float, seed: int) -> tuple[float, np.ndarray]:
    """Eigenvalue and unit eigenvector by Rayleigh quotient iteration after two steps with the given shift."""
    u = np.random.default_rng(seed).standard_normal(len(matrix))
    for _ in range(2):
        u = _solved(matrix, shift, u / np.linalg.norm(u))
    u /= np.linalg.norm(u)
    best = (np.inf, 0.0, u)
    for _ in range(12):
        value = float(u @ matrix @ u)
        left = float(np.linalg.norm(matrix @ u - value * u))
        if left >= best[0]:
            break
        best = (left, value, u)
        u = _solved(matrix, value, u)
        u /= np.linalg.norm(u)
    return best[1], best[2]


def component(matrix: np.ndarray, k: int) -> tuple[float, float, float | None, np.ndarray | None]:
    """(low, high, value, vector) of the k-th largest eigenvalue; value and vector are None if it lies in a cluster.

    The interval holds the k-th eigenvalue and is no wider than rounding if it holds others too.
    """
    size = float(np.abs(matrix).sum(axis=1).max())  # no eigenvalue is larger
    fine = 16 * EPS * size * max(len(matrix), 8)
    # Uneven ends, so that eigenvalues at simple fractions are not met by a cut.
    low, high = -0.0123 * size, 1.0371 * size
    above_low, above_high = len(matrix), 0
    while True:
        if above_low - above_high == 1:
            value, vector = rayleigh(matrix, (low + high) / 2, k)
            if low < value <= high:
                if count_above(matrix, value + fine) == k - 1 and count_above(matrix, value - fine) == k:
                    return low, high, value, vector
        if high - low <= fine:
            return low, high, None, None
        middle = (low + high) / 2
        above = count_above(matrix, middle)
        if above >= k:
            low, above_low = middle, above
        else:
            high, above_high = middle, above


def subspace(matrix: np.ndarray, low: float, high: float, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and an orthonormal basis for m eigenvalues within [low, high] that rounding cannot tell apart."""
    basis = np.random.default_rng(m).standard_normal((len(matrix), m))
    for _ in range(6):
        basis, _ = np.linalg.qr(_solved(matrix, (low + high) / 2, basis))
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    return values[::-1], (basis @ turn)[:, ::-1]


def leading(spark: SparkSession, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and their unit eigenvectors as columns; zero ones are left out."""
    size = float(np.abs(matrix).sum(axis=1).max(initial=0))
    zero = 64 * EPS * size * max(len(matrix), 8)
    most = min(most, count_above(matrix, zero)) if size else 0
    if not most:
        return np.zeros(0), np.zeros((len(matrix), 0))
    shared = spark.sparkContext.broadcast(matrix)  # at most MAX_WIDTH ** 2 doubles

    def isolated(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                low, high, value, vector = component(shared.value, k)
                row = {"k": k, "low": low, "high": high, "value": value, "vector": None if vector is None else vector.tolist()}
                yield pa.RecordBatch.from_pylist([row], FOUND)

    tasks = min(most, spark.sparkContext.defaultParallelism)
    found = spark.range(1, most + 1, numPartitions=tasks).mapInArrow(isolated, "k int, low double, high double, value double, vector array<double>")
    found = sorted(found.collect())  # at most COMPONENTS rows
    values, vectors = [], []
    clusters: list[list] = []
    for row in found:
        if row["value"] is not None:
            clusters.append([row])
        elif clusters and clusters[-1][0]["value"] is None and clusters[-1][-1]["low"] <= row["high"] + zero:
            clusters[-1].append(row)
        else:
            clusters.append([row])
    for rows in clusters:
        if rows[0]["value"] is not None:
            values.append(rows[0]["value"])
            vectors.append(np.array(rows[0]["vector"]))
            continue
        low, high = min(r["low"] for r in rows), max(r["high"] for r in rows)
        inside = count_above(matrix, low - zero) - count_above(matrix, high + zero)
        some, basis = subspace(matrix, low, high, max(inside, len(rows)))
        values += some[: len(rows)].tolist()
        vectors += list(basis.T[: len(rows)])
    shared.destroy()
    return np.array(values), np.array(vectors).T


FOUND = pa.schema(
    [("k", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("value", pa.float64()), ("vector", pa.list_(pa.float64()))]
)


def _projected(x: np.ndarray, centre: np.ndarray, left: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """x - S / n on the scaled axes; the whole part of the difference is exact."""
    return ((x - centre) - left) @ axes


def _gram(centre: np.ndarray, left: np.ndarray, axes: np.ndarray):
    """Per task the sums (j = -1) and the sums of products of whitened values, which have mean zero."""
    i, j = np.triu_indices(axes.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(axes.shape[1]), np.zeros((axes.shape[1],) * 2)
        for _, _, x in _pieces(batches):
            w = _projected(x, centre, left, axes)
            sums += w.sum(axis=0)
            products += w.T @ w
        k = np.arange(len(sums))
        arrays = [np.concatenate([k, i]), np.concatenate([np.full(len(k), -1), j]), np.concatenate([sums, products[i, j]])]
        yield pa.RecordBatch.from_arrays([pa.array(arrays[0], pa.int32()), pa.array(arrays[1], pa.int32()), pa.array(arrays[2])], ["i", "j", "total"])

    return run


def _rows(n: int, sums: list[int], centre: np.ndarray, left: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float):
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], object)

    def deviations(x: np.ndarray) -> pa.Array:
        y = x - centre
        bound = n * (int(np.abs(y).max(initial=0)) + 1)
        if bound**2 * max(len(centre), 1) < 2**63:
            return pa.array(((n * y - rest.astype(np.int64)) ** 2).sum(axis=1))
        exact = ((n * y.astype(object) - rest) ** 2).sum(axis=1)
        if max(exact) >= 2**63:
            raise ValueError("a deviation passes 64 bits")
        return pa.array([int(e) for e in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(explained)
        for piece, rows, x in _pieces(batches):
            w = _projected(x, centre, left, axes)
            at = pa.array(np.repeat(np.arange(len(rows)), m))
            size = len(rows) * m
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id").take(pa.array(rows)).take(at),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(size, n)),
                    deviations(x).take(at),
                    pa.array(w.reshape(-1)),
                    pa.array(np.tile(explained, len(rows))),
                    pa.array(np.full(size, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(frame: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row per vector and component."""
    spark = frame.sparkSession
    source = frame.select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = source.select("id", F.col("v").cast("array<double>"))
    first = sorted(_collected(vectors, _sums))
    counts = {r["n"] for r in first}
    if len(counts) > 1:
        raise ValueError("vectors need one length")
    if not first:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    n, sums = counts.pop(), [int(r["total"]) for r in first]
    whole = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, whole, strict=True)]
    centre, left = np.array(whole, np.int64), np.array([r / n for r in rest])

    matrix = np.zeros((len(sums),) * 2)
    trace = 0
    for r in _collected(vectors, _products(centre)):
        exact = n * int(r["total"]) - rest[r["i"]] * rest[r["j"]]
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = exact / n**2
        trace += exact if r["i"] == r["j"] else 0
    values, axes = leading(spark, matrix, components)
    if not len(values):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    scaled, explained = axes / np.sqrt(values), values / (trace / n**2)

    gram = vectors.mapInArrow(_gram(centre, left, scaled), "i int, j int, total double")
    gram = {(r["i"], r["j"]): r["total"] / n for r in gram.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    error = max(abs(v - gram[i, -1] * gram[j, -1] - (i == j)) for (i, j), v in gram.items() if j >= 0)
    result = vectors.mapInArrow(_rows(n, sums, centre, left, scaled, explained, float(error)), schema)
    return result.withColumnRenamed("id", id_column)


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every valid vector and leading component."""
    return whiten(table(spark, sf_dir, "embeddings").withColumn("vec_id", F.col("vec_id").cast("long")))
