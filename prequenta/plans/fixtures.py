"""Labelled lines derived from the given tables, as DataFrames and as the same SQL.

Each fixture has 30 features (``vectors``: 64) in {-1, 0, 1} and a raw label in {-1, 1}:

* ``vectors``   from ``embeddings``: almost no signal, for checking numerics;
* ``items``     from ``lineitem``: a linear rule with bounded noise, for batch work;
* ``stream``    from ``events``: the same rule, in the order of ``event_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from prequenta.functions.cells import DELIMITER
from prequenta.model import N_FEATURES
from prequenta.session import shared_folder


def first_primes(n: int) -> list[int]:
    primes: list[int] = []
    candidate = 2
    while len(primes) < n:
        if all(candidate % p for p in primes):
            primes.append(candidate)
        candidate += 1
    return primes


PRIMES = first_primes(N_FEATURES)
HEADER = DELIMITER.join([f"f{k}" for k in range(1, N_FEATURES + 1)] + ["label"])
CUTOFF = 0.05
VECTOR_FEATURES = 64  # width of the given embeddings
ROW_GROUP_BYTES = 8 << 20

ITEM_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: dict[tuple[str, str, str], str] = {}


def _as_table(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame, order: str | None = None) -> DataFrame:
    """``lines`` as a table written once per application, the way lines arrive in practice.

    Written as the source is read, without a shuffle; small row groups let several tasks read
    one file. With ``order`` the files are ranges of that column, so that a range is read from
    its own files.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = shared_folder(spark, name)
        laid_out = lines if order is None else lines.repartitionByRange(order).sortWithinPartitions(order)
        laid_out.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(keys..., c, shift, noise)`` to ``(keys..., line)``, a batch at a time, every cell as sign, digit and comma."""
    for batch in batches:
        *keys, c, shift, noise = batch.columns
        known = c.is_valid().to_numpy(zero_copy_only=False) & shift.is_valid().to_numpy(zero_copy_only=False)
        labelled = known & noise.is_valid().to_numpy(zero_copy_only=False)
        c, shift, noise = (column.fill_null(0).to_numpy() for column in (c, shift, noise))
        values = np.empty((len(c), N_FEATURES + 1), np.int8)
        for k, p in enumerate(PRIMES):
            quotient = c // p
            quotient += (c < 0) & (quotient * p != c)  # towards zero
            added = quotient + shift
            if (((quotient ^ added) & (shift ^ added) < 0) & known).any():
                raise OverflowError("a feature is beyond 64 bits")
            values[:, k] = np.fmod(added, 3) - 1
        f1, f2, f3 = values[:, :3].T
        values[:, -1] = np.where(labelled & (f1 + 2 * f2 - f3 + (np.fmod(noise, 3) - 1) > 0), 1, -1)
        cells = np.empty((*values.shape, 3), np.uint8)
        cells[..., 0], cells[..., 1], cells[..., 2] = ord("-"), ord("0") + np.abs(values), ord(DELIMITER)
        written = np.ones(cells.shape, bool)
        written[..., 0] = values < 0
        written[:, -1, 2] = False
        written[~known, :-1] = False  # a feature that is NULL has no cell
        ends = np.concatenate([[0], written.sum(axis=(1, 2)).cumsum()]).astype(np.int32)
        lines = pa.Array.from_buffers(pa.string(), len(c), [None, pa.py_buffer(ends), pa.py_buffer(cells[written])])
        yield pa.RecordBatch.from_arrays([*keys, lines], [*batch.schema.names[:-3], "line"])


def _planted(df: DataFrame, keys: tuple[str, ...], cents: str, shift: str, noise: str) -> DataFrame:
    """Lines whose label follows ``f1 + 2*f2 - f3`` plus noise in {-1, 0, 1}.

    Over Arrow batches: as column expressions the thirty features and their texts often ran several
    times slower the first time in a JVM than the second; the cause was not found.
    """
    parts = {"c": f"round({cents} * 100)", "shift": shift, "noise": noise}
    base = df.select(*keys, *[F.expr(f"cast({value} as bigint)").alias(f"_{name}") for name, value in parts.items()])
    schema = StructType([*base.schema.fields[:-3], StructField("line", StringType())])
    return base.mapInArrow(_line_texts, schema)


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_orderkey, l_linenumber, l_partkey, l_suppkey, line)``."""
    source = table(spark, sf_dir, "lineitem")
    lines = _planted(source, ITEM_KEYS, "l_extendedprice", "l_partkey", "l_suppkey")
    return _as_table(spark, sf_dir, "items", lines)


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, line)``."""
    source = table(spark, sf_dir, "events")
    lines = _planted(source, ("event_id", "user_id"), "value", "user_id", "event_id").drop("user_id")
    return _as_table(spark, sf_dir, "stream", lines, order="event_id")


def vector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, line)``."""
    features = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(v > CUTOFF, 1).when(v < -CUTOFF, -1).otherwise(0))
    label = F.when(F.col("label") % 2 == 1, 1).otherwise(-1)
    line = F.concat_ws(DELIMITER, features.cast("array<string>"), label).alias("line")
    return _as_table(spark, sf_dir, "vectors", table(spark, sf_dir, "embeddings").select("vec_id", line))


def batch_width(spark: SparkSession, sf_dir: str, batches: int) -> int:
    """Events per micro-batch so that all events make ``batches`` of them."""
    newest = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return newest // batches + 1


def with_batch(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("batch_id", F.expr(f"event_id div {width}"))


# The same fixtures in SQL. Each string is a list of common table expressions that ends in
# ``items``, ``stream`` or ``vectors`` with the keys, ``f`` (list of BIGINT) and ``label`` 0/1.


def _planted_sql(name: str, source: str, keys: tuple[str, ...], cents: str, shift: str, noise: str) -> str:
    columns = ", ".join(keys)
    features = ", ".join(f"((c // {p}) + {shift}) % 3 - 1" for p in PRIMES)
    return f"""
    {name}_c AS (SELECT {columns}, CAST(round({cents} * 100) AS BIGINT) AS c FROM {source}),
    {name}_f AS (SELECT {columns}, [{features}] AS f FROM {name}_c),
    {name} AS (SELECT *, CASE WHEN f[1] + 2 * f[2] - f[3] + ({noise} % 3 - 1) > 0 THEN 1 ELSE 0 END AS label
               FROM {name}_f)"""


ITEMS_SQL = _planted_sql("items", "lineitem", ITEM_KEYS, "l_extendedprice", "l_partkey", "l_suppkey")
STREAM_SQL = _planted_sql("stream", "events", ("event_id", "user_id"), "value", "user_id", "event_id")
VECTORS_SQL = f"""
    vectors AS (
        SELECT vec_id, list_transform(embedding, lambda v:
                   CASE WHEN CAST(v AS DOUBLE) > {CUTOFF} THEN 1 WHEN CAST(v AS DOUBLE) < -{CUTOFF} THEN -1 ELSE 0 END
               ) AS f, CASE WHEN label % 2 = 1 THEN 1 ELSE 0 END AS label
        FROM embeddings)"""
LINE_SQL = "array_to_string(f || [2 * label - 1], ',')"


def batch_sql(batches: int) -> str:
    return f"event_id // ((SELECT max(event_id) FROM events) // {batches} + 1)"
