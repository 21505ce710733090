"""Exact top-k by inner product, by a three-phase uniform threshold.

The components are cut into ``n_blocks`` blocks, so that a score is the sum of one partial score
per block.

1. Every chunk of rows gives, per query and block, its k+1 best partial scores (local lists). The
   best of them per query, scored in full, set the query's cutoff T: its k-th best full score.
2. The cutoffs go back to the chunks. If all partial scores of a row were below T / n_blocks, its
   score would be below T; so entries at or above T / n_blocks in some block are sufficient.
3. Only for these rows are the partial scores that are still missing resolved, and the exact
   scores compared.

Queries and rows meet in blocks: queries in groups of at most ``QUERY_ROWS``, which visit every
group of rows once. Rows with the same vector are one row that carries its k+1 smallest ids (more
can never be among the k best of one query), so a vector that a third of the rows share costs as
much as any other.

Integers are exact: products are taken in float64 while every sum stays below 2**53, and in int64
beyond. Vectors that are NULL or hold a NULL or non-finite component take no part. Vectors of
another length than the query's score over the components both have. Ties go to the smaller id.
Repeated rows count once; of several vectors under one id the smallest (in array order) is taken.
An id that is NULL takes no part. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prequenta.llm.common import table, written

QUERY_ROWS = 256
CHUNK_ROWS = 2048
N_BLOCKS = 2


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component; NULL for vectors that take no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, whole)


def _chunks(distinct: DataFrame, rows: int, name: str) -> DataFrame:
    """Vectors dealt by hash into chunks of about ``rows``."""
    n = max(1, -(-distinct.count() // rows))
    return (
        distinct.withColumn(name, F.abs(F.xxhash64("v")) % n)
        .groupBy(name)
        .agg(F.collect_list(F.struct("cls", "v")).alias(f"{name}_rows"))
    )


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = rows.field("cls").to_numpy(), rows.field("v")
    length = pc.list_value_length(vectors).to_numpy()
    values = vectors.flatten().to_numpy()
    width = int(length.max(initial=0))
    if (length == width).all():
        return ids, values.reshape(len(ids), width)
    out = np.zeros((len(ids), width), np.int64)
    out[np.arange(width) < length[:, None]] = values
    return ids, out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each pair of a query group and a row group, as ids and matrices of the width they share."""
    for batch in batches:
        for i in range(batch.num_rows):
            q_ids, q = _matrix(batch.column("q_rows")[i].values)
            ids, v = _matrix(batch.column("c_rows")[i].values)
            width = min(q.shape[1], v.shape[1])
            yield batch, i, q_ids, q[:, :width], ids, v[:, :width]


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    if bound < 2**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def _blocks(q: np.ndarray, v: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return zip(np.array_split(q, n, 1), np.array_split(v, n, 1), strict=True)


def _entries(query: np.ndarray, cls: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(cls), pa.array(score)], ["query", "cls", "score"])


ENTRY = "query long, cls long, score long"


def _local_lists(k: int, n_blocks: int):
    """Phase 1: per query and block the k rows with the best partial scores, scored in full."""

    def run(batches):
        for _, _, q_ids, q, ids, v in _cells(batches):
            take = min(k, len(ids))
            at = [np.argpartition(-_products(a, b), take - 1, axis=1)[:, :take] for a, b in _blocks(q, v, n_blocks)]
            at = np.sort(np.concatenate(at, axis=1), axis=1)
            once = np.ones(at.shape, bool)
            once[:, 1:] = at[:, 1:] != at[:, :-1]
            x, y = np.nonzero(once)
            row = at[x, y]
            yield _entries(q_ids[x], ids[row], np.einsum("nd,nd->n", q[x], v[row]))

    return run


def _sufficient(n_blocks: int):
    """Phases 2 and 3: rows with a sufficient entry in some block, their scores resolved exactly."""

    def run(batches):
        for batch, i, q_ids, q, ids, v in _cells(batches):
            at = batch.column("cuts")[i].values
            cut = dict(zip(at.field("query").to_pylist(), at.field("cut").to_pylist(), strict=True))
            t = np.array([cut.get(x, -(2**62)) for x in q_ids.tolist()], np.int64)
            hit = np.zeros((len(q), len(v)), bool)
            for a, b in _blocks(q, v, n_blocks):
                hit |= _products(a, b) >= (t // n_blocks)[:, None]
            x, y = np.nonzero(hit)
            for start in range(0, len(x), 1 << 16):
                xs, ys = x[start : start + (1 << 16)], y[start : start + (1 << 16)]
                score = np.einsum("nd,nd->n", q[xs], v[ys])
                keep = score >= t[xs]
                yield _entries(q_ids[xs][keep], ids[ys][keep], score[keep])

    return run


def _first(frame: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    return frame.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= k)


def _valid(frame: DataFrame, id_column: str, vector: str) -> DataFrame:
    return (
        frame.select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
        .where("id IS NOT NULL AND v IS NOT NULL")
        .groupBy("id")
        .agg(F.min("v").alias("v"))
    )


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 5, n_blocks: int = N_BLOCKS, id_column: str = "id", vector: str = "v"
) -> DataFrame:
    """(query_id, rank, id, score) of the k best rows per query; both inputs hold integer vectors."""
    members = _first(_valid(rows, id_column, vector), ["v"], k + 1, F.col("id"))
    members = written(members.withColumn("cls", F.min("id").over(Window.partitionBy("v"))), "topk-members")
    asked = _valid(queries, id_column, vector)
    asked = written(asked.withColumn("cls", F.min("id").over(Window.partitionBy("v"))), "topk-queries")
    chunks = written(_chunks(members.where("n = 1").select("cls", "v"), CHUNK_ROWS, "c"), "topk-chunks")
    groups = written(_chunks(asked.where("id = cls").select("cls", "v"), QUERY_ROWS, "q"), "topk-groups")

    # The stated queries visit all rows, in blocks: a group of queries is sent to every row group by its number.
    n_chunks = chunks.agg(F.max("c")).first()[0]
    visits = groups.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_chunks or 0)))).withColumn("c", F.col("c").cast("long"))
    grid = visits.join(chunks.hint("shuffle_hash"), "c")
    lists = grid.select("q_rows", "c_rows").mapInArrow(_local_lists(k + 1, n_blocks), ENTRY)
    # k+1 scores, as one of them may be the query's own row.
    cut = _first(lists, ["query"], k + 1, F.col("score").desc()).where(F.col("n") == k + 1)
    cuts = written(
        groups.select("q", F.explode("q_rows.cls").alias("query"))
        .join(cut.select("query", F.col("score").alias("cut")), "query")
        .groupBy("q")
        .agg(F.collect_list(F.struct("query", "cut")).alias("cuts")),
        "topk-cuts",
    )
    none = F.array().cast("array<struct<query:bigint,cut:bigint>>")
    cells = grid.join(cuts, "q", "left").select("q_rows", "c_rows", F.coalesce("cuts", none).alias("cuts"))
    found = cells.mapInArrow(_sufficient(n_blocks), ENTRY)
    best = _first(found, ["query"], k + 1, F.col("score").desc(), F.col("cls")).drop("n")
    ids = best.join(members.select("cls", "id"), "cls")
    ids = _first(ids, ["query"], k + 1, F.col("score").desc(), F.col("id")).drop("n")
    answers = asked.select(F.col("id").alias("query_id"), F.col("cls").alias("query")).join(ids, "query").where("id != query_id")
    return _first(answers, ["query_id"], k, F.col("score").desc(), F.col("id")).select(
        "query_id", F.col("n").alias("rank"), "id", "score"
    )


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where("id % 50 = 0"), 5).withColumnRenamed("id", "vec_id")


OP10_SQL = """
WITH n AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
