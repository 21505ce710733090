"""Lines a stream could not parse, keyed by batch so that a replayed batch replaces its own."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from prequenta.operators.parse import REJECT

REJECTS_SCHEMA = f"line string, {REJECT} string, era bigint, batch_id bigint"


def write_rejects(bad: DataFrame, batch_id: int, era: int, path: str) -> None:
    """Replace the rejects of one batch; a batch without any leaves an empty folder entry.

    The whole folder of the batch is overwritten, not only the partitions that occur, so a
    batch that runs again and finds none leaves none.
    """
    bad.write.mode("overwrite").parquet(f"{path}/era={era}/batch_id={batch_id}")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``(batch_id, line, reject_reason)``; empty before the first batch."""
    try:
        stored = spark.read.schema(REJECTS_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], REJECTS_SCHEMA)
    return stored.select("batch_id", "line", REJECT)
