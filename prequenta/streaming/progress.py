"""A table of what every micro-batch took in and how long it took."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS_SCHEMA = "input_rows bigint, started timestamp, duration_ms bigint, era bigint, batch_id bigint"


class ProgressWriter(StreamingQueryListener):
    """Writes one row per micro-batch of the query with the given name, and leaves when it ends.

    Rows are keyed by batch id: a batch that runs again after a restart replaces its row. Spark
    calls listeners after the batch and in order; a failure to write is not the stream's.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, era_of: Callable[[int], int]) -> None:
        self.spark, self.name, self.path, self.era_of = spark, name, path, era_of
        self.run_id: str | None = None
        self.ended = False

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run_id = str(event.runId)

    def onQueryProgress(self, event) -> None:
        at = event.progress
        if at.name != self.name:
            return
        row = self.spark.range(1, numPartitions=1).select(
            F.lit(at.numInputRows).cast("bigint").alias("input_rows"),
            F.to_timestamp(F.lit(at.timestamp)).alias("started"),
            F.lit(at.batchDuration).cast("bigint").alias("duration_ms"),
        )
        row.write.mode("overwrite").parquet(f"{self.path}/era={self.era_of(at.batchId)}/batch_id={at.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.ended = True
            self.spark.streams.removeListener(self)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """``(batch_id, input_rows, started, duration_ms)``; what Spark has not yet told its listeners is waited for."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    try:
        stored = spark.read.schema(PROGRESS_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], PROGRESS_SCHEMA)
    return stored.select("batch_id", "input_rows", "started", "duration_ms")
