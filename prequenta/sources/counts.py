"""Confusion counts per micro-batch, written so that a replayed batch replaces itself.

A table has two levels. The counts of a batch are a small folder of their own,
``era=<E>/batch_id=<B>`` below ``path``, which is replaced as a whole if the batch runs again. Once
the stream has left an era, ``close`` rewrites its batches into one file beside a snapshot of the
totals up to its end, both below ``<path>-closed/era=<E>/attempt=<A>``, and publishes them with one
empty marker file, ``<path>-closed/commits/<E>-<A>``.

* Before the marker exists, readers take the era from its batch folders; a crash leaves an attempt
  that nothing refers to.
* From the marker on, every era up to it is read from what was published and nothing else, so a
  batch that an old driver still writes there is not counted again.
* An attempt is published only if it holds exactly the batches that were listed before and after
  it was written, so a batch that is being replaced meanwhile is not lost. Several attempts that
  are published for one era hold the same counts, and readers take the first by name.
* Batch folders go when the era after theirs is closed, so a reader that has listed them just
  before still finds them.

No listing or read grows with the age of the stream but by one entry per era.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.session import create_marker, drop_folder, list_folder

# Batches per folder level and per closed file, unless a run is opened with another number.
BATCHES_PER_ERA = 1000

COUNTS_SCHEMA = "at timestamp, model string, predicted int, actual int, n bigint, era bigint, batch_id bigint"
BATCH_SCHEMA = "batch_id bigint, at timestamp, model string, predicted int, actual int, n bigint"
TOTALS_SCHEMA = "model string, predicted int, actual int, n bigint"
COLUMNS = ("batch_id", "at", "model", "predicted", "actual", "n")
CELL = ("model", "predicted", "actual")


def summed(counts: DataFrame) -> DataFrame:
    """Totals over all batches."""
    return counts.groupBy(*CELL).agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class CountTable:
    path: str
    batches_per_era: int = BATCHES_PER_ERA

    def era_of(self, batch_id: int) -> int:
        return batch_id // self.batches_per_era

    # Writing.

    def write(self, counts: DataFrame, batch_id: int, at: datetime | None = None) -> None:
        """Replace the counts of one batch, leaving all others alone. ``at`` is its commit time, by default now."""
        time = F.current_timestamp() if at is None else F.lit(at)
        self.write_batches(counts.coalesce(1).withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "at": time}))

    def write_batches(self, counts: DataFrame) -> None:
        """Replace the counts of all batches that occur in ``counts``, which has their ids and may have their times."""
        time = F.col("at") if "at" in counts.columns else F.current_timestamp()
        (
            counts.withColumn("at", time.cast("timestamp"))
            .withColumn("batch_id", F.col("batch_id").cast("bigint"))
            .withColumn("era", F.floor(F.col("batch_id") / self.batches_per_era).cast("bigint"))
            .select("at", *CELL, "n", "era", "batch_id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("era", "batch_id")
            .parquet(self.path)
        )

    # Closed eras.

    def _closed_folder(self, era: int, attempt: str) -> str:
        return f"{self.path}-closed/era={era}/attempt={attempt}"

    def closed(self, spark: SparkSession) -> dict[int, str]:
        """The folder of each closed era."""
        found: dict[int, str] = {}
        for name in sorted(list_folder(spark, f"{self.path}-closed/commits"), reverse=True):
            era, attempt = name.split("-", 1)
            found[int(era)] = self._closed_folder(int(era), attempt)
        return found

    def live(self, spark: SparkSession, after: int) -> list[int]:
        """The eras after ``after`` that have batch folders."""
        names = list_folder(spark, self.path)
        return sorted(e for e in (int(n.removeprefix("era=")) for n in names if n.startswith("era=")) if e > after)

    def _batches_of(self, spark: SparkSession, era: int) -> set[int]:
        names = list_folder(spark, f"{self.path}/era={era}")
        return {int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")}

    def _commit(self, spark: SparkSession, era: int, attempt: str) -> None:
        create_marker(spark, f"{self.path}-closed/commits/{era:09d}-{attempt}")

    def close(self, spark: SparkSession, era: int) -> bool:
        """Rewrite and publish one era; False if a batch of it was being replaced meanwhile."""
        batches = self._batches_of(spark, era)
        earlier = {e: folder for e, folder in self.closed(spark).items() if e < era}
        attempt = uuid4().hex
        folder = self._closed_folder(era, attempt)
        whole = self._live_counts(spark, [era]).coalesce(1).sortWithinPartitions("batch_id", *CELL)
        try:
            whole.write.parquet(f"{folder}/batches")
        except Exception as failure:
            # A file that was listed and is gone: its batch is being replaced.
            if "FILE_NOT_EXIST" not in str(failure) and "FileNotFoundException" not in str(failure):
                raise
            drop_folder(spark, folder)
            return False
        stored = spark.read.schema(BATCH_SCHEMA).parquet(f"{folder}/batches")
        totals = summed(stored.select(*CELL, "n").unionByName(self._snapshot(spark, earlier)))
        totals.coalesce(1).write.parquet(f"{folder}/totals")
        held = {r["batch_id"] for r in stored.select("batch_id").distinct().collect()}  # one per batch of the era
        if not held == batches == self._batches_of(spark, era):
            drop_folder(spark, folder)
            return False
        self._commit(spark, era, attempt)
        for old in self.live(spark, -1):
            if old < era:
                drop_folder(spark, f"{self.path}/era={old}")
        return True

    def close_before(self, spark: SparkSession, batch_id: int) -> int:
        """Close all eras that a stream which has reached ``batch_id`` has left; the last closed era, or -1."""
        last = max(self.closed(spark), default=-1)
        for era in self.live(spark, last):
            if era >= self.era_of(batch_id) or not self.close(spark, era):
                break
            last = era
        return last

    # Reading.

    def _live_counts(self, spark: SparkSession, eras: Iterable[int]) -> DataFrame:
        folders = [f"{self.path}/era={era}" for era in eras]
        none = spark.createDataFrame([], BATCH_SCHEMA)
        if not folders:
            return none
        try:
            return spark.read.schema(COUNTS_SCHEMA).option("basePath", self.path).parquet(*folders).select(*COLUMNS)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return none

    def _closed_counts(self, spark: SparkSession, folders: Iterable[str]) -> DataFrame:
        paths = [f"{folder}/batches" for folder in folders]
        return spark.read.schema(BATCH_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], BATCH_SCHEMA)

    def _snapshot(self, spark: SparkSession, closed: dict[int, str]) -> DataFrame:
        """Totals up to the end of the last of these closed eras."""
        if not closed:
            return spark.createDataFrame([], TOTALS_SCHEMA)
        return spark.read.schema(TOTALS_SCHEMA).parquet(f"{closed[max(closed)]}/totals")

    def read(self, spark: SparkSession) -> DataFrame:
        """``COLUMNS`` of all batches; empty before the first batch is written."""
        closed = self.closed(spark)
        live = self.live(spark, max(closed, default=-1))
        if not closed:
            return self._live_counts(spark, live)
        return self._closed_counts(spark, closed.values()).unionByName(self._live_counts(spark, live))

    def totals(self, spark: SparkSession) -> DataFrame:
        """``(model, predicted, actual, n)`` over all batches, from the last snapshot and the batches after it."""
        closed = self.closed(spark)
        live = self._live_counts(spark, self.live(spark, max(closed, default=-1)))
        return summed(self._snapshot(spark, closed).unionByName(live.select(*CELL, "n")))

    def newest(self, spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
        """Counts of the newest eras that hold the last ``n`` batches of every model, and the totals before them.

        Eras are read from the newest back until all models have ``n`` batches. A model that
        has fewer, or that stopped long ago, takes the walk to the first era.
        """
        closed = self.closed(spark)
        live = self.live(spark, max(closed, default=-1))
        names = self._snapshot(spark, closed).select("model").unionByName(self._live_counts(spark, live).select("model"))
        missing = {r["model"]: n for r in names.distinct().collect()}  # as many rows as models
        order = [(e, True) for e in reversed(live)] + [(e, False) for e in sorted(closed, reverse=True)]
        taken = 0
        while taken < len(order) and any(m > 0 for m in missing.values()):
            era, is_live = order[taken]
            counts = self._live_counts(spark, [era]) if is_live else self._closed_counts(spark, [closed[era]])
            for r in counts.groupBy("model").agg(F.count_distinct("batch_id").alias("batches")).collect():
                missing[r["model"]] -= r["batches"]
            taken += 1
        used, rest = order[:taken], order[taken:]
        counts = self._closed_counts(spark, [closed[e] for e, is_live in used if not is_live])
        if any(is_live for _, is_live in used):
            counts = counts.unionByName(self._live_counts(spark, [e for e, is_live in used if is_live]))
        before = self._snapshot(spark, {e: closed[e] for e, is_live in rest if not is_live})
        older = [e for e, is_live in rest if is_live]
        if older:
            before = summed(before.unionByName(self._live_counts(spark, older).select(*CELL, "n")))
        return counts, before
