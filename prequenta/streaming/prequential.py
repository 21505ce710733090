"""Test-then-train over a stream: every micro-batch is scored before it is learned from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prequenta.model import N_FEATURES, Model
from prequenta.operators.evaluate import confusion_counts
from prequenta.operators.fit import ONLINE, SgdSettings, sgd_fit
from prequenta.operators.parse import parse_labelled, split_rejects
from prequenta.operators.report import POINTS, last_points, running_accuracy
from prequenta.operators.score import score
from prequenta.sources.counts import BATCHES_PER_ERA, CountTable
from prequenta.sources.models import load_models, save_models
from prequenta.sources.rejects import read_rejects as rejects_below
from prequenta.sources.rejects import write_rejects
from prequenta.streaming.progress import ProgressWriter, read_progress as progress_below


RUNS_SCHEMA = "run_id string, started timestamp, batches_per_era bigint"


@dataclass(frozen=True)
class Run:
    """One run's folder. Counts, model versions and stream progress live and end together."""

    path: str
    batches_per_era: int = BATCHES_PER_ERA

    @property
    def counts(self) -> str:
        return f"{self.path}/counts"

    @property
    def count_table(self) -> CountTable:
        return CountTable(self.counts, self.batches_per_era)

    @property
    def rejects(self) -> str:
        return f"{self.path}/rejects"

    @property
    def progress(self) -> str:
        return f"{self.path}/progress"

    @property
    def models(self) -> str:
        return f"{self.path}/models"

    @property
    def checkpoint(self) -> str:
        return f"{self.path}/checkpoint"


def latest_run(spark: SparkSession, out: str) -> Run | None:
    """The run below ``out`` that started last."""
    base = out.rstrip("/")
    try:
        runs = spark.read.schema(RUNS_SCHEMA).parquet(f"{base}/runs")
        latest = runs.agg(F.max_by(F.struct("*"), "started").alias("run")).select("run.*").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Run(f"{base}/run-{latest['run_id']}", latest["batches_per_era"] or BATCHES_PER_ERA)


def open_run(spark: SparkSession, out: str, reset: bool = False, batches_per_era: int = BATCHES_PER_ERA) -> Run:
    """The latest run below ``out``, or a new one if there is none or ``reset`` is set.

    A reset starts from nothing in a folder of its own; earlier runs stay readable. A run keeps
    the ``batches_per_era`` it was opened with first.
    """
    if batches_per_era < 1:
        raise ValueError(f"an era needs a batch: {batches_per_era}")
    found = None if reset else latest_run(spark, out)
    if found is not None:
        return found
    base, run_id = out.rstrip("/"), uuid4().hex
    (
        spark.range(1, numPartitions=1)
        .select(
            F.lit(run_id).alias("run_id"),
            F.current_timestamp().alias("started"),
            F.lit(batches_per_era).cast("bigint").alias("batches_per_era"),
        )
        .write.mode("append")
        .parquet(f"{base}/runs")
    )
    return Run(f"{base}/run-{run_id}", batches_per_era)


def read_counts(spark: SparkSession, run: Run, times: bool = False) -> DataFrame:
    """``(batch_id, model, predicted, actual, n)`` of all batches, with ``times`` also ``at``, when each was committed."""
    counts = run.count_table.read(spark)
    return counts if times else counts.drop("at")


def read_totals(spark: SparkSession, run: Run) -> DataFrame:
    """``(model, predicted, actual, n)`` over all batches, without reading closed eras."""
    return run.count_table.totals(spark)


def newest_points(spark: SparkSession, run: Run, n: int = POINTS, seed_zeros: bool = False) -> DataFrame:
    """``last_points`` of the running accuracy, from the eras that hold them and one total of all before."""
    counts, before = run.count_table.newest(spark, n)
    return last_points(running_accuracy(counts, before=before), n, seed_zeros)


def read_rejects(spark: SparkSession, run: Run) -> DataFrame:
    """``(batch_id, line, reject_reason)`` of all lines that the permissive stream could not parse."""
    return rejects_below(spark, run.rejects)


def read_progress(spark: SparkSession, run: Run) -> DataFrame:
    """``(batch_id, input_rows, started, duration_ms)`` of all micro-batches, empty ones included."""
    return progress_below(spark, run.progress)


class TestThenTrain:
    """The work per micro-batch, safe to repeat for the same batch id.

    All tables are keyed by batch id and a batch starts from the newest models *before*
    it, so a batch that runs again after a crash recomputes and replaces its own rows. With
    ``mode="permissive"``, lines that do not parse go to the rejects of the batch instead of
    stopping the stream at the same place for ever; a batch without any good line leaves
    nothing else. Eras that the stream has left are closed. ``clock`` gives the commit time
    of a batch, by default the time its counts are written.
    """

    __test__ = False

    def __init__(
        self,
        run: Run,
        initial: Iterable[Model],
        settings: SgdSettings = ONLINE,
        train: bool = True,
        n_features: int = N_FEATURES,
        mode: str = "strict",
        clock: Callable[[int], datetime] | None = None,
    ) -> None:
        self.run = run
        self.mode = mode
        self.clock = clock
        self._closed_before: int | None = None
        self.initial = {m.name: m for m in initial}
        self.settings = settings
        self.train = train
        self.n_features = n_features
        self._cached: tuple[int, dict[str, Model]] | None = None

    def _era_folder(self, era: int) -> str:
        return f"{self.run.models}/era={era}"

    def models_before(self, spark: SparkSession, batch_id: int) -> dict[str, Model]:
        """The models as the batches before ``batch_id`` left them."""
        if self._cached is not None and self._cached[0] < batch_id:
            return self._cached[1]
        # Reached once after a (re)start: what is found stays valid until this stream learns.
        found = self._stored_before(spark, batch_id) or self.initial
        self._cached = (batch_id - 1, found)
        return found

    def _stored_before(self, spark: SparkSession, batch_id: int) -> dict[str, Model]:
        # Batches that had no rows leave no version behind.
        for era in range(self.run.count_table.era_of(batch_id), -1, -1):
            try:
                found = load_models(spark, self._era_folder(era), before=batch_id)
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            if found:
                return found
        return {}

    def _close_eras(self, spark: SparkSession, batch_id: int) -> None:
        """Once per era, and once after a (re)start; what could not be closed is tried again."""
        table = self.run.count_table
        era = table.era_of(batch_id)
        if self._closed_before != era and table.close_before(spark, batch_id) >= 0:
            self._closed_before = era

    def __call__(self, lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        parsed = parse_labelled(lines, n_features=self.n_features, mode=self.mode)
        parsed = parsed.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if parsed.isEmpty():
                return
            points = parsed
            table = self.run.count_table
            if self.mode == "permissive":
                points, bad = split_rejects(parsed)
                write_rejects(bad, batch_id, table.era_of(batch_id), self.run.rejects)
                if points.isEmpty():
                    return
            models = self.models_before(spark, batch_id)
            scored = score(points, models.values())
            table.write(confusion_counts(scored, list(models)), batch_id, self.clock and self.clock(batch_id))
            if self.train:
                fitted = sgd_fit(points, models.values(), self.settings)
                save_models(spark, fitted.values(), self._era_folder(table.era_of(batch_id)), version=batch_id)
                self._cached = (batch_id, fitted)
            self._close_eras(spark, batch_id)
        finally:
            parsed.unpersist()


def run_prequential(
    lines: DataFrame,
    initial: Iterable[Model],
    run: Run,
    settings: SgdSettings = ONLINE,
    train: bool = True,
    n_features: int = N_FEATURES,
    interval: str = "1 second",
    available_now: bool = False,
    mode: str = "strict",
    clock: Callable[[int], datetime] | None = None,
    progress: bool = False,
) -> StreamingQuery:
    """Start the stream. ``lines`` is any streaming DataFrame with the line in ``value``.

    ``interval`` is the shortest time between micro-batches; a batch that learns longer
    delays the next one. ``available_now`` stops after the input that exists at the start.
    ``mode="permissive"`` keeps lines that do not parse in the run's rejects. ``progress``
    adds a listener that writes every micro-batch to the run's progress table.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    writer = (
        lines.select("value")
        .writeStream.foreachBatch(TestThenTrain(run, initial, settings, train, n_features, mode, clock))
        .option("checkpointLocation", run.checkpoint)
        .trigger(**trigger)
    )
    if not progress:
        return writer.start()
    name = f"prequenta-{uuid4().hex}"
    spark = lines.sparkSession
    spark.streams.addListener(ProgressWriter(spark, name, run.progress, run.count_table.era_of))
    return writer.queryName(name).start()
