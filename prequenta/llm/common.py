"""Small helpers that the corpus operators share."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.session import drop_folder, shared_folder

TEXTS_AT_ONCE = 1_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_kept: dict[Any, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives a lost executor."""
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_written(frame: DataFrame) -> None:
    """Remove what ``written`` wrote, once nothing reads it any more."""
    for path in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
        drop_folder(frame.sparkSession, path)


def drop_when_released(frame: DataFrame) -> None:
    """Remove what ``written`` wrote as soon as nobody holds this frame any more."""
    spark, paths = frame.sparkSession, {file.rsplit("/", 1)[0] for file in frame.inputFiles()}
    weakref.finalize(frame, lambda: [drop_folder(spark, path) for path in paths]).atexit = False


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXTS_AT_ONCE, more: dict[str, str] | None = None) -> Iterator[None]:
    """While tables are written, at most ``rows`` rows travel to Python at once, so that neither side of the pipe
    holds more than a few megabytes of them; ``more`` are other settings for as long."""
    limit = int(spark.conf.get(BATCH_ROWS))
    values = {BATCH_ROWS: str(min(limit, rows) if limit > 0 else rows)} | (more or {})
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """An object of a Python worker that is kept from task to task: one at most, until one of another key or ``make_room``."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def make_room() -> None:
    """For tasks that need nothing kept: workers serve stages of all kinds, and what one kept would stay in their memory."""
    _kept.clear()
