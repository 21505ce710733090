"""Delimited text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prequenta.functions.cells import DELIMITER
from prequenta.model import N_FEATURES
from prequenta.operators.parse import parse_labelled


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line in ``value``, no header handling."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of lines from files that arrive in ``path``."""
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The cells of the first line that is not empty, as they stand.

    For a folder this is the start of one of its files; all are expected to share it.
    """
    first = read_lines(spark, path).where("value != ''").first()
    if first is None:
        raise ValueError(f"there is no header in {path}")
    return first["value"].split(DELIMITER)


def read_labelled_csv(
    spark: SparkSession,
    path: str,
    header: str | None = None,
    n_features: int = N_FEATURES,
    mode: str = "strict",
) -> DataFrame:
    """Parse a headed file, or a folder of them, to labelled points."""
    head = header if header is not None else DELIMITER.join(read_header(spark, path))
    return parse_labelled(read_lines(spark, path), n_features=n_features, mode=mode, header=head)
