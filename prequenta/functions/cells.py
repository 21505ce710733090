"""Column expressions over one labelled record, all evaluated in the JVM."""

from __future__ import annotations

from functools import reduce
from math import isfinite

from pyspark.sql import Column
from pyspark.sql import functions as F

# The record format.
DELIMITER = ","
RAW_LABELS = {-1: 0, 1: 1}
BLANKS = " \t\n\r\x0b\x0c"


def split_cells(line: Column) -> Column:
    """All cells of a line, empty trailing ones included."""
    return F.split(line, DELIMITER, -1)


def int_cells(cells: Column) -> Column:
    """Cells as integers; a cell that is no integer becomes NULL.

    One array cast runs in generated code, where ``transform`` with a lambda would not.
    """
    return cells.try_cast("array<bigint>")


def any_missing(array: str) -> str:
    """SQL: true if an element of the named array is NULL.

    Spark evaluates a projection with a lambda outside whole-stage code and generates the
    rest of it as many small methods. That is wanted next to long expressions: as part of
    a whole-stage method they pass the 8000 bytes of bytecode above which the JVM only
    interprets it, which costs a factor of six.
    """
    return f"exists({array}, element -> element IS NULL)"


def label_fault(raw: Column) -> Column:
    """What is wrong with a raw label, or NULL. With ``label_class`` the one place that says which labels there are."""
    message = F.concat(F.lit("label is neither -1 nor 1: "), F.coalesce(raw.cast("string"), F.lit("NULL")))
    return F.when(raw.isin(*RAW_LABELS), F.lit(None).cast("string")).otherwise(message)


def label_class(raw: Column) -> Column:
    """The class of a raw label, NULL for any that is not one."""
    return reduce(lambda cases, label: cases.when(raw == label, RAW_LABELS[label]), RAW_LABELS, F).cast("int")


def encode_label(raw: Column) -> Column:
    """-1 becomes 0 and 1 stays 1; any other label fails the query and is named."""
    return F.coalesce(label_class(raw), F.raise_error(label_fault(raw)).cast("int"))


def strip_line(line: Column) -> Column:
    """The line without blanks, tabs and line ends on either side."""
    return F.btrim(line, F.lit(BLANKS))


def margin(features: str, weights: tuple[float, ...], intercept: float) -> str:
    """SQL for a dot product with fixed weights plus intercept, in the order of the features.

    NULL if a feature is NULL or their number is not that of the weights. One term per
    feature is generated code, several times faster than ``aggregate(zip_with(...))``. It
    is SQL text because building hundreds of column objects takes longer than a small batch.
    """
    terms = " + ".join(f"get({features}, {i}) * {double_sql(w)}" for i, w in enumerate(weights))
    # A plain summand instead of a branch around the terms: within a branch, Spark would
    # look up the features again for each model.
    matches = f"IF(size({features}) = {len(weights)} AND NOT {any_missing(features)}, 0D, NULL)"
    return f"{terms} + {double_sql(intercept)} + {matches}"


def double_sql(value: float) -> str:
    """A double literal with the exact value."""
    return f"{value!r}D" if isfinite(value) else f"double('{value!r}')"


def predicted_class(margin_sql: str, threshold: float = 0.5) -> str:
    """SQL: 1 where the logistic of the margin is above the threshold, else 0 (also on a tie)."""
    return f"CAST(1D / (1D + exp(-({margin_sql}))) > {double_sql(threshold)} AS INT)"


def counter_key(predicted: Column, actual: Column, suffix: Column) -> Column:
    """``predicted:actual`` plus the model's suffix; the label prints as a float (``1:1.0``)."""
    return F.concat(
        predicted.cast("string"), F.lit(":"), actual.cast("double").cast("string"), suffix
    )
