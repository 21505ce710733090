"""Confusion counts and accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prequenta.functions.cells import counter_key
from prequenta.model import COLD, KEY_SUFFIX, PRETRAINED, SERIES_LABEL
from prequenta.operators.score import prediction_column

CLASSES = (0, 1)


def confusion_counts(scored: DataFrame, models: Sequence[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., model, predicted, actual, n)``, one row per combination that occurs.

    Every input row is read once whatever the number of models: four conditional counts
    per model are summed per partition before the shuffle, and only the small result is
    unpivoted.
    """
    cells = [(m, p, a, f"{m}_{p}_{a}") for m in models for p in CLASSES for a in CLASSES]
    counts = [
        F.expr(f"count_if({prediction_column(m)} = {p} AND label = {a}) AS {name}") for m, p, a, name in cells
    ]
    rows = ", ".join(f"'{m}', {p}, {a}, {name}" for m, p, a, name in cells)
    wide = scored.groupBy(*by).agg(*counts)
    unpivoted = F.expr(f"stack({len(cells)}, {rows})").alias("model", "predicted", "actual", "n")
    return wide.select(*by, unpivoted).where("n > 0")


def confusion_pivot(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per model with ``tp, tn, fp, fn``; a combination never seen counts 0."""

    def cell(predicted: int, actual: int) -> Column:
        hit = (F.col("predicted") == predicted) & (F.col("actual") == actual)
        return F.sum(F.when(hit, F.col("n")).otherwise(0))

    return counts.groupBy(*by, "model").agg(
        cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn")
    )


def _accuracies(counts: DataFrame, models: Sequence[str] | None) -> DataFrame:
    """``(place, model, type, value)`` of the named models, or of the usual two and all others in ``counts``."""
    named = (PRETRAINED, COLD) if models is None else tuple(models)
    kept = counts.select("model", "predicted", "actual", "n")
    if models is not None:
        kept = kept.where(F.col("model").isin(*named))
    # An empty count per name, so that a model without any rows is listed too.
    none = [F.struct(F.lit(m).alias("model"), *[F.lit(0).alias(c) for c in ("predicted", "actual", "n")]) for m in named]
    listed = kept.unionByName(counts.sparkSession.range(1).select(F.inline(F.array(*none))))
    hit = F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0))
    place, label = F.lit(len(named)), F.col("model")
    for i, m in enumerate(named):
        place = F.when(F.col("model") == m, i).otherwise(place)
    for m, text in SERIES_LABEL.items():
        label = F.when(F.col("model") == m, F.lit(text)).otherwise(label)
    value = F.try_divide(F.col("hit").cast("double"), F.col("every").cast("double"))
    sums = listed.groupBy("model").agg(hit.alias("hit"), F.sum("n").alias("every"))
    return sums.select(place.alias("place"), "model", label.alias("type"), value.alias("value"))


def accuracy(counts: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """``(type, value)``: right predictions over all predictions, one row per model.

    Without names: the usual two and every other model in ``counts``. A model without any
    counts gets a NULL value instead of an error.
    """
    return _accuracies(counts, models).orderBy("place", "model").select("type", "value")


def accuracy_json(counts: DataFrame, models: Sequence[str] | None = None, decimals: int | None = None) -> DataFrame:
    """One row ``json``: ``{"output":[{"type":...,"value":...},...]}`` in the order of ``models``, others by name."""
    rows = _accuracies(counts, models)
    if decimals is not None:
        rows = rows.withColumn("value", F.round("value", decimals))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("place", "model", "type", "value"))).alias("all"))
    output = F.transform("all", lambda r: F.struct(r["type"].alias("type"), r["value"].alias("value")))
    return ordered.select(F.to_json(F.struct(output.alias("output")), {"ignoreNullFields": "false"}).alias("json"))


def counter_keys(counts: DataFrame) -> DataFrame:
    """Total counts per rendered key: ``1:1.0:pre`` for the pretrained model, ``1:1.0`` for the cold one.

    Any other model is told apart by ``:<model>``.
    """
    suffix = F.concat(F.lit(":"), F.col("model"))
    for model, text in KEY_SUFFIX.items():
        suffix = F.when(F.col("model") == model, F.lit(text)).otherwise(suffix)
    key = counter_key(F.col("predicted"), F.col("actual"), suffix)
    return counts.groupBy(key.alias("key")).agg(F.sum("n").alias("n"))
