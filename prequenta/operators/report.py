"""Accuracy over time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: points shown per series.
POINTS = 20


def _hits() -> tuple[Column, Column]:
    hit = F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0)).alias("hit")
    return hit, F.sum("n").alias("total")


def running_accuracy(counts: DataFrame, block: int = 10_000, before: DataFrame | None = None) -> DataFrame:
    """``(batch_id, model, accuracy)`` over all batches up to and including each one.

    A running sum ordered by batch would put the whole history of a model into one task.
    So it is taken in two steps: within blocks of ``block`` batches, and over the block
    totals, which are ``block`` times fewer. ``before`` are the total counts of all batches
    before those of ``counts``, if these are not the whole history. Where ``counts`` has commit
    times (``at``), the points have them too.
    """
    time = ["at"] if "at" in counts.columns else []
    per_batch = (
        counts.groupBy("model", "batch_id")
        .agg(*_hits(), *[F.max(c).alias(c) for c in time])
        # Never NULL, so that the join below filters neither side and both share one scan.
        .withColumn("block", F.coalesce(F.expr(f"batch_id div {block}"), F.lit(-1)))
    )
    earlier_blocks = W.partitionBy("model").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        per_batch.groupBy("model", "block")
        .agg(F.sum("hit").alias("hit"), F.sum("total").alias("total"))
        .select(
            "model",
            "block",
            F.coalesce(F.sum("hit").over(earlier_blocks), F.lit(0)).alias("hit_before"),
            F.coalesce(F.sum("total").over(earlier_blocks), F.lit(0)).alias("total_before"),
        )
    )
    in_block = W.partitionBy("model", "block").orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)
    within = per_batch.select(
        "model",
        "block",
        "batch_id",
        F.sum("hit").over(in_block).alias("hit"),
        F.sum("total").over(in_block).alias("total"),
        *time,
    )
    hits, totals = F.col("hit") + F.col("hit_before"), F.col("total") + F.col("total_before")
    joined = within.join(blocks, ["model", "block"])
    if before is not None:
        start = before.groupBy("model").agg(*_hits()).withColumnsRenamed({"hit": "hit_start", "total": "total_start"})
        joined = joined.join(start, "model", "left")
        hits, totals = hits + F.coalesce("hit_start", F.lit(0)), totals + F.coalesce("total_start", F.lit(0))
    value = F.try_divide(hits.cast("double"), totals.cast("double"))
    return joined.select("batch_id", "model", value.alias("accuracy"), *time)


def as_of(series: DataFrame, start: datetime, step: timedelta, n: int, block: int = 10_000) -> DataFrame:
    """``(tick, at, model, batch_id, accuracy)``: the last point of each model at ``n`` times ``step`` apart.

    ``series`` has commit times in ``at``. Every model gets a row for every tick: the newest point that was
    committed at or before it (of equal times that of the later batch), carried forward over ticks without
    a new one, NULL before the first. Points move to the first tick that sees them and only the newest per
    tick is kept; it is carried within blocks of ``block`` ticks and from block to block, so no task
    holds the history of a model.
    """
    micros = step // timedelta(microseconds=1)
    if micros <= 0 or n <= 0:
        raise ValueError("a grid needs a positive step and a positive number of times")
    grid_start = F.unix_micros(F.lit(start).cast("timestamp"))
    ahead = F.unix_micros("at") - grid_start
    # The first tick at or after the time; all that came before the grid is seen by its first tick.
    seen_by = F.greatest(F.lit(0).cast("bigint"), F.expr("ahead div step") + F.expr("CAST(ahead > 0 AND ahead % step > 0 AS BIGINT)"))
    placed = series.where(F.col("at").isNotNull()).withColumns({"ahead": ahead, "step": F.lit(micros).cast("bigint")}).withColumn("tick", seen_by)
    newest = F.max_by(F.struct("batch_id", "accuracy"), F.struct("at", "batch_id"))
    points = placed.where(F.col("tick") < n).groupBy("model", "tick").agg(newest.alias("point"))
    ticks = series.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("tick"))
    full = ticks.join(points, ["model", "tick"], "left").withColumn("block", F.expr(f"tick div {block}"))
    in_block = W.partitionBy("model", "block").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    earlier_blocks = W.partitionBy("model").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        points.withColumn("block", F.expr(f"tick div {block}"))
        .groupBy("model", "block")
        .agg(F.max_by("point", "tick").alias("end"))
    )
    blocks = ticks.select("model", F.expr(f"tick div {block}").alias("block")).distinct().join(ends, ["model", "block"], "left")
    carried = blocks.select("model", "block", F.last("end", ignorenulls=True).over(earlier_blocks).alias("carried"))
    within = full.select("model", "block", "tick", F.last("point", ignorenulls=True).over(in_block).alias("point"))
    point = F.coalesce("point", "carried")
    at = F.timestamp_micros(grid_start + F.col("tick") * F.lit(micros))
    return within.join(carried, ["model", "block"]).select(
        "tick", at.alias("at"), "model", point["batch_id"].alias("batch_id"), point["accuracy"].alias("accuracy")
    )


def last_points(series: DataFrame, n: int = POINTS, seed_zeros: bool = False) -> DataFrame:
    """The newest ``n`` points per model, ``seq`` counting up to 0 for the newest.

    With ``seed_zeros`` a shorter series is filled up at the front with zero points, so
    every model shows exactly ``n``. Spark cuts each partition to ``n`` rows per model
    before the shuffle.
    """
    newest_first = W.partitionBy("model").orderBy(F.col("batch_id").desc())
    ranked = series.withColumn("rank", F.row_number().over(newest_first)).where(F.col("rank") <= n)
    points = ranked.select((F.lit(1) - F.col("rank")).alias("seq"), "model", "batch_id", "accuracy")
    if not seed_zeros:
        return points
    seen = points.groupBy("model").agg(F.count("*").alias("seen"))
    missing = seen.where(F.col("seen") < n).select(
        F.explode(F.sequence(F.lit(1 - n), (-F.col("seen")).cast("int"))).alias("seq"),
        "model",
        F.lit(None).cast("bigint").alias("batch_id"),
        F.lit(0.0).alias("accuracy"),
    )
    return points.unionByName(missing)
