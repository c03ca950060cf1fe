"""Folds of ordered events: latest state, gaps, batches and first sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct("kind", "block"), order).alias("x"), F.max(order).alias(order)).select(key, order, "x.kind", "x.block")


def gaps(events: DataFrame, key: str, sequence: str) -> DataFrame:
    """Ranges of numbers that a key's sequence leaves out."""
    before = F.lag(sequence).over(Window.partitionBy(key).orderBy(sequence))
    return events.withColumn("_b", before).where(F.col(sequence) > F.col("_b") + 1).select(key, (F.col("_b") + 1).alias("first_missing"), (F.col(sequence) - 1).alias("last_missing"))


def batches(events: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Runs of one kind, cut at most events (ST10)."""
    w = Window.partitionBy(key).orderBy(order)
    runs = events.withColumn("_new", F.when(F.lag("kind").over(w) == F.col("kind"), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.expr(f"(row_number() over (partition by {key}, run order by {order}) - 1) div {most}")
    return runs.withColumn("part", part).groupBy(key, "run", "part", "kind").agg(F.count("*").alias("events"), F.min(order).alias("first_event"))


def first_sources(events: DataFrame, block: str, order: str) -> DataFrame:
    """Of a block that several sources report, the first report."""
    return events.groupBy(block).agg(F.min_by("worker", order).alias("worker"), F.min(order).alias(order), F.countDistinct("worker").alias("sources"))
