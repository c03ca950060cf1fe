"""Ordering and choice: queues, eviction policies, assignment, configuration choice, frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue_order(requests: DataFrame, group: str, arrival: Column, jump: Column, tie: str) -> DataFrame:
    """Place in the queue by effective arrival = arrival - jump, at least 0 (O3)."""
    e = F.greatest(arrival - jump, F.lit(0))
    return requests.withColumn("effective", e).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("effective", tie)))


def offload_order(requests: DataFrame, group: str, priority: str, age: str) -> DataFrame:
    """Higher priority first, then older."""
    return requests.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(priority), age)))


def frequency_levels(touches: DataFrame, keys: list[str], at: str, steps: tuple[int, int, int] = (2, 4, 8)) -> DataFrame:
    """Four levels by how often a block is touched, least recent first within each."""
    per = touches.groupBy(*keys).agg(F.count("*").alias("touches"), F.max(at).alias("last"))
    level = sum((F.when(F.col("touches") >= s, 1).otherwise(0) for s in steps), F.lit(0))
    return per.withColumn("level", level).withColumn("place", F.row_number().over(Window.partitionBy(keys[0], "level").orderBy("last")))


def prune(entries: DataFrame, group: str, expiry: str, most: int, ratio: float) -> DataFrame:
    """Where a group has more than most entries, what stays after dropping the earliest expiries down to ratio * most."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    late = F.row_number().over(w.orderBy(F.desc(expiry)))
    return entries.withColumn("_n", n).withColumn("_k", late).where((F.col("_n") <= most) | (F.col("_k") <= int(ratio * most))).drop("_n", "_k")


def round_robin(requests: DataFrame, group: str, order: str, workers: int) -> DataFrame:
    """Requests of a group in turn to each worker."""
    return requests.withColumn("worker", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) % workers)


def score(overlap: Column, usage: Column, waiting: Column, most_waiting: Column) -> Column:
    """2 * overlap - usage - waiting share; higher wins."""
    return 2 * overlap - usage - F.when(most_waiting > 0, waiting / most_waiting).otherwise(F.lit(0.0))


def choose(configs: DataFrame, group: str, latency: str, throughput: str, sla: float) -> DataFrame:
    """Of the configurations within the SLA the fastest, else that of least latency."""
    ok = F.max(F.when(F.col(latency) <= sla, F.struct(throughput, latency))).alias("a")
    return configs.groupBy(group).agg(ok, F.min(F.struct(latency, throughput)).alias("b")).select(group, F.coalesce(F.col(f"a.{latency}"), F.col(f"b.{latency}")).alias(latency), F.coalesce(F.col(f"a.{throughput}"), F.col(f"b.{throughput}")).alias(throughput))


def last_sources(reports: DataFrame, block: str, source: str, order: str) -> DataFrame:
    """When the last source of a block reported it: only then may it be removed."""
    per = reports.groupBy(block, source).agg(F.max(order).alias("last"))
    return per.groupBy(block).agg(F.max("last").alias("removed_at"), F.count("*").alias("sources"))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals of a key that share a point (J30).  left: start, stop; right: b_start, b_stop.

    Both are dealt to buckets of the given width; a pair is kept in the bucket of its common start alone, so none is found twice.
    """
    spread = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {width}"), F.expr(f"({b} - 1) div {width}"))).alias("_bucket")
    p = left.where("start < stop").select("*", spread("start", "stop"))
    q = right.where("b_start < b_stop").select("*", spread("b_start", "b_stop"))
    both = p.join(q, [key, "_bucket"])
    return both.where(f"b_stop > start and b_start < stop and greatest(start, b_start) div {width} = _bucket").drop("_bucket")


def nearest_cell(x: Column, low: float, high: float, cells: int) -> Column:
    """Cell of a uniform grid, truncated and clamped."""
    return F.least(F.greatest(((x - low) / (high - low) * cells).cast("int"), F.lit(0)), F.lit(cells - 1))


def position_class(pos: Column) -> Column:
    """Powers of two from 16 to 65536 (F8)."""
    return pos.between(16, 65_536) & (pos.bitwiseAND(pos - 1) == 0)
