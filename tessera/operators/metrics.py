"""Metric queries: histograms, quantiles, rates, latency statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_buckets(low: float, high: float, n: int) -> list[float]:
    """Log-spaced bounds of two significant figures, without repeats."""
    def two(x: float) -> float:
        return float(f"{x:.1e}") if x else 0.0

    return sorted({two(low * (high / low) ** (i / (n - 1))) for i in range(n)} | {0.0})


def histogram(samples: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts by upper bound; the last is infinite.  One aggregation, a column for each bound, then unpivoted."""
    counts = [F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = samples.groupBy(*keys).agg(*counts, F.count(value).alias("b_all"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(math.inf).alias("le"), F.col("b_all").alias("n"))]
    return wide.select(*keys, F.inline(F.array(*rows)))


def histogram_quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Linear within the bucket that holds the quantile; in the infinite one its lower bound."""
    w = Window.partitionBy(*keys).orderBy("le")
    rows = hist.withColumn("p", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("t", q * F.max("n").over(Window.partitionBy(*keys)))
    at = rows.where((F.col("n") >= F.col("t")) & (F.col("p") < F.col("t")))
    value = F.when(F.col("le") == math.inf, F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("t") - F.col("p")) / (F.col("n") - F.col("p")))
    return at.select(*keys, value.alias("value"))


def rank_stats(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Percentiles by index n*q/100 of the sorted values (A6).  Equal values are counted before the shuffle that orders them."""
    counts = samples.groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    pick = lambda q: F.min(F.when(F.col("upto") > F.expr(f"n * {q} div 100"), F.col(value)))
    return run.groupBy(key).agg(F.max("n").alias("n"), *[pick(q).alias(f"p{q}") for q in (50, 95, 99)])


def increases(samples: DataFrame, series: list[str], at: str, value: str) -> DataFrame:
    """Of each sample of a counter what it has grown by since the one before; after a reset, which shows as a fall, what it stands at."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(at))
    grown = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return samples.withColumn("increase", grown)


def counter_rate(samples: DataFrame, series: list[str], ms: str, value: str, step_ms: int) -> DataFrame:
    """Increase a second of each series in each step, over resets."""
    grown = increases(samples, series, ms, value)
    return grown.groupBy(*series, F.expr(f"{ms} div {step_ms}").alias("step")).agg((F.sum("increase") / (step_ms / 1000)).alias("rate"))


def range_rate(samples: DataFrame, keys: list[str], ms: str, value: str, step_ms: int) -> DataFrame:
    """Increase a second in each step."""
    return samples.groupBy(*keys, F.expr(f"{ms} div {step_ms}").alias("step")).agg((F.sum(value) / (step_ms / 1000)).alias("rate"))


def mean_of_ratios(samples: DataFrame, series: str, key: str, value: str) -> DataFrame:
    """Each series' sum over count, then their plain mean."""
    return samples.groupBy(key, series).agg((F.sum(value) / F.count(value)).alias("r")).groupBy(key).agg(F.avg("r").alias("mean_ratio"), F.count("*").alias("series"))


def chunk_latency(chunks: DataFrame, key: str, ms: str, tokens: str, start: str) -> DataFrame:
    """Time from the request's start to its first chunk, and inter-token latency: gaps weighted by their chunk's tokens, the first left out."""
    gap = F.col(ms) - F.lag(ms).over(Window.partitionBy(key).orderBy(ms))
    rows = chunks.withColumn("gap", gap)
    itl = F.sum("gap") / F.sum(F.when(F.col("gap").isNotNull(), F.greatest(F.col(tokens), F.lit(1))))
    return rows.groupBy(key).agg(F.count("*").alias("chunks"), (F.min(ms) - F.min(start)).alias("ttft"), itl.alias("itl"))


def sliding_regression(samples: DataFrame, key: str, order: str, x: str, y: str, n: int) -> DataFrame:
    """Slope and intercept over the last n samples of a key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    return samples.select(key, order, F.regr_slope(y, x).over(w).alias("slope"), F.regr_intercept(y, x).over(w).alias("intercept"))


def pareto(points: DataFrame, key: str, x: str, y: str, maximise_x: bool = False, repeats: bool = False) -> DataFrame:
    """Frontier of each key.  Least x and most y, one of equal points (W14); or most of both, where equal points rule each other out."""
    counts = points.groupBy(key, x, y).agg(F.count("*").alias("_n"))
    order = [F.desc(x) if maximise_x else F.col(x), F.desc(y)]
    best = F.max(y).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    kept = counts.withColumn("_m", best).where((F.col("_m").isNull() | (F.col(y) > F.col("_m"))) & ((F.col("_n") == 1) if repeats else F.lit(True)))
    return kept.select(key, x, y)
