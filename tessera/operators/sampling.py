"""Reproducible draws: each is a hash of a seed and a row's key, so that tasks and runs agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column) -> Column:
    """In [0, 1), of 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / float(1 << 53)


def partition(rows: DataFrame, key: str, parts: int, seed: int) -> DataFrame:
    """Each key's rows to one of the parts."""
    return rows.withColumn("part", F.floor(uniform(seed, F.col(key)) * parts).cast("int"))


def tiers(rows: DataFrame, key: str, shares: list[float], seed: int) -> DataFrame:
    """Each key to a tier by a distribution."""
    u, out, run = uniform(seed, F.col(key)) * sum(shares), F.lit(len(shares) - 1), sum(shares)
    for i in range(len(shares) - 1, 0, -1):
        run -= shares[i]
        out = F.when(u < run, i - 1).otherwise(out)
    return rows.withColumn("tier", out)


def replicas(keys: DataFrame, key: str, workers: list[int], k: int, seed: int) -> DataFrame:
    """k random workers of each key, all different."""
    order = F.array_sort(F.transform(F.array(*map(F.lit, workers)), lambda w: F.struct(F.xxhash64(F.lit(seed), F.col(key), w).alias("h"), w.alias("w"))))
    return keys.select(key, F.explode(F.slice(order, 1, min(k, len(workers)))).alias("x")).select(key, F.col("x.w").alias("worker"))


def argmax_random(scores: DataFrame, key: str, score: str, worker: str, seed: int) -> DataFrame:
    """The worker of the largest score, one of equals by chance."""
    best = F.max(F.struct(F.col(score), F.xxhash64(F.lit(seed), F.col(key), F.col(worker)), F.col(worker))).alias("b")
    return scores.groupBy(key).agg(best).select(key, F.col(f"b.{worker}").alias(worker), F.col(f"b.{score}").alias(score))


def from_cdf(rows: DataFrame, key: str, values: list, cdf: list[float], seed: int) -> DataFrame:
    """A value for each row: the first whose cumulative share reaches a draw."""
    u = uniform(seed, F.col(key)) * cdf[-1]
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cdf]), lambda c: c < u))
    return rows.withColumn("value", F.get(F.array(*map(F.lit, values)), at))


def offset_ids(blocks: DataFrame, by: int) -> DataFrame:
    """Hashes that a second run can't meet."""
    return blocks.withColumn("hash", F.col("hash") + by)


def delays(rows: DataFrame, key: str, mean_ms: float, seed: int) -> DataFrame:
    """Exponential delays."""
    return rows.withColumn("delay", -mean_ms * F.log(1 - uniform(seed, F.col(key))))


def sinusoid(seconds: Column, low: float, high: float, period: float) -> Column:
    """A rate between two bounds, from the lower one."""
    return (low + high) / 2 - (high - low) / 2 * F.cos(seconds * (2 * math.pi / period))


def poisson(mean: Column, seed: int, *key: Column, most: int = 1000) -> Column:
    """A count by inverting the distribution at one draw (M11); by its normal form for means over 100."""
    u = uniform(seed, *key)
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"), F.lit(False).alias("done"))

    def step(a, i):
        stop = a["done"] | (a["c"] >= u)
        p = a["p"] * mean / i
        return F.when(stop, F.struct(a["p"].alias("p"), a["c"].alias("c"), a["k"].alias("k"), F.lit(True).alias("done"))).otherwise(F.struct(p.alias("p"), (a["c"] + p).alias("c"), i.alias("k"), F.lit(False).alias("done")))

    exact = F.aggregate(F.sequence(F.lit(1), F.lit(min(most, 300))), first, step)["k"]
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * uniform(seed + 1, *key))
    return F.when(mean <= 100, exact).otherwise(F.greatest(F.lit(0), F.round(mean + F.sqrt(mean) * z)).cast("int"))


def sequences(spark, number: int, depth: int, groups: int, prefix_share: float, seed: int) -> DataFrame:
    """rid, pos, hash: sequences whose first part is one of a few groups' (M27)."""
    rows = spark.range(number).select(F.col("id").alias("rid"), F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("pos"))
    group = F.floor(uniform(seed, F.col("rid")) * groups)
    return rows.withColumn("hash", F.when(F.col("pos") < math.floor(depth * prefix_share), F.xxhash64(F.lit(seed), group, "pos")).otherwise(F.xxhash64(F.lit(seed + 1), "rid", "pos")))
