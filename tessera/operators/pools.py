"""Match variants over pools of blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import prefix


def leading(held: DataFrame, asked: DataFrame) -> DataFrame:
    """held: hash; asked: rid, pos, hash.  Depth of the leading run of each request that is held: up to its first miss."""
    marked = asked.join(held.select("hash").distinct().withColumn("_h", F.lit(True)), "hash", "left")
    runs = marked.groupBy("rid").agg(F.min(F.when(F.col("_h").isNull(), F.col("pos"))).alias("miss"), F.count("*").alias("n"))
    return runs.select("rid", F.coalesce("miss", "n").alias("depth"))


def pool_match(active: DataFrame, inactive: DataFrame, asked: DataFrame) -> DataFrame:
    """A run that goes on in the inactive pool where the active one lacks a block."""
    return leading(active.select("hash").unionByName(inactive.select("hash")), asked)


def scan(active: DataFrame, inactive: DataFrame, asked: DataFrame) -> DataFrame:
    """Every asked hash that a pool has, no stop at a miss; active ones first."""
    pools = active.select("hash", F.lit(0).alias("pool")).unionByName(inactive.select("hash", F.lit(1).alias("pool")))
    return asked.select("hash").distinct().join(pools.groupBy("hash").agg(F.min("pool").alias("pool")), "hash").select("hash", F.when(F.col("pool") == 0, "active").otherwise("inactive").alias("pool"))


def presence_any(registry: DataFrame, asked: DataFrame, kinds: list[str]) -> DataFrame:
    """registry: hash, kind.  Whether an asked hash is there as any of the kinds."""
    return prefix.presence(registry.where(F.col("kind").isin(*kinds)), asked)


def drain(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Where each worker leaves a request: the place of its first missing prefix, for workers that have its first."""
    n = asked.groupBy("rid").agg(F.count("*").alias("n"))
    depth = prefix.match(index, asked).join(n, "rid")
    return depth.select("rid", "worker", F.col("depth").alias("leaves_at"), (F.col("depth") == F.col("n")).alias("whole"))


def early_exit(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Depths cut where one worker remains: at the second largest, so that the best alone may be deeper than its score."""
    depth = prefix.match(index, asked)
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("depth"), "worker"))
    two = depth.withColumn("k", place).where("k <= 2").groupBy("rid").agg(F.max("depth").alias("a"), F.max(F.when(F.col("k") == 2, F.col("depth"))).alias("b"))
    cut = two.select("rid", F.when(F.col("b").isNull(), 1).otherwise(F.least("a", F.col("b") + 1)).alias("most"))
    return depth.join(cut, "rid").select("rid", "worker", F.least("depth", "most").alias("depth"))


def sharded(shards: list[DataFrame], asked: DataFrame) -> DataFrame:
    """Each shard's workers matched alone, merged (J8).  A worker stands in one shard."""
    return reduce(DataFrame.unionByName, [prefix.match(s, asked) for s in shards])


def frequencies(shards: list[DataFrame], asked: DataFrame) -> DataFrame:
    """How many workers hold each place of a request, summed over shards."""
    held = [s.select("worker", "path").distinct().join(asked, "path").groupBy("rid", "pos").agg(F.count("*").alias("n")) for s in shards]
    return reduce(DataFrame.unionByName, held).groupBy("rid", "pos").agg(F.sum("n").alias("n"))


def for_all(workers: DataFrame, scores: DataFrame, asked: DataFrame, few) -> DataFrame:
    """A row for each request and worker, 0 where nothing matches."""
    pairs = asked.select("rid").distinct().crossJoin(F.broadcast(few(workers.select("worker").distinct())))
    return pairs.join(scores, ["rid", "worker"], "left").select("rid", "worker", F.coalesce("depth", F.lit(0)).alias("depth"))


def prefill_cost(held: DataFrame, asked: DataFrame, prompts: DataFrame, block_size: int) -> DataFrame:
    """Of each request the blocks and tokens that its longest cached prefix leaves (J15, J16); prompts: rid, isl."""
    n = asked.groupBy("rid").agg(F.count("*").alias("n"))
    rows = leading(held, asked).join(n, "rid").join(prompts, "rid")
    cached = F.least(F.col("depth") * block_size, F.col("isl"))
    return rows.select("rid", (F.col("n") - F.col("depth")).alias("new_blocks"), (F.col("isl") - cached).alias("new_tokens"))
