"""Trace analytics: prefix sharing, theoretical hits, lengths, rates and synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_counts(blocks: DataFrame) -> DataFrame:
    """How many requests have a block at a position (A1)."""
    return blocks.groupBy("pos", "hash").agg(F.count("*").alias("n"))


def context_lengths(blocks: DataFrame, requests: DataFrame, block: int) -> DataFrame:
    """Tokens of each request that others share at the same positions, and its own (A2)."""
    shared = blocks.join(hash_counts(blocks), ["pos", "hash"])
    per = shared.groupBy("rid").agg(F.count("*").alias("blocks"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"))
    context = F.when(F.col("repeated") == F.col("blocks"), F.col("input_length")).otherwise(F.col("repeated") * block)
    return per.join(requests.select("rid", "input_length"), "rid").select("rid", context.cast("long").alias("context_length"), (F.col("input_length") - context).cast("long").alias("unique_length"))


def hit_rates(blocks: DataFrame) -> DataFrame:
    """Share of each request's blocks before the first that no earlier request had (W1), by any position.

    The first request of each hash is a partial aggregate joined back, not a window, so that a common hash is no task of its own.
    """
    first = blocks.groupBy("hash").agg(F.min("rid").alias("first_rid"))
    per = blocks.join(first, "hash").groupBy("rid").agg(F.count("*").alias("blocks"), F.min(F.when(F.col("first_rid") == F.col("rid"), F.col("pos"))).alias("first_new"))
    return per.select("rid", "blocks", (F.coalesce("first_new", "blocks") / F.col("blocks")).alias("hit_rate"))


def summary(rows: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation and linear percentiles (A3)."""
    c = F.col(column)
    q = F.percentile(c, [0.25, 0.5, 0.75])
    return rows.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("least"), q.alias("q"), F.max(c).alias("most")).select(
        "mean", "std", "least", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "most"
    )


def trace_stats(requests: DataFrame) -> DataFrame:
    """Lengths (sample deviation) and requests a second (A4)."""
    both = F.col("input_length") + F.col("output_length")
    cols = [f(c).cast("double").alias(f"{n}_{c}") for c in ("input_length", "output_length") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_samp))]
    span = (F.max("ts") - F.min("ts")) / 1000
    return requests.agg(*cols, F.max(both).alias("max_total"), F.count("*").alias("requests"), (F.count("*") / span).alias("rps"))


def interval_load(requests: DataFrame, step_ms: int) -> DataFrame:
    """Requests and mean lengths of each interval aligned to the epoch; empty intervals are left out (A5)."""
    return requests.groupBy(F.expr(f"ts div {step_ms}").alias("interval")).agg(F.count("*").alias("num_req"), F.avg("input_length").alias("isl"), F.avg("output_length").alias("osl"))


def rate_bins(requests: DataFrame, bins: int = 20) -> DataFrame:
    """Requests in equal bins between the first and last timestamp (W18).  Only two numbers are broadcast."""
    ends = requests.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("ts") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))))
    return requests.crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def rescale(requests: DataFrame, speed: float) -> DataFrame:
    """Timestamps from 0, divided by the speed ratio."""
    start = requests.agg(F.min("ts").alias("_lo"))
    return requests.crossJoin(F.broadcast(start)).withColumn("ts", F.floor((F.col("ts") - F.col("_lo")) / speed).cast("long")).drop("_lo")


def bound_lengths(requests: DataFrame, isl: tuple[int, int], osl: tuple[int, int]) -> DataFrame:
    """Input lengths are filtered, output lengths clipped."""
    return requests.where(F.col("input_length").between(*isl)).withColumn("output_length", F.least(F.greatest("output_length", F.lit(osl[0])), F.lit(osl[1])))


def take_part(requests: DataFrame, order: str, skip: int, n: int, where: str | None = None) -> DataFrame:
    """Filter, then skip, then head (F1)."""
    rows = requests.where(where) if where else requests
    return rows.orderBy(order).offset(skip).limit(n)


def expand(blocks: DataFrame, factor: int) -> DataFrame:
    """Each block becomes factor blocks h*f .. h*f+f-1."""
    each = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("k")
    return blocks.select("rid", "pos", "hash", each).select("rid", (F.col("pos") * factor + F.col("k")).alias("pos"), (F.col("hash") * factor + F.col("k")).alias("hash"))


def duplicate(blocks: DataFrame, copies: int) -> DataFrame:
    """Copies of the trace whose hashes don't meet: hash + (max+1) * copy."""
    top = blocks.agg((F.max("hash") + 1).alias("_top"))
    each = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    return blocks.crossJoin(F.broadcast(top)).select("rid", "pos", "hash", "_top", each).select("rid", "copy", "pos", (F.col("hash") + F.col("_top") * F.col("copy")).alias("hash"))


def normalise(blocks: DataFrame) -> DataFrame:
    """Prefix paths as keys, shared by equal prefixes (H16): rid, pos, path, parent."""
    whole = blocks.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("b"))
    paths = F.aggregate("b", F.array().cast("array<string>"), lambda a, x: F.array_append(a, F.md5(F.concat(F.coalesce(F.get(a, F.size(a) - 1), F.lit("")), F.lit("/"), x["hash"].cast("string")))))
    return whole.select("rid", F.posexplode(paths).alias("pos", "path")).withColumn("pos", F.col("pos").cast("long"))


def tree_edges(paths: DataFrame) -> DataFrame:
    """Nodes of the prefix tree with their parents and visits (G)."""
    up = F.lag("path").over(Window.partitionBy("rid").orderBy("pos"))
    return paths.withColumn("parent", F.coalesce(up, F.lit("root"))).groupBy("parent", "path", "pos").agg(F.count("*").alias("visited"))


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes without children."""
    return edges.join(edges.select(F.col("parent").alias("path")).distinct(), "path", "left_anti")


def transition_cdf(blocks: DataFrame) -> DataFrame:
    """Cumulative share of each next block, in order of its hash."""
    nxt = F.lead("hash").over(Window.partitionBy("rid").orderBy("pos"))
    counts = blocks.withColumn("next", nxt).where("next is not null").groupBy("hash", "next").agg(F.count("*").alias("n"))
    w = Window.partitionBy("hash")
    run = F.sum("n").over(w.orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("hash", "next", (run / F.sum("n").over(w)).alias("cdf"))
