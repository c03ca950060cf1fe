"""State after events: what workers hold, which requests are active, what they weigh.

Batch forms fold a finite log without ordering it: of each key the last event decides, so that one aggregation by key
is enough and a worker of most events is many groups.  ``tessera.streaming.state`` has the streaming forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index(events: DataFrame) -> DataFrame:
    """events: worker, at, kind (stored, removed, cleared), block.  worker, block: what each worker holds after all of them (ST1, ST2, ST4, ST5)."""
    clears = events.where("kind = 'cleared'").groupBy("worker").agg(F.max("at").alias("cleared_at"))
    # workers are few beside their events; Spark picks how to join
    live = events.where("kind in ('stored', 'removed')").join(clears, "worker", "left").where("cleared_at is null or at > cleared_at")
    last = live.groupBy("worker", "block").agg(F.max_by("kind", "at").alias("kind"))
    return last.where("kind = 'stored'").select("worker", "block")


def without_workers(held: DataFrame, gone: DataFrame) -> DataFrame:
    """What is held without the workers that have left (ST3)."""
    return held.join(gone.select("worker").distinct(), "worker", "left_anti")


def chains(events: DataFrame) -> DataFrame:
    """Store events that name a block twice, or their parent, are refused whole (U4).  events: event, parent, blocks (array)."""
    twice = F.size(F.array_distinct("blocks")) < F.size("blocks")
    own = F.coalesce(F.array_contains("blocks", F.col("parent")), F.lit(False))
    return events.where(~twice & ~own)


def register(blocks: DataFrame, key: str, order: str, duplicates: str) -> DataFrame:
    """Registration of blocks by hash: allow keeps all, reject the first of each."""
    if duplicates == "allow":
        return blocks
    first = blocks.groupBy(key).agg(F.min(order).alias("_first"))
    return blocks.join(first, key).where(F.col(order) == F.col("_first")).drop("_first")


def canonical(stores: DataFrame) -> DataFrame:
    """stores: source, external (hash), parent (external), sequence (hash), at.  The same with first (external hash that first named the sequence)
    and parent_sequence (J18): two joins by hash, none by position."""
    first = stores.groupBy("sequence").agg(F.min_by("external", F.struct("at", "source")).alias("first"))
    known = stores.groupBy("source", F.col("external").alias("parent")).agg(F.max_by("sequence", "at").alias("parent_sequence"))
    return stores.join(first, "sequence").join(known, ["source", "parent"], "left")


def active(requests: DataFrame) -> DataFrame:
    """requests: worker, rid, added, prefilled, freed (booleans).  Those that count: added and not freed; waiting if not prefilled (ST11, ST12, ST13)."""
    return requests.where("added and not freed").select("worker", "rid", (~F.col("prefilled")).alias("waiting"))


def expire(requests: DataFrame, touched: str, now: Column, most_ms: int) -> DataFrame:
    """Requests that nobody has touched for longer count as freed (ST15)."""
    return requests.withColumn("freed", F.col("freed") | (now - F.col(touched) > most_ms))


def load(now: DataFrame, blocks: DataFrame, prompts: DataFrame, block_size: int, share: Column | None = None) -> DataFrame:
    """Of each worker: requests, blocks in use (shared ones once, A27) and tokens still to prefill.

    now: as ``active`` gives it; blocks: rid, hash; prompts: rid, isl, overlap (cached blocks).  share: of rid's columns in now, how
    much a block that one request alone holds counts (ST14); None for 1.
    """
    held = now.join(blocks, "rid").groupBy("worker", "hash").agg(F.countDistinct("rid").alias("n"), F.max(F.lit(1.0) if share is None else share).alias("share"))
    used = held.groupBy("worker").agg(F.round(F.sum(F.when(F.col("n") == 1, F.col("share")).otherwise(1.0))).cast("long").alias("blocks"))
    new = F.greatest(F.lit(0), F.col("isl") - F.col("overlap") * block_size)
    waiting = now.join(prompts, "rid").groupBy("worker").agg(F.count("*").alias("requests"), F.sum(F.when(F.col("waiting"), new).otherwise(0)).alias("tokens"))
    return waiting.join(used, "worker", "left").select("worker", "requests", F.coalesce("blocks", F.lit(0)).alias("blocks"), "tokens")


def potential(loads: DataFrame, held: DataFrame, asked: DataFrame, block_size: int) -> DataFrame:
    """What each worker's load would be with each asked request (A28).  loads: worker, blocks, tokens; held: worker, hash; asked: rid, isl, hashes (array), overlap.

    A request's blocks that the worker has are found by one join on hash, so no request meets a worker's whole state.
    """
    each = asked.select("rid", F.explode(F.array_distinct("hashes")).alias("hash"))
    common_ = each.join(held.distinct(), "hash").groupBy("rid", "worker").agg(F.count("*").alias("shared"))
    pairs = asked.select("rid", "isl", "overlap", F.size(F.array_distinct("hashes")).alias("n")).crossJoin(F.broadcast(few(loads)))
    full = pairs.join(common_, ["rid", "worker"], "left")
    new = F.greatest(F.lit(0), F.col("isl") - F.col("overlap") * block_size)
    return full.select("rid", "worker", (F.col("blocks") + F.col("n") - F.coalesce("shared", F.lit(0))).alias("blocks"), (F.col("tokens") + new).alias("tokens"))


MOST_WORKERS = 100_000


def few(workers: DataFrame) -> DataFrame:
    """A table of a row for each worker, refused if it is longer than any cluster of them."""
    if workers.limit(MOST_WORKERS + 1).count() > MOST_WORKERS:
        raise ValueError(f"more than {MOST_WORKERS} workers")
    return workers


def adapter_load(events: DataFrame, adapter: str) -> DataFrame:
    """Active requests of each adapter: those added, less those freed, prefills don't count; the rest without an adapter is left out (A29, ST31)."""
    step = F.when(F.col("kind") == "add", 1).when(F.col("kind") == "free", -1).otherwise(0)
    return events.where(F.col(adapter).isNotNull()).groupBy(adapter).agg(F.sum(step).alias("active"))


def load_series(snapshots: DataFrame, most: int) -> DataFrame:
    """snapshots: tick, key, count.  Of each key the last samples, 0 for a tick it is missing from after its first."""
    ticks = snapshots.select("tick").distinct()
    first = snapshots.groupBy("key").agg(F.min("tick").alias("since"))
    wanted = first.join(ticks, ticks["tick"] >= first["since"]).select("key", "tick")
    full = wanted.join(snapshots, ["key", "tick"], "left").select("key", "tick", F.coalesce("count", F.lit(0)).alias("count"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("tick")))
    return full.withColumn("place", place).where(F.col("place") <= most).select("key", "tick", "count")


def frequency_gate(touches: DataFrame, key: str, at: str, tick: int, least: int, most: int = 1 << 40) -> DataFrame:
    """Counts that double with each touch from 1 and lose one with each tick; whether the last touch reaches least.

    A key at 0 is forgotten.  A fold over a key's touches in order: the doubling is bounded, so long histories stay numbers.
    """
    ordered = touches.groupBy(key).agg(F.sort_array(F.collect_list(F.col(at))).alias("ts"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("t"))

    def step(acc, t):
        lost = F.coalesce(F.floor(t / tick) - F.floor(acc["t"] / tick), F.lit(0))
        left = F.greatest(F.lit(0), acc["n"] - lost)
        return F.struct(F.when(left > 0, F.least(left * 2, F.lit(most))).otherwise(F.lit(1)).cast("long").alias("n"), t.cast("long").alias("t"))

    return ordered.select(key, F.aggregate("ts", zero, step)["n"].alias("count")).withColumn("offload", F.col("count") >= least)


def in_range(buffer: DataFrame, start: Column, end: Column, asked: DataFrame, at: str) -> DataFrame:
    """Each asked range of event ids against a buffer: outcome events (with their number), tree_dump, too_new or invalid_range."""
    span = buffer.agg(F.min(at).alias("first"), F.max(at).alias("last"))
    rows = asked.crossJoin(F.broadcast(span))
    outcome = (
        F.when(start.isNotNull() & end.isNotNull() & (end < start), "invalid_range")
        .when(start.isNull() | F.col("first").isNull(), "tree_dump")
        .when(start > F.col("last"), "too_new")
        .when(start < F.col("first"), "tree_dump")
        .otherwise("events")
    )
    return rows.select(*asked.columns, outcome.alias("outcome"), F.when(outcome == "events", start).alias("begin"), F.when(outcome == "events", F.least(F.coalesce(end, F.col("last")), F.col("last"))).alias("stop"))
