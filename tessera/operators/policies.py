"""Points where a caller's own rule goes in: each takes a function of columns or tables, and has the usual ones by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix, sampling, selection, state

Selector = Callable[[DataFrame], DataFrame]

#: Of priced pairs (rid, worker, cost, tree) one worker each.
SELECTORS: dict[str, Selector] = {
    "cheapest": lambda costed: prefix.argmin(costed).select("rid", "worker"),
    "chance": lambda costed: sampling.argmax_random(costed.withColumn("score", -F.col("cost")), "rid", "score", "worker", 0).select("rid", "worker"),
}


def route(requests: DataFrame, overlap: DataFrame, load: DataFrame, selector: str | Selector = "cheapest", weight: float = 1.0) -> DataFrame:
    """rid, worker by a selector of one's own or a named one."""
    return (SELECTORS[selector] if isinstance(selector, str) else selector)(prefix.costs(requests, overlap, load, weight))


#: Matches of requests against an index: (index, asked) -> rid, worker, depth.
BACKENDS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"prefix": prefix.match, "blind": prefix.blind_match}


def find(index: DataFrame, asked: DataFrame, backend: str | Callable[[DataFrame, DataFrame], DataFrame] = "prefix") -> DataFrame:
    """(E2)"""
    return (BACKENDS[backend] if isinstance(backend, str) else backend)(index, asked)


#: Whether an event of a block at a position is told.
EMISSION: dict[str, Callable[[Column], Column]] = {"all": lambda _: F.lit(True), "powers": selection.position_class}


def emitted(events: DataFrame, position: str, policy: str | Callable[[Column], Column] = "all") -> DataFrame:
    """(E7, F9)"""
    return events.where((EMISSION[policy] if isinstance(policy, str) else policy)(F.col(position)))


def offloaded(touches: DataFrame, key: str, at: str, gate: Callable[[DataFrame], DataFrame] | None = None, tick: int = 1000, least: int = 2) -> DataFrame:
    """Keys that a gate lets through, by default the doubling count."""
    return gate(touches) if gate else state.frequency_gate(touches, key, at, tick, least).where("offload").select(key)




def _orders() -> dict[str, list[Column]]:
    """Which blocks go first, over columns block, inserted, touched, touches, children."""
    level = sum((F.col("touches") >= n).cast("int") for n in (2, 4, 8))
    return {
        "fifo": [F.col("inserted"), F.col("block")],
        "lru": [F.col("touched"), F.col("block")],
        "levels": [level, F.col("touched"), F.col("block")],
        "lineage": [(F.col("children") > 0).cast("int"), F.col("touched"), F.col("block")],
    }


def reuse(blocks: DataFrame, group: str, need: int, policy: str | list[Column] = "lru") -> DataFrame:
    """Of each group the blocks that give way when so many are needed; lineage gives leaves alone (O15).  Each task keeps no more than need of a group."""
    order = _orders()[policy] if isinstance(policy, str) else policy
    rows = blocks.where("children = 0") if policy == "lineage" else blocks
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= need).select(group, "block", "place")


def decayed(count: Column, ticks: Column, rule: str | Callable[[Column, Column], Column] = "halve") -> Column:
    """Counts after so many ticks: halved at each, or one less."""
    rules = {"halve": lambda c, t: F.floor(c / F.pow(F.lit(2.0), t)), "less": lambda c, t: F.greatest(F.lit(0), c - t)}
    return (rules[rule] if isinstance(rule, str) else rule)(count, ticks).cast("long")


def allocated(keys: DataFrame, key: str, workers: list[int], k: int, allocator: str | Callable[..., DataFrame] = "rendezvous") -> DataFrame:
    """Workers of each key: the highest hashes, or by chance."""
    named = {"rendezvous": lambda: prefix.rendezvous(keys, key, workers, k).select(key, "worker"), "random": lambda: sampling.replicas(keys.select(key).distinct(), key, workers, k, 0)}
    return named[allocator]() if isinstance(allocator, str) else allocator(keys, key, workers, k)


def processed(logits: Column, *steps: Callable[[Column], Column]) -> Column:
    """Scores of the next token through processors in order (E5)."""
    for step in steps:
        logits = step(logits)
    return logits


def temperature(t: float) -> Callable[[Column], Column]:
    """Divide by a temperature over 0."""
    if t <= 0:
        raise ValueError("a temperature is over 0")
    return lambda logits: F.transform(logits, lambda x: x / t)


def direct(requests: DataFrame, workers: DataFrame, wanted: str) -> DataFrame:
    """Requests to the worker that they name; null where that isn't there."""
    there = workers.select(F.col("worker").alias("_w")).distinct()
    return requests.join(there, F.col(wanted) == F.col("_w"), "left").withColumn("worker", F.col("_w")).drop("_w")


def preempted(running: DataFrame, group: str, at: str, size: str, need: str) -> DataFrame:
    """Of each group the oldest requests whose sizes together free what is needed (O20): running sums up to the one that reaches it."""
    w = Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    return running.withColumn("_b", before).where(F.col("_b") < F.col(need)).drop("_b")
