"""Streaming twins of the event folds: tumbling load, batcher, first sources, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def interval_load(stream: DataFrame, ts: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Count and sum in tumbling windows; a window is final once the watermark passes it (A5, ST)."""
    marked = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return marked.select(F.col("window.start").alias("start"), *keys, "n", "total")


def first_sources(stream: DataFrame, ts: str, block: list[str], late: str) -> DataFrame:
    """The first report of each block; state older than the watermark goes."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(block)


def batches(stream: DataFrame, key: str, order: str, most: int, window_ms: int = 1000) -> DataFrame:
    """Runs of one kind of a key, cut at most events, given out when they close, or when the key has been quiet for window_ms (ST10).

    Events of a key must come in order of the order column from micro-batch to micro-batch;
    within one they are sorted here.  State is the open batch alone.
    """
    shape = f"{key} long, kind string, events long, first_event long"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, n, first = state.get if state.exists else (None, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], kind, n, first)], columns=[key, "kind", "events", "first_event"])
            return
        out = []
        rows = pd.concat(list(parts)).sort_values(order)
        for now, number in zip(rows["kind"], rows[order], strict=True):
            if n and (now != kind or n == most):
                out.append((k[0], kind, n, first))
                n = 0
            if not n:
                kind, first = now, int(number)
            n += 1
        state.update((kind, n, first))
        state.setTimeoutDuration(window_ms)
        yield pd.DataFrame(out, columns=[key, "kind", "events", "first_event"])

    return stream.groupBy(key).applyInPandasWithState(step, shape, "kind string, n long, first long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def expiring(stream: DataFrame, key: str, ts: str, ttl_ms: int, late: str) -> DataFrame:
    """A row for each key that nothing has touched for ttl of event time (ST, O16)."""
    shape = f"{key} long, last timestamp, touches long"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last": [last], "touches": [n]})
            return
        last, n = state.get if state.exists else (None, 0)
        for rows in parts:
            n += len(rows)
            top = rows[ts].max()
            last = top if last is None else max(pd.Timestamp(last), top)
        state.update((pd.Timestamp(last).to_pydatetime(), n))
        until = int(pd.Timestamp(last).timestamp() * 1000) + ttl_ms
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [], "last": [], "touches": []}).astype({key: "int64", "last": "datetime64[ns]", "touches": "int64"})

    return stream.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, shape, "last timestamp, n long", "append", GroupStateTimeout.EventTimeTimeout)
