"""Streaming forms of the state folds: what workers hold and which requests are active."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def apply_events(stream: DataFrame, order: str = "at") -> DataFrame:
    """stream: worker, order, kind (stored, removed, cleared), block, parent.  A row for each change of what a worker holds: worker, at, block, held;
    and for each refused event: the same with held null (ST1, ST2, ST8, U4).

    A store whose parent the worker doesn't hold, or is the block itself, is refused; a removal of what isn't there too.  Events of a worker
    must come in order from micro-batch to micro-batch; one that isn't newer than the last (a repeat) is dropped.  State is a worker's blocks.
    """
    shape = f"worker long, {order} long, block long, held boolean"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blocks, last = state.get if state.exists else ([], -1)
        held, out = set(blocks), []
        rows = pd.concat(list(parts)).sort_values(order)
        for at, kind, block, parent in zip(rows[order], rows["kind"], rows["block"], rows["parent"], strict=True):
            if at <= last:
                continue
            last = int(at)
            if kind == "cleared":
                out += [(k[0], last, b, False) for b in sorted(held)]
                held.clear()
            elif kind == "stored":
                ok = (pd.isna(parent) or int(parent) in held) and (pd.isna(parent) or int(parent) != int(block))
                if not ok:
                    out.append((k[0], last, int(block), None))
                elif int(block) not in held:
                    held.add(int(block))
                    out.append((k[0], last, int(block), True))
            elif kind == "removed":
                if int(block) in held:
                    held.remove(int(block))
                    out.append((k[0], last, int(block), False))
                else:
                    out.append((k[0], last, int(block), None))
        state.update((sorted(held), last))
        frame = pd.DataFrame(out, columns=["worker", order, "block", "held"])
        yield frame.astype({"worker": "int64", order: "int64", "block": "int64", "held": "boolean"})

    return stream.groupBy("worker").applyInPandasWithState(step, shape, "blocks array<long>, last long", "append", GroupStateTimeout.NoTimeout)


def active_requests(stream: DataFrame, ts: str, late: str, stale_ms: int) -> DataFrame:
    """stream: worker, rid, kind (add, prefilled, free), tokens, ts.  A row for each change of a worker's load: worker, requests, tokens (ST11, ST12, ST13, ST15).

    A request that nothing has touched for stale_ms of event time counts as freed.  A second add of an active request is ignored.
    """
    shape = "worker long, requests long, tokens long, expired long"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rids, waiting, seen = map(list, state.get) if state.exists else ([], [], [])
        live = {r: [w, s] for r, w, s in zip(rids, waiting, seen, strict=True)}
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values([ts, "rid"])
            for rid, kind, tokens, at in zip(rows["rid"], rows["kind"], rows["tokens"], rows[ts], strict=True):
                ms = int(pd.Timestamp(at).timestamp() * 1000)
                if kind == "add":
                    live.setdefault(int(rid), [int(tokens), ms])
                elif kind == "free":
                    live.pop(int(rid), None)
                elif int(rid) in live:
                    live[int(rid)] = [0, ms]
        stale = [r for r, (_, s) in live.items() if s + stale_ms <= state.getCurrentWatermarkMs()]
        for r in stale:
            del live[r]
        state.update((list(live), [w for w, _ in live.values()], [s for _, s in live.values()]))
        if live:
            state.setTimeoutTimestamp(max(min(s for _, s in live.values()) + stale_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"worker": [k[0]], "requests": [len(live)], "tokens": [sum(w for w, _ in live.values())], "expired": [len(stale)]})

    held = "rids array<long>, waiting array<long>, seen array<long>"
    return stream.withWatermark(ts, late).groupBy("worker").applyInPandasWithState(step, shape, held, "append", GroupStateTimeout.EventTimeTimeout)
