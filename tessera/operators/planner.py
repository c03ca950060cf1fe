"""Planner arithmetic: interpolation, replicas, budgets, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interpolate(x: Column, grid: list[tuple[float, float]]) -> Column:
    """Piecewise linear over a small grid, clamped at its ends (P5)."""
    grid = sorted(grid)
    out = F.lit(float(grid[0][1]))
    for (x0, y0), (x1, y1) in zip(grid, grid[1:], strict=False):
        out = F.when(x > x0, F.lit(float(y0)) + (F.least(x, F.lit(float(x1))) - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return out


def cubic(x: Column, grid: list[tuple[float, float]]) -> Column:
    """Cubic spline through a small grid (not-a-knot ends), the input clamped to it (M3, M4); linear through fewer than four points."""
    grid = sorted(grid)
    if len(grid) < 4:
        return interpolate(x, grid)
    pieces = spline(grid)
    at = F.greatest(F.least(x, F.lit(float(grid[-1][0]))), F.lit(float(grid[0][0])))
    out = None
    for x0, c in reversed(pieces):
        t = at - F.lit(x0)
        y = F.lit(c[0]) + t * (F.lit(c[1]) + t * (F.lit(c[2]) + t * F.lit(c[3])))
        out = y if out is None else F.when(at < F.lit(following), y).otherwise(out)
        following = x0
    return out


def spline(grid: list[tuple[float, float]]) -> list[tuple[float, list[float]]]:
    """For each stretch of the grid its begin and the four coefficients of its cubic, solved for equal first and second
    derivatives at inner points and equal third ones at the second and the last but one."""
    import numpy as np

    x, y = np.array(sorted(grid), float).T
    n, h = len(x) - 1, np.diff(x)
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for i in range(n):
        powers = h[i] ** np.arange(4)
        a[row, 4 * i], b[row] = 1, y[i]
        a[row + 1, 4 * i : 4 * i + 4], b[row + 1] = powers, y[i + 1]
        row += 2
        if i + 1 < n:
            a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 5] = [0, 1, 2 * h[i], 3 * h[i] ** 2], -1
            a[row + 1, 4 * i : 4 * i + 4], a[row + 1, 4 * i + 6] = [0, 0, 2, 6 * h[i]], -2
            row += 2
    a[row, 3], a[row, 7] = 1, -1
    a[row + 1, 4 * n - 5], a[row + 1, 4 * n - 1] = 1, -1
    c = np.linalg.solve(a, b).reshape(n, 4)
    return [(float(x[i]), [float(v) for v in c[i]]) for i in range(n)]


def replicas(load: DataFrame, interval_s: float, prefill_tps: float, decode_tps: float, correction: float, prefill_gpus: int, decode_gpus: int | None = None) -> DataFrame:
    """Prefill and decode replicas that the interval's load needs; throughputs are of one GPU (M6, M7)."""
    p = F.ceil(F.col("num_req") * F.col("isl") / interval_s * min(1.0, correction) / prefill_tps / prefill_gpus)
    d = F.ceil(F.col("num_req") * F.col("osl") / interval_s / decode_tps / (decode_gpus or prefill_gpus))
    return load.withColumn("prefill", F.greatest(p, F.lit(1)).cast("long")).withColumn("decode", F.greatest(d, F.lit(1)).cast("long"))


def budget(plan: DataFrame, most: int, prefill_gpus: int, decode_gpus: int) -> DataFrame:
    """Scale both down in proportion if they need more GPUs than there are, prefill first, each at least one (M9)."""
    need = F.col("prefill") * prefill_gpus + F.col("decode") * decode_gpus
    scale = F.lit(float(most)) / need
    p = F.greatest(F.lit(1), F.least(F.expr(f"({most} - {decode_gpus}) div {prefill_gpus}"), F.floor(F.col("prefill") * scale)))
    d = F.greatest(F.lit(1), F.floor((F.lit(most) - p * prefill_gpus) / decode_gpus))
    over = need > most
    kept = [c for c in plan.columns if c not in ("prefill", "decode")]
    return plan.select(*kept, F.when(over, p).otherwise(F.col("prefill")).cast("long").alias("prefill"), F.when(over, d).otherwise(F.col("decode")).cast("long").alias("decode"))


def votes(loads: DataFrame, group: str, load: str, low: float, high: float) -> DataFrame:
    """up if all workers are over high, down if all are under low, else keep."""
    up, down = F.bool_and(F.col(load) > high), F.bool_and(F.col(load) < low)
    return loads.groupBy(group).agg(F.when(up, "up").when(down, "down").otherwise("keep").alias("vote"))


def component_budget(desired: Column, gpus: int, most: int, least: int = 1) -> Column:
    """Replicas of one component within a budget of GPUs: all if it is negative or enough, none if not enough for the least."""
    if most < 0:
        return desired
    if most < least * gpus:
        return F.when(desired * gpus <= most, desired).otherwise(F.lit(0))
    scaled = F.greatest(F.lit(least), F.floor(desired * (F.lit(float(most)) / (desired * gpus))))
    return F.when(desired * gpus <= most, desired).otherwise(scaled)


def forecast_last(samples: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of each key, NaN and null read as 0, after its first value that isn't 0; 0 if there is none."""
    v = F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0))
    each = samples.groupBy(key).agg(F.max_by(v, F.col(order)).alias("last"), F.bool_or(v != 0).alias("live"))
    return each.select(key, F.when(F.col("live"), F.col("last")).otherwise(F.lit(0.0)).alias("forecast"))


def reverse_regression(samples: DataFrame, key: str, x: str, y: str, sla: float, least: int = 5) -> DataFrame:
    """The largest load that keeps the latency within sla: the line through the samples read backwards, not under 0.

    If it doesn't rise, the least load seen under sla, or else the least seen; null with fewer than least samples.
    """
    slope, base = F.regr_slope(y, x), F.regr_intercept(y, x)
    seen = F.coalesce(F.min(F.when(F.col(y) < sla, F.col(x))), F.min(x))
    return samples.groupBy(key).agg(F.when(F.count("*") >= least, F.greatest(F.lit(0.0), F.when(slope > 0, (F.lit(sla) - base) / slope).otherwise(seen.cast("double")))).alias("most"))


def either_vote(a: Column, b: Column) -> Column:
    """up if either says so, down only if both do."""
    return F.when((a == "up") | (b == "up"), "up").when((a == "down") & (b == "down"), "down").otherwise("keep")


def timing(tokens: Column, quadratic: float, linear: float, base: float) -> Column:
    """Prefill time by the number of tokens (M1)."""
    return quadratic * tokens * tokens + linear * tokens + base


def decode_timing(active: Column, context: Column, base: float, per_request: float, per_token: float) -> Column:
    """Time of a decode step by active requests and their context (M2)."""
    return base + per_request * active + per_token * context


def correction(observed: Column, expected: Column) -> Column:
    """Observed over expected latency; 1 if nothing is expected (M8)."""
    return F.when(expected > 0, observed / expected).otherwise(F.lit(1.0))


def cost_pairs(prefill: DataFrame, decode: DataFrame, requests: float = 1000.0, most: int = 1000) -> DataFrame:
    """GPU hours of each pair of prefill and decode points (x, a: rate and cost; y, b), for so many requests.

    Frontiers are short; more than so many points on the decode side are refused.
    """
    if decode.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} decode points: take the frontier first")
    hours = requests / F.col("x") * F.col("a") / 3600 + requests / F.col("y") * F.col("b") / 3600
    return prefill.crossJoin(F.broadcast(decode)).withColumn("gpu_hours", hours)


def grid_index(value: Column, low: float, step: float, resolution: int) -> Column:
    """The nearest of equally spaced grid places, halves to the even one, clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(resolution - 1), F.rint((value - low) / step).cast("int")))


def best_cell(cells: DataFrame, rows: list[str], load: str, latency: str, sla: float) -> DataFrame:
    """Of each row of a grid the cell of the highest load within sla, else that of the lowest load."""
    others = [c for c in cells.columns if c not in rows and c != load]
    pick = F.struct(load, *others)
    best = cells.groupBy(*rows).agg(F.coalesce(F.max_by(F.when(F.col(latency) <= sla, pick), F.when(F.col(latency) <= sla, F.col(load))), F.min_by(pick, F.col(load))).alias("b"))
    return best.select(*rows, "b.*")


def thinking_tokens(output: Column, ratio: float) -> Column:
    """Tokens of thinking in an output: none under two, else at least two and at most all."""
    raw = F.floor(output * ratio)
    return F.when((output < 2) | (raw == 0), 0).otherwise(F.least(F.greatest(raw, F.lit(2)), output)).cast("long")


def backoff(errors: Column, first_ms: int, most_exponent: int, most_ms: int) -> Column:
    """Doubling with each error up to a bound."""
    return F.least(F.lit(first_ms) * F.pow(F.lit(2), F.least(errors, F.lit(most_exponent))), F.lit(most_ms)).cast("long")


def concurrencies(ranks: Column, most: Column, granularity: int, cap: int) -> Column:
    """Concurrencies to try, multiples of the ranks."""
    each = F.floor(F.least(most, F.lit(cap)) / ranks).cast("int")
    few = F.transform(F.sequence(F.lit(1), F.greatest(each, F.lit(1))), lambda i: i * ranks)
    step = (each - 1) * ranks / (granularity - 1)
    many = F.transform(F.sequence(F.lit(0), F.lit(granularity - 1)), lambda i: ranks + F.floor(i * step).cast("int") * ranks)
    return F.when(each < 1, F.slice(few, 1, 0)).when(each < granularity, few).otherwise(many)


def frames(number: Column, seconds: Column, fps: Column, default_fps: int, default_number: int, default_seconds: int = 4) -> Column:
    """Frames of a video: as asked for, or seconds by rate, or the default."""
    by_time = F.coalesce(seconds, F.lit(default_seconds)) * F.coalesce(fps, F.lit(default_fps))
    return F.coalesce(number, F.when(seconds.isNotNull() | fps.isNotNull(), by_time), F.lit(default_number))


def usage_total(prompt: Column, completion: Column) -> Column:
    """Prompt and completion tokens, held at the largest 32-bit number."""
    return F.least(prompt + completion, F.lit(4294967295))


def max_batch(weights: Column, per_request: Column, capacity: float, most: int = 1 << 20) -> Column:
    """The largest batch whose memory, weights and so much a request, is within capacity; 0 if not even one is."""
    n = F.floor((F.lit(capacity) - weights) / per_request)
    return F.greatest(F.lit(0), F.least(n, F.lit(most))).cast("long")
