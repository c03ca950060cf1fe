"""Reports over latencies, faults, samples and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


def bucket_stats(samples: DataFrame, at: str, value: str, width: int) -> DataFrame:
    """Rank statistics of each time bucket that has samples."""
    return metrics.rank_stats(samples.withColumn("bucket", F.expr(f"{at} div {width}")), "bucket", value)


def turn_stats(turns: DataFrame, turn: str, value: str, ok: Column) -> DataFrame:
    """Rank statistics of each turn over those that succeeded."""
    return metrics.rank_stats(turns.where(ok), turn, value)


def upper_median(samples: DataFrame, key: str, value: str) -> DataFrame:
    """The value at place n / 2 of the sorted ones (A9).  Equal values are counted before they are ordered."""
    return metrics.rank_stats(samples, key, value).select(key, F.col("p50").alias("median"))


def serving(requests: DataFrame, group: str, seconds: float, ttft_ms: float, tpot_ms: float) -> DataFrame:
    """requests: group, ok, input, output (tokens), ttft, latency (ms).  Completed, tokens, rates, goodput (requests within both targets
    a second) and mean, deviation and percentiles of TTFT, TPOT and latency (A10).  TPOT is 0 for outputs of one token."""
    r = requests.where("ok").withColumn("tpot", F.when(F.col("output") > 1, (F.col("latency") - F.col("ttft")) / (F.col("output") - 1)).otherwise(0.0))
    good = F.count(F.when((F.col("ttft") <= ttft_ms) & (F.col("tpot") <= tpot_ms), 1))
    each = [f(c).alias(f"{n}_{c}") for c in ("ttft", "tpot", "latency") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return r.groupBy(group).agg(F.count("*").alias("completed"), F.sum("input").alias("input"), F.sum("output").alias("output"), (F.count("*") / seconds).alias("rps"), (F.sum("output") / seconds).alias("tps"), (good / seconds).alias("goodput"), *each)


def around_fault(requests: DataFrame, group: str, at: str, fault: Column, ok: Column, latency: str, sla: float) -> DataFrame:
    """Successes, failures, latency and its deviation, and violations of sla, before and after a fault."""
    out = []
    for name, side in (("before", F.col(at) <= fault), ("after", F.col(at) > fault)):
        value = F.when(side & ok, F.col(latency))
        out += [
            F.count(F.when(side & ok, 1)).alias(f"{name}_ok"),
            F.count(F.when(side & ~ok, 1)).alias(f"{name}_failed"),
            F.avg(value).alias(f"{name}_mean"),
            F.stddev_samp(value).alias(f"{name}_std"),
            F.count(F.when(value > sla, 1)).alias(f"{name}_violations"),
        ]
    return requests.groupBy(group).agg(*out)


def recovery(starts: DataFrame, group: str, at: str, fault: Column) -> DataFrame:
    """Time from the fault to the last start of any process; null if none started after it."""
    took = F.max(at) - F.max(fault)
    return starts.groupBy(group).agg(F.when(took > 0, took).alias("recovery"))


def average_of(samples: DataFrame, key: str, series: str, at: str, total: str, count: str) -> DataFrame:
    """Of each series what its sum and its count have grown by, their ratio, and the plain mean over series; 0 without data."""
    grown = lambda c: F.max_by(c, at) - F.min_by(c, at)
    each = samples.groupBy(key, series).agg(grown(total).alias("s"), grown(count).alias("n"))
    ratio = F.avg(F.when(F.col("n") > 0, F.col("s") / F.col("n")))
    return each.groupBy(key).agg(F.coalesce(ratio, F.lit(0.0)).alias("mean"), F.sum("n").alias("requests"))


def recent_and_average(samples: DataFrame, worker: str, metric: str, at: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Of each worker and metric the newest sample and the mean; of each metric the mean over workers' means."""
    each = samples.groupBy(worker, metric).agg(F.max_by(value, at).alias("recent"), F.avg(value).alias("mean"))
    return each, each.groupBy(metric).agg(F.avg("recent").alias("recent"), F.avg("mean").alias("mean"))


def sum_rates(samples: DataFrame, series: list[str], by: list[str], ms: str, value: str, step_ms: int) -> DataFrame:
    """Rates of counters, summed over the other labels."""
    return metrics.counter_rate(samples, series, ms, value, step_ms).groupBy(*by, "step").agg(F.sum("rate").alias("rate"))


def busy_percent(idle: DataFrame, by: str, rate: str) -> DataFrame:
    """What idle time leaves of a hundred."""
    return idle.groupBy(by).agg((100 - F.avg(rate) * 100).alias("busy"))


def gauge(samples: DataFrame, value: str) -> DataFrame:
    """(A20)"""
    return samples.agg(F.max(value).alias("most"), F.avg(value).alias("mean"))


def pool_rates(snapshots: DataFrame, pool: str, ms: str, counters: list[str], hits: str, misses: str) -> DataFrame:
    """Of each snapshot: rates of its counters since the one before, their change, and the share of hits in that time."""
    w = Window.partitionBy(pool).orderBy(ms)
    took = (F.col(ms) - F.lag(ms).over(w)) / 1000
    rows = snapshots.select("*", *[((F.col(c) - F.lag(c).over(w)) / took).alias(f"{c}_rate") for c in counters], (F.col(hits) - F.lag(hits).over(w)).alias("_h"), (F.col(misses) - F.lag(misses).over(w)).alias("_m"))
    rows = rows.select("*", *[(F.col(f"{c}_rate") - F.lag(f"{c}_rate").over(w)).alias(f"{c}_gradient") for c in counters])
    return rows.withColumn("hit_ratio", F.when(F.col("_h") + F.col("_m") > 0, F.col("_h") / (F.col("_h") + F.col("_m")))).drop("_h", "_m")


def with_labels(sources: dict[str, DataFrame], label: str) -> DataFrame:
    """Samples of several sources as one, each with its name."""
    out = None
    for name, df in sources.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def gpu_hours(samples: DataFrame, key: str, at: str, gpus: Column, seconds: float) -> DataFrame:
    """Running total of GPU hours."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return samples.select(key, at, F.sum(gpus * (seconds / 3600)).over(w).alias("gpu_hours"))


def tier_hit_rates(requests: DataFrame, tier: str, hits: str, asked: str) -> DataFrame:
    """Hits over what was asked of each tier, 0 for an empty one."""
    return requests.groupBy(tier).agg(F.when(F.sum(asked) > 0, F.sum(hits) / F.sum(asked)).otherwise(0.0).alias("rate"))


def with_phase(samples: DataFrame, phases: DataFrame, on: list[str], value: str, factor: str) -> DataFrame:
    """Samples times the one value that their labels have on the other side; those without one are left out."""
    return samples.join(phases, on).withColumn(value, F.col(value) * F.col(factor))


def ratio(samples: DataFrame, by: list[str], above: Column, below: Column) -> DataFrame:
    """A quotient of two sums over the same labels in one pass; none where the lower one is 0."""
    return samples.groupBy(*by).agg(F.when(F.sum(below) != 0, F.sum(above) / F.sum(below)).alias("ratio"))


def log_lines(lines: DataFrame, labels: dict[str, str], *holds: str) -> DataFrame:
    """Lines with given labels that hold all the words."""
    for k, v in labels.items():
        lines = lines.where(F.col(k) == v)
    for word in holds:
        lines = lines.where(F.contains("line", F.lit(word)))
    return lines


def by_model(samples: DataFrame, configs: DataFrame) -> DataFrame:
    """Samples with their model's configuration, upper and lower case alike."""
    return samples.join(configs.withColumn("_m", F.lower("model")).drop("model"), F.lower(samples["model"]) == F.col("_m")).drop("_m")


def series(results: DataFrame, path: str, stat: str = "avg") -> DataFrame:
    """concurrency and value at a dot path of result documents (column json); documents without it are left out."""
    value = F.coalesce(F.get_json_object("json", f"$.{path}.{stat}"), F.get_json_object("json", f"$.{path}")).try_cast("double")
    return results.select("concurrency", value.alias("value")).where("value is not null")


def per_gpu(value: Column, gpus: Column) -> Column:
    """(F7)"""
    return F.when(gpus > 0, value / gpus).otherwise(0.0)


def rescale(rows: DataFrame, key: str, ts: str, span: int) -> DataFrame:
    """Times of each key stretched in whole numbers so that they run from 0 to span."""
    ends = rows.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    scaled = F.when(F.col("_b") > F.col("_a"), F.expr(f"({ts} - _a) * {span} div (_b - _a)")).otherwise(0).cast("long")
    return rows.join(ends, key).withColumn(ts, scaled).drop("_a", "_b")


def all_busy(config: DataFrame, loads: DataFrame, share: float) -> DataFrame:
    """config: worker, rank, capacity; loads: worker, rank, tokens.  Whether every rank of every worker is over its share; unknown is 0."""
    full = config.join(loads, ["worker", "rank"], "left")
    return full.agg(F.coalesce(F.bool_and(F.coalesce("tokens", F.lit(0)) > share * F.col("capacity")), F.lit(False)).alias("all_busy"))


def scope(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows in a scope: each given part must be equal, those not given may be anything."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def valid(*values: Column) -> Column:
    """Metrics that are all there and numbers."""
    ok = F.lit(True)
    for v in values:
        ok &= v.isNotNull() & ~F.isnan(v)
    return ok


def frontier_both(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Points that no other beats in one and equals in the other; equal points all stay."""
    counts = points.groupBy(key, x, y).agg(F.count("*").alias("_n"))
    best = F.max(y).over(Window.partitionBy(key).orderBy(F.desc(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1))
    kept = counts.withColumn("_m", best).where(F.col("_m").isNull() | (F.col(y) > F.col("_m")))
    return kept.select(key, x, y, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).drop("_i")


def widest(ours: DataFrame, theirs: list[tuple[float, float]], x: str, y: str, least: float | None = None) -> DataFrame:
    """The point of a frontier whose value is farthest, as a ratio, from another frontier read linearly between its points."""
    from . import planner

    grid = sorted(p for p in theirs if least is None or p[0] >= least)
    if not grid:
        return ours.limit(0).select(x, y, F.lit(0.0).alias("other"), F.lit(0.0).alias("ratio"))
    rows = ours.where(F.col(x).between(grid[0][0], grid[-1][0]) & (F.lit(True) if least is None else F.col(x) >= least))
    other = planner.interpolate(F.col(x), grid) if len(grid) > 1 else F.lit(float(grid[0][1]))
    rows = rows.select(x, y, other.alias("other")).where("other > 0").withColumn("ratio", F.col(y) / F.col("other"))
    best = rows.agg(F.max_by(F.struct(x, y, "other", "ratio"), F.struct("ratio", F.col(x))).alias("b"))
    return best.where("b is not null").select("b.*")
