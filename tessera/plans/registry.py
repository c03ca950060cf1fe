"""Every registered query of the engine's own operators, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import events, metrics, planner, prefix, trace
from ..sources.tables import cache_events, table, trace_blocks, trace_requests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries that SQL can't express; each has a test of its own.
NO_SQL: set[str] = set()
FLAGSHIP = "route_argmin"

BLOCK = 512
WORKERS = 4
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _blocks_sql(modulus: int = 50) -> str:
    return f"blocks AS (SELECT l_orderkey AS rid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS pos, l_partkey % {modulus} AS hash FROM lineitem)"


_REQUESTS = f"""requests AS (SELECT o_orderkey AS rid, epoch_ms(o_orderdate) AS ts, n * {BLOCK} AS input_length, CAST(q AS BIGINT) AS output_length
 FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
_EVENTS = """ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id % 8 AS worker, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS block,
 CASE event_type WHEN 'click' THEN 'stored' WHEN 'view' THEN 'stored' WHEN 'purchase' THEN 'removed' WHEN 'error' THEN 'cleared' WHEN 'signup' THEN 'add' END AS kind FROM events)"""
_PATHS = f"""{_blocks_sql(5)}, paths AS (SELECT rid, pos, array_to_string(list(hash) OVER (PARTITION BY rid ORDER BY pos), '/') AS path FROM blocks),
 idx AS (SELECT DISTINCT rid % {WORKERS} AS worker, path FROM paths WHERE rid % 2 = 0),
 depth AS (SELECT p.rid, i.worker, max(p.pos) + 1 AS depth FROM paths p JOIN idx i USING (path) WHERE p.rid % 2 = 1 GROUP BY 1, 2)"""
_COSTS = f"""{_PATHS}, req AS (SELECT rid, count(*) AS n FROM blocks WHERE rid % 2 = 1 GROUP BY 1), tree AS (SELECT worker, count(*) AS tree FROM idx GROUP BY 1),
 load AS (SELECT rid % {WORKERS} AS worker, count(*) // 100 AS decode_blocks FROM blocks WHERE rid % 2 = 0 GROUP BY 1),
 costs AS (SELECT req.rid, load.worker, tree.tree, CAST(n - coalesce(d.depth, 0) + load.decode_blocks AS DOUBLE) AS cost
  FROM req CROSS JOIN load JOIN tree ON tree.worker = load.worker LEFT JOIN depth d ON d.rid = req.rid AND d.worker = load.worker)"""


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        else:
            NO_SQL.add(f.__name__)
        return f

    return register


@query(f"WITH {_blocks_sql()} SELECT pos, hash, count(*) AS n FROM blocks GROUP BY 1, 2")
def hash_counts(spark, sf):
    return trace.hash_counts(trace_blocks(spark, sf))


@query(
    f"""WITH {_blocks_sql()}, {_REQUESTS}, c AS (SELECT rid, count(*) OVER (PARTITION BY pos, hash) AS n FROM blocks),
 per AS (SELECT rid, count(*) AS b, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS r FROM c GROUP BY 1)
 SELECT rid, CAST(CASE WHEN r = b THEN input_length ELSE r * {BLOCK} END AS BIGINT) AS context_length, CAST(input_length - CASE WHEN r = b THEN input_length ELSE r * {BLOCK} END AS BIGINT) AS unique_length FROM per JOIN requests USING (rid)"""
)
def context_lengths(spark, sf):
    return trace.context_lengths(trace_blocks(spark, sf), trace_requests(spark, sf), BLOCK)


_RATES = "rates AS (SELECT rid, count(*) AS blocks, CAST(coalesce(min(CASE WHEN fr = rid THEN pos END), count(*)) AS DOUBLE) / count(*) AS hit_rate FROM (SELECT *, min(rid) OVER (PARTITION BY hash) AS fr FROM blocks) GROUP BY 1)"


@query(f"WITH {_blocks_sql()}, {_RATES} SELECT rid, blocks, hit_rate FROM rates")
def theoretical_hit_rate(spark, sf):
    return trace.hit_rates(trace_blocks(spark, sf))


@query(
    f"""WITH {_blocks_sql()}, {_RATES} SELECT round(avg(hit_rate), 6) AS mean, round(stddev_pop(hit_rate), 6) AS std, min(hit_rate) AS least,
 round(quantile_cont(hit_rate, 0.25), 6) AS p25, round(quantile_cont(hit_rate, 0.5), 6) AS median, round(quantile_cont(hit_rate, 0.75), 6) AS p75, max(hit_rate) AS most FROM rates"""
)
def hit_rate_summary(spark, sf):
    s = trace.summary(trace.hit_rates(trace_blocks(spark, sf)), "hit_rate")
    return s.select(*[F.round(c, 6).alias(c) if c not in ("least", "most") else F.col(c) for c in s.columns])


@query(
    f"""WITH {_REQUESTS} SELECT {", ".join(f"round(CAST({f}({c}) AS DOUBLE), 4) AS {n}_{c}" for c in ("input_length", "output_length") for n, f in (("min", "min"), ("max", "max"), ("avg", "avg"), ("std", "stddev_samp")))},
 max(input_length + output_length) AS max_total, count(*) AS requests, round(count(*) / ((max(ts) - min(ts)) / 1000.0), 8) AS rps FROM requests"""
)
def trace_stats(spark, sf):
    s = trace.trace_stats(trace_requests(spark, sf))
    return s.select(*[F.round(c, 4).alias(c) if "length" in c else F.round(c, 8).alias(c) if c == "rps" else F.col(c) for c in s.columns])


@query(f"WITH {_REQUESTS} SELECT ts // 86400000 AS interval, count(*) AS num_req, round(avg(input_length), 6) AS isl, round(avg(output_length), 6) AS osl FROM requests GROUP BY 1")
def interval_load(spark, sf):
    return trace.interval_load(trace_requests(spark, sf), 86_400_000).select("interval", "num_req", F.round("isl", 6).alias("isl"), F.round("osl", 6).alias("osl"))


@query(f"WITH {_REQUESTS}, e AS (SELECT min(ts) AS lo, max(ts) AS hi FROM requests) SELECT CAST(least(19, floor((ts - lo) * 20 / greatest(hi - lo, 1))) AS BIGINT) AS bin, count(*) AS n FROM requests, e GROUP BY 1")
def request_rate_bins(spark, sf):
    return trace.rate_bins(trace_requests(spark, sf))


@query(f"WITH {_REQUESTS} SELECT rid, CAST(floor((ts - (SELECT min(ts) FROM requests)) / 2.5) AS BIGINT) AS ts, input_length, output_length FROM requests")
def trace_rescaled(spark, sf):
    return trace.rescale(trace_requests(spark, sf), 2.5)


@query(f"WITH {_REQUESTS} SELECT rid, ts, input_length, least(greatest(output_length, 50), 100) AS output_length FROM requests WHERE input_length BETWEEN 1024 AND 4096")
def trace_bounded(spark, sf):
    return trace.bound_lengths(trace_requests(spark, sf), (1024, 4096), (50, 100))


@query(f"WITH {_REQUESTS} SELECT rid, ts, input_length, output_length FROM requests WHERE output_length > 60 ORDER BY rid LIMIT 50 OFFSET 20")
def trace_skip_head(spark, sf):
    return trace.take_part(trace_requests(spark, sf), "rid", 20, 50, "output_length > 60")


@query(f"WITH {_blocks_sql()} SELECT rid, pos * 3 + k AS pos, hash * 3 + k AS hash FROM blocks, (SELECT unnest([0, 1, 2]) AS k)")
def trace_expand(spark, sf):
    return trace.expand(trace_blocks(spark, sf), 3)


@query(f"WITH {_blocks_sql()} SELECT rid, CAST(c AS INTEGER) AS copy, pos, hash + (SELECT max(hash) + 1 FROM blocks) * c AS hash FROM blocks, (SELECT unnest([0, 1]) AS c)")
def trace_duplicate(spark, sf):
    return trace.duplicate(trace_blocks(spark, sf), 2)


@query(
    f"""WITH RECURSIVE {_blocks_sql(5)}, chain AS (SELECT rid, pos, md5(concat('/', hash)) AS path FROM blocks WHERE pos = 0
 UNION ALL SELECT b.rid, b.pos, md5(concat(c.path, '/', b.hash)) FROM chain c JOIN blocks b ON b.rid = c.rid AND b.pos = c.pos + 1) SELECT rid, pos, path FROM chain"""
)
def block_chain_hash(spark, sf):
    return trace.normalise(trace_blocks(spark, sf, 5)).select("rid", "pos", "path")


@query(
    f"""WITH {_PATHS}, e AS (SELECT pos, path, count(*) AS visited FROM paths GROUP BY 1, 2) SELECT pos, count(*) AS nodes, CAST(sum(visited) AS BIGINT) AS visits, max(visited) AS most FROM e GROUP BY 1"""
)
def tree_levels(spark, sf):
    edges = trace.tree_edges(trace.normalise(trace_blocks(spark, sf, 5)))
    return edges.groupBy("pos").agg(F.count("*").alias("nodes"), F.sum("visited").alias("visits"), F.max("visited").alias("most"))


@query(
    f"""WITH {_PATHS}, n AS (SELECT DISTINCT pos, path FROM paths), up AS (SELECT DISTINCT lag(path) OVER (PARTITION BY rid ORDER BY pos) AS path FROM paths)
 SELECT pos, count(*) AS leaves FROM n WHERE path NOT IN (SELECT path FROM up WHERE path IS NOT NULL) GROUP BY 1"""
)
def lineage_leaves(spark, sf):
    edges = trace.tree_edges(trace.normalise(trace_blocks(spark, sf, 5)))
    return trace.leaves(edges).groupBy("pos").agg(F.count("*").alias("leaves"))


@query(
    f"""WITH {_blocks_sql(20)}, n AS (SELECT hash, lead(hash) OVER (PARTITION BY rid ORDER BY pos) AS next FROM blocks), c AS (SELECT hash, next, count(*) AS n FROM n WHERE next IS NOT NULL GROUP BY 1, 2)
 SELECT hash, next, round(CAST(sum(n) OVER (PARTITION BY hash ORDER BY next ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER (PARTITION BY hash), 9) AS cdf FROM c"""
)
def transition_cdf(spark, sf):
    return trace.transition_cdf(trace_blocks(spark, sf, 20)).select("hash", "next", F.round("cdf", 9).alias("cdf"))


def _split(spark, sf):
    paths = trace.normalise(trace_blocks(spark, sf, 5))
    index = paths.where("rid % 2 = 0").select((F.col("rid") % WORKERS).alias("worker"), "path").distinct()
    return index, paths.where("rid % 2 = 1")


@query(f"WITH {_PATHS} SELECT rid, worker, depth FROM depth")
def prefix_match(spark, sf):
    return prefix.match(*_split(spark, sf))


@query(
    f"""WITH {_blocks_sql(20)}, s AS (SELECT DISTINCT rid % 64 AS worker, hash FROM blocks WHERE rid % 2 = 0), q AS (SELECT * FROM blocks WHERE rid % 2 = 1),
 h AS (SELECT DISTINCT rid, worker, pos FROM q JOIN s USING (hash)) SELECT rid, worker, count(*) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY rid, worker ORDER BY pos) - 1 AS k FROM h) WHERE k = pos GROUP BY 1, 2"""
)
def blind_match(spark, sf):
    b = trace_blocks(spark, sf, 20)
    return prefix.blind_match(b.where("rid % 2 = 0").withColumn("worker", F.col("rid") % 64), b.where("rid % 2 = 1"))


@query("SELECT DISTINCT l_partkey AS hash, l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < DATE '1995-06-17') AS present FROM lineitem")
def presence_scan(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_shipdate", F.col("l_partkey").alias("hash"))
    return prefix.presence(rows.where("l_shipdate < date'1995-06-17'"), rows)


@query("SELECT l_orderkey AS rid, count(DISTINCT CASE WHEN l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 2 = 0) THEN l_partkey END) AS new_blocks FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1")
def new_blocks_anti(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rid"), F.col("l_partkey").alias("hash"))
    return prefix.new_blocks(rows.where("rid % 2 = 0"), rows.where("rid % 2 = 1"))


def _costs(spark, sf):
    index, asked = _split(spark, sf)
    blocks = trace_blocks(spark, sf, 5)
    load = blocks.where("rid % 2 = 0").groupBy((F.col("rid") % WORKERS).alias("worker")).agg(F.expr("count(*) div 100").alias("decode_blocks"))
    load = load.join(index.groupBy("worker").agg(F.count("*").alias("tree")), "worker")
    return prefix.costs(asked.groupBy("rid").agg(F.count("*").alias("blocks")), prefix.match(index, asked), load)


@query(f"WITH {_COSTS} SELECT rid, worker, cost FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY cost, tree, worker) AS k FROM costs) WHERE k = 1")
def route_argmin(spark, sf):
    return prefix.argmin(_costs(spark, sf))


@query(
    f"""WITH {_COSTS}, z AS (SELECT *, max(cost) OVER (PARTITION BY rid) - min(cost) OVER (PARTITION BY rid) AS span FROM costs),
 e AS (SELECT rid, worker, CASE WHEN span = 0 THEN 1.0 ELSE exp(-(cost - min(cost) OVER (PARTITION BY rid)) / span / 0.5) END AS e FROM z)
 SELECT rid, worker, round(e / sum(e) OVER (PARTITION BY rid), 9) AS p FROM e"""
)
def route_softmax_prob(spark, sf):
    return prefix.softmax(_costs(spark, sf), 0.5).select("rid", "worker", F.round("p", 9).alias("p"))


@query("SELECT user_id, worker, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat(user_id, ':', worker)) DESC, worker) AS k FROM (SELECT DISTINCT user_id FROM events), (SELECT CAST(unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS INTEGER) AS worker)) WHERE k <= 2")
def hrw_topk(spark, sf):
    return prefix.rendezvous(table(spark, sf, "events"), "user_id", list(range(8)), 2)


@query(
    f"""WITH {_EVENTS}, l AS (SELECT user_id AS worker, worker AS rank, sum(block) AS used, count(*) * 60 AS total, sum(CASE WHEN kind = 'stored' THEN block END) AS tokens FROM ev GROUP BY 1, 2)
 SELECT worker, bool_and(coalesce(used > 0.8 * total OR tokens > 1800, false)) AS busy FROM l GROUP BY 1"""
)
def busy_workers(spark, sf):
    e = cache_events(spark, sf)
    loads = e.groupBy(F.col("user_id").alias("worker"), F.col("worker").alias("rank")).agg(F.sum("block").alias("used"), (F.count("*") * 60).alias("total"), F.sum(F.when(F.col("kind") == "stored", F.col("block"))).alias("tokens"))
    return prefix.busy(loads, 0.8, 1800)


@query(f"WITH {_EVENTS}, t AS (SELECT worker, block, max(event_id) AS seen FROM ev GROUP BY 1, 2) SELECT worker, block, age FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY seen DESC, block) AS age FROM t) WHERE age > 30")
def lru_rank(spark, sf):
    return prefix.evictions(cache_events(spark, sf).withColumnRenamed("event_id", "at"), 30)


@query(f"WITH {_EVENTS} SELECT user_id, event_id, kind, block FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM ev) WHERE k = 1")
def event_state_latest(spark, sf):
    return events.latest(cache_events(spark, sf), "user_id", "event_id")


@query(f"WITH {_EVENTS} SELECT worker, b + 1 AS first_missing, event_id - 1 AS last_missing FROM (SELECT *, lag(event_id) OVER (PARTITION BY worker ORDER BY event_id) AS b FROM ev) WHERE event_id > b + 1")
def event_gaps(spark, sf):
    return events.gaps(cache_events(spark, sf), "worker", "event_id")


@query(
    f"""WITH {_EVENTS}, a AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY worker ORDER BY event_id) = kind THEN 0 ELSE 1 END AS new FROM ev),
 r AS (SELECT *, sum(new) OVER (PARTITION BY worker ORDER BY event_id) AS run FROM a), p AS (SELECT *, (row_number() OVER (PARTITION BY worker, run ORDER BY event_id) - 1) // 2 AS part FROM r)
 SELECT worker, CAST(run AS BIGINT) AS run, part, kind, count(*) AS events, min(event_id) AS first_event FROM p GROUP BY 1, 2, 3, 4"""
)
def event_batches(spark, sf):
    return events.batches(cache_events(spark, sf), "worker", "event_id", 2)


@query(f"WITH {_EVENTS} SELECT block, arg_min(worker, event_id) AS worker, min(event_id) AS event_id, count(DISTINCT worker) AS sources FROM ev GROUP BY 1")
def source_dedup(spark, sf):
    return events.first_sources(cache_events(spark, sf), "block", "event_id")


BOUNDS = metrics.log_buckets(1, 1000, 12)
_HIST = "hist AS (" + " UNION ALL ".join(f"SELECT event_type, CAST({b} AS DOUBLE) AS le, count(CASE WHEN value <= {b} THEN 1 END) AS n FROM events GROUP BY 1" for b in BOUNDS) + " UNION ALL SELECT event_type, CAST('inf' AS DOUBLE), count(value) FROM events GROUP BY 1)"


@query(f"WITH {_HIST} SELECT event_type, le, n FROM hist")
def histogram_counts(spark, sf):
    return metrics.histogram(table(spark, sf, "events"), ["event_type"], "value", BOUNDS)


@query(
    f"""WITH {_HIST}, w AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY le), 0) AS p, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0.0) AS lo, 0.9 * max(n) OVER (PARTITION BY event_type) AS t FROM hist)
 SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (t - p) / (n - p) END, 6) AS value FROM w WHERE n >= t AND p < t"""
)
def histogram_quantile(spark, sf):
    hist = metrics.histogram(table(spark, sf, "events"), ["event_type"], "value", BOUNDS)
    return metrics.histogram_quantile(hist, ["event_type"], 0.9).select("event_type", F.round("value", 6).alias("value"))


@query("SELECT event_type, n, a[n * 50 // 100 + 1] AS p50, a[n * 95 // 100 + 1] AS p95, a[n * 99 // 100 + 1] AS p99 FROM (SELECT event_type, count(*) AS n, list(value ORDER BY value) AS a FROM events GROUP BY 1)")
def latency_rank_stats(spark, sf):
    return metrics.rank_stats(table(spark, sf, "events"), "event_type", "value")


@query(f"WITH {_EVENTS} SELECT event_type, ms // 3600000 AS step, round(sum(value) / 3600.0, 8) AS rate FROM ev GROUP BY 1, 2")
def range_rate(spark, sf):
    return metrics.range_rate(cache_events(spark, sf), ["event_type"], "ms", "value", 3_600_000).select("event_type", "step", F.round("rate", 8).alias("rate"))


@query("SELECT event_type, round(avg(r), 6) AS mean_ratio, count(*) AS series FROM (SELECT event_type, user_id, sum(value) / count(value) AS r FROM events GROUP BY 1, 2) GROUP BY 1")
def avg_of_ratios(spark, sf):
    return metrics.mean_of_ratios(table(spark, sf, "events"), "user_id", "event_type", "value").select("event_type", F.round("mean_ratio", 6).alias("mean_ratio"), "series")


@query(f"WITH {_EVENTS}, g AS (SELECT user_id, block, ms, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS gap FROM ev) SELECT user_id, count(*) AS chunks, min(ms) - min(ms // 86400000 * 86400000) AS ttft, round(CAST(sum(gap) AS DOUBLE) / sum(CASE WHEN gap IS NOT NULL THEN greatest(block, 1) END), 6) AS itl FROM g GROUP BY 1")
def ttft_itl(spark, sf):
    chunks = cache_events(spark, sf).withColumn("start", F.expr("ms div 86400000 * 86400000"))  # a request starts with its day
    return metrics.chunk_latency(chunks, "user_id", "ms", "block", "start").select("user_id", "chunks", "ttft", F.round("itl", 6).alias("itl"))


@query(f"WITH {_EVENTS}, g AS (SELECT user_id, event_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS delta FROM ev) SELECT user_id, event_id, delta FROM g WHERE delta > 0")
def inter_arrival(spark, sf):
    e = cache_events(spark, sf)
    return e.select("user_id", "event_id", (F.col("ms") - F.lag("ms").over(Window.partitionBy("user_id").orderBy("ms"))).alias("delta")).where("delta > 0")


@query(f"WITH {_EVENTS} SELECT user_id, event_id, CASE WHEN isfinite(regr_slope(value, block) OVER w) THEN round(regr_slope(value, block) OVER w, 3) + 0.0 END AS slope, CASE WHEN isfinite(regr_intercept(value, block) OVER w) THEN round(regr_intercept(value, block) OVER w, 3) + 0.0 END AS intercept FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def sliding_regression(spark, sf):
    s = metrics.sliding_regression(cache_events(spark, sf), "user_id", "event_id", "block", "value", 50)
    return s.select("user_id", "event_id", (F.round("slope", 3) + 0.0).alias("slope"), (F.round("intercept", 3) + 0.0).alias("intercept"))


@query("WITH d AS (SELECT DISTINCT p_brand, p_size, p_retailprice FROM part), m AS (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM d) SELECT p_brand, p_size, p_retailprice FROM m WHERE m IS NULL OR p_retailprice > m")
def pareto_strict(spark, sf):
    return metrics.pareto(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice")


@query("SELECT a.p_brand, a.p_size, a.p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_partkey <> a.p_partkey AND b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice)")
def pareto_dominated(spark, sf):
    return metrics.pareto(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice", maximise_x=True, repeats=True)


_GRID = [(900.0, 60.0), (1100.0, 75.0), (1400.0, 90.0), (1900.0, 150.0)]


@query("SELECT p_partkey, round(CASE " + " ".join(f"WHEN p_retailprice <= {x} THEN {f'{y0} + (greatest(p_retailprice, {x0}) - {x0}) * {(y - y0) / (x - x0)!r}'}" for (x0, y0), (x, y) in zip(_GRID, _GRID[1:])) + " ELSE 150.0 END, 6) AS ttft FROM part")
def interp_linear(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(planner.interpolate(F.col("p_retailprice"), _GRID), 6).alias("ttft"))


_PLAN = f"""{_REQUESTS}, l AS (SELECT ts // 86400000 AS interval, count(*) AS num_req, avg(input_length) AS isl, avg(output_length) AS osl FROM requests GROUP BY 1),
 plan AS (SELECT interval, CAST(greatest(ceil(num_req * isl / 60.0 * 0.8 / 20.0 / 2), 1) AS BIGINT) AS prefill, CAST(greatest(ceil(num_req * osl / 60.0 / 2.5 / 1), 1) AS BIGINT) AS decode FROM l)"""


def _plan(spark, sf):
    return planner.replicas(trace.interval_load(trace_requests(spark, sf), 86_400_000), 60.0, 20.0, 2.5, 0.8, 2, 1).select("interval", "prefill", "decode")


@query(f"WITH {_PLAN} SELECT interval, prefill, decode FROM plan")
def replica_plan(spark, sf):
    return _plan(spark, sf)


@query(
    f"""WITH {_PLAN}, s AS (SELECT *, prefill * 2 + decode AS need, greatest(1, least((8 - 1) // 2, CAST(floor(prefill * (8.0 / (prefill * 2 + decode))) AS BIGINT))) AS p FROM plan)
 SELECT interval, CASE WHEN need > 8 THEN p ELSE prefill END AS prefill, CASE WHEN need > 8 THEN CAST(greatest(1, floor((8 - p * 2) / 1.0)) AS BIGINT) ELSE decode END AS decode FROM s"""
)
def gpu_budget(spark, sf):
    return planner.budget(_plan(spark, sf), 8, 2, 1)


@query(f"WITH {_EVENTS}, l AS (SELECT event_type, worker, avg(value) AS load FROM ev GROUP BY 1, 2) SELECT event_type, CASE WHEN bool_and(load > 55) THEN 'up' WHEN bool_and(load < 48) THEN 'down' ELSE 'keep' END AS vote FROM l GROUP BY 1")
def scale_votes(spark, sf):
    loads = cache_events(spark, sf).groupBy("event_type", "worker").agg(F.avg("value").alias("load"))
    return planner.votes(loads, "event_type", "load", 48, 55)


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS chunks FROM conversations GROUP BY 1")
def fold_deltas(spark, sf):
    return text.fold(table(spark, sf, "conversations"), "conv_id", "turn", "text")


_SAID = "replace(replace(text, '<think>', ''), '</think>', '')"


@query(
    f"""WITH m AS (SELECT conv_id, turn, substr({_SAID}, 1, 20) AS a, substr({_SAID}, 21, 20) AS b, substr({_SAID}, 41) AS c FROM conversations)
 SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN trim(concat(b, c), W) WHEN 1 THEN trim(b, W) WHEN 2 THEN concat(a, '</think>', b, c) ELSE trim(concat(a, '</think>', b), W) END AS normal,
  CASE turn % 4 WHEN 0 THEN trim(a, W) WHEN 1 THEN trim(concat(a, '<think>', c), W) WHEN 2 THEN '' ELSE trim(c, W) END AS reasoning FROM m""".replace(", W)", ", concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))")
)
def reasoning_split(spark, sf):
    said = F.expr(_SAID)
    a, b, c = F.substring(said, 1, 20), F.substring(said, 21, 20), F.substring(said, 41, 1 << 30)
    begin, end = F.lit("<think>"), F.lit("</think>")
    shapes = [F.concat(begin, a, end, b, c), F.concat(begin, a, begin, c, end, b), F.concat(a, end, b, c), F.concat(a, end, b, begin, c)]
    marked = F.element_at(F.array(*shapes), (F.col("turn") % 4 + 1).cast("int"))
    normal, inner = text.reasoning(marked)
    return table(spark, sf, "conversations").select("conv_id", "turn", normal.alias("normal"), inner.alias("reasoning"))


@query("SELECT conv_id, turn, CASE WHEN instr(text, 'th') = 0 AND instr(text, '. ') = 0 THEN text WHEN instr(text, 'th') = 0 THEN substr(text, 1, instr(text, '. ') - 1) WHEN instr(text, '. ') = 0 THEN substr(text, 1, instr(text, 'th') - 1) ELSE substr(text, 1, least(instr(text, 'th'), instr(text, '. ')) - 1) END AS visible FROM conversations")
def stop_truncate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.stop(F.col("text"), ["th", ". "]).alias("visible"))


@query("SELECT conv_id, CASE WHEN contains(lower(p), 'tion') THEN 'planner' WHEN contains(lower(p), 'the') THEN 'coder' ELSE 'other' END AS agent FROM (SELECT conv_id, arg_min(text, turn) AS p FROM conversations GROUP BY 1)")
def agent_classify(spark, sf):
    first = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("p"))
    return first.select("conv_id", text.agent(F.col("p"), [("tion", "planner"), ("the", "coder")], "other").alias("agent"))


@query(
    f"""WITH {_EVENTS}, v AS (SELECT event_id, value / 40 AS temperature, block / 90.0 AS top_p, block AS n FROM ev)
 SELECT event_id, concat_ws(',', CASE WHEN NOT (temperature BETWEEN 0 AND 2) THEN 'temperature' END, CASE WHEN NOT (top_p BETWEEN 0 AND 1) THEN 'top_p' END, CASE WHEN NOT (n BETWEEN 1 AND 90) THEN 'n' END) AS violations FROM v"""
)
def param_violations(spark, sf):
    v = cache_events(spark, sf).select("event_id", (F.col("value") / 40).alias("temperature"), (F.col("block") / 90.0).alias("top_p"), F.col("block").alias("n"))
    return v.select("event_id", text.violations([("temperature", F.col("temperature").between(0, 2)), ("top_p", F.col("top_p").between(0, 1)), ("n", F.col("n").between(1, 90))]).alias("violations"))


@query(f"WITH {_EVENTS} SELECT event_id, 'cache_events_total' AS name, concat(event_type, ',a=', chr(34), 'b', chr(34), '}}') AS kind, CAST(block AS DOUBLE) AS value FROM ev")
def prometheus_lines(spark, sf):
    e = cache_events(spark, sf)
    line = F.concat(F.lit('cache_events_total{kind="'), F.col("event_type"), F.lit(',a=\\"b\\"}",worker="'), F.col("worker").cast("string"), F.lit('"} '), F.col("block").cast("string"))
    return e.select("event_id", text.sample_line(line).alias("s")).select("event_id", "s.name", F.col("s.labels")["kind"].alias("kind"), "s.value")


@query("SELECT conv_id, turn, role AS event, replace(text, chr(13), chr(10)) AS data, CAST(turn AS VARCHAR) AS id, ['kept'] AS comments FROM conversations WHERE NOT contains(text, chr(10) || chr(10))")
def sse_messages(spark, sf):
    c = table(spark, sf, "conversations").where("not contains(text, '\n\n')")  # such a text is two messages
    frame = F.concat(F.lit(": kept\r\nevent: "), F.col("role"), F.lit("\r\nid: "), F.col("turn").cast("string"), F.lit("\r\ndata: "), F.replace("text", F.lit("\n"), F.lit("\r\ndata: ")), F.lit("\r\n\r\n"))
    return c.select("conv_id", "turn", F.inline(text.sse(frame)))


@query("WITH s AS (SELECT vec_id, list_sort(embedding, 'DESC') AS e FROM embeddings) SELECT vec_id, round(CAST(e[1] AS DOUBLE) - CAST(e[2] AS DOUBLE), 9) AS gap FROM s")
def logprob_gap(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.sort_array("embedding", False).alias("e"))
    return e.select("vec_id", F.round(F.col("e")[0].cast("double") - F.col("e")[1].cast("double"), 9).alias("gap"))


@query(
    f"""WITH {_blocks_sql(3)}, m AS (SELECT rid, pos, hash, CASE WHEN lag(hash) OVER (PARTITION BY rid ORDER BY pos) = hash THEN 0 ELSE 1 END AS new FROM blocks),
 r AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS run FROM m) SELECT rid, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS stop FROM r WHERE hash = 1 GROUP BY rid, run"""
)
def marker_ranges(spark, sf):
    whole = trace_blocks(spark, sf, 3).groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("tokens"))
    return whole.select("rid", F.inline(text.marker_ranges(F.col("tokens"), 1)))


from . import more, state_reports, trees_text  # noqa: E402,F401  register their queries
