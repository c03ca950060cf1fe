"""Registered queries: state after events, pools, reports, log probabilities, checks, planner formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, tools, validate
from ..operators import logprobs, planner, pools, reports, state
from ..sources.tables import cache_events, table, trace_blocks
from .registry import _EVENTS, _PATHS, WORKERS, _blocks_sql, _split, query

# ------------------------------------------------------------------ state after events

_INDEX = """clears AS (SELECT worker, max(event_id) AS c FROM ev WHERE kind = 'cleared' GROUP BY 1),
 idx AS (SELECT e.worker, e.block FROM ev e LEFT JOIN clears c ON e.worker = c.worker WHERE kind IN ('stored', 'removed') AND (c.c IS NULL OR event_id > c.c)
  GROUP BY 1, 2 HAVING max(event_id) = max(CASE WHEN kind = 'stored' THEN event_id END))"""


def _log(spark, sf):
    """Cache events in which one in fifty of the clears is one."""
    e = cache_events(spark, sf).withColumnRenamed("event_id", "at")
    return e.where("kind != 'cleared' or at % 50 = 0")


_LOG = _EVENTS.replace(" FROM events)", " FROM events WHERE event_type <> 'error' OR event_id % 50 = 0)")


@query(f"WITH {_LOG}, {_INDEX} SELECT worker, block FROM idx")
def index_from_events(spark, sf):
    return state.index(_log(spark, sf))


@query(f"WITH {_LOG}, {_INDEX} SELECT worker, block FROM idx WHERE worker NOT IN (SELECT worker FROM ev GROUP BY 1 HAVING count(*) % 2 = 0)")
def index_without_workers(spark, sf):
    gone = _log(spark, sf).groupBy("worker").agg(F.count("*").alias("n")).where("n % 2 = 0")
    return state.without_workers(state.index(_log(spark, sf)), gone)


@query(
    f"WITH {_blocks_sql(40)}, e AS (SELECT rid, list(hash ORDER BY pos) AS blocks FROM blocks GROUP BY 1) SELECT rid, len(blocks) AS n FROM e WHERE len(list_distinct(blocks)) = len(blocks) AND NOT list_contains(blocks, rid % 40)"
)
def store_refusals(spark, sf):
    b = trace_blocks(spark, sf, 40).groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("blocks"))
    return state.chains(b.withColumn("parent", F.col("rid") % 40)).select("rid", F.size("blocks").cast("long").alias("n"))


@query("SELECT l_partkey AS hash, min(l_orderkey * 10 + l_linenumber) AS kept FROM lineitem GROUP BY 1")
def register_reject(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("kept"))
    return state.register(rows, "hash", "kept", "reject").distinct()


@query(
    f"""WITH {_EVENTS}, s AS (SELECT worker AS source, event_id AS external, block AS sequence, event_id AS at, lag(event_id) OVER (PARTITION BY worker ORDER BY event_id) AS parent, lag(block) OVER (PARTITION BY worker ORDER BY event_id) AS parent_sequence FROM ev)
 SELECT source, external, sequence, min(external) OVER (PARTITION BY sequence) AS first, parent, parent_sequence FROM s"""
)
def canonical_hashes(spark, sf):
    e = cache_events(spark, sf)
    parent = F.lag("event_id").over(Window.partitionBy("worker").orderBy("event_id"))
    stores = e.select(F.col("worker").alias("source"), F.col("event_id").alias("external"), F.col("block").alias("sequence"), F.col("event_id").alias("at"), parent.alias("parent"))
    return state.canonical(stores).select("source", "external", "sequence", "first", "parent", "parent_sequence")


_ACTIVE = f"""{_blocks_sql(200)}, req AS (SELECT o_orderkey AS rid, o_orderkey % 8 AS worker, o_orderstatus = 'F' AS freed, o_orderstatus = 'P' AS prefilled FROM orders),
 now AS (SELECT worker, rid, NOT prefilled AS waiting FROM req WHERE NOT freed)"""


def _requests(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("rid"), (F.col("o_orderkey") % 8).alias("worker"), F.lit(True).alias("added"), (F.col("o_orderstatus") == "F").alias("freed"), (F.col("o_orderstatus") == "P").alias("prefilled"))


def _prompts(spark, sf):
    return trace_blocks(spark, sf, 200).groupBy("rid").agg((F.count("*") * 512).alias("isl")).withColumn("overlap", F.col("rid") % 4)


_LOADS = f"""{_ACTIVE}, prompts AS (SELECT rid, count(*) * 512 AS isl, rid % 4 AS overlap FROM blocks GROUP BY 1),
 held AS (SELECT worker, hash, count(DISTINCT rid) AS n FROM now JOIN blocks USING (rid) GROUP BY 1, 2)"""


@query(
    f"""WITH {_LOADS}, used AS (SELECT worker, CAST(round(sum(CASE WHEN n = 1 THEN 0.5 ELSE 1.0 END)) AS BIGINT) AS blocks FROM held GROUP BY 1)
 SELECT worker, count(*) AS requests, max(u.blocks) AS blocks, CAST(sum(CASE WHEN waiting THEN greatest(0, isl - overlap * 512) ELSE 0 END) AS BIGINT) AS tokens FROM now JOIN prompts USING (rid) JOIN used u USING (worker) GROUP BY 1"""
)
def active_load(spark, sf):
    return state.load(state.active(_requests(spark, sf)), trace_blocks(spark, sf, 200), _prompts(spark, sf), 512, F.lit(0.5))


@query(
    f"""WITH {_LOADS}, used AS (SELECT worker, count(*) AS blocks FROM held GROUP BY 1),
 loads AS (SELECT worker, max(u.blocks) AS blocks, CAST(sum(CASE WHEN waiting THEN greatest(0, isl - overlap * 512) ELSE 0 END) AS BIGINT) AS tokens FROM now JOIN prompts USING (rid) JOIN used u USING (worker) GROUP BY 1),
 asked AS (SELECT rid, count(DISTINCT hash) AS n FROM blocks JOIN req USING (rid) WHERE freed GROUP BY 1),
 shared AS (SELECT b.rid, h.worker, count(*) AS s FROM (SELECT DISTINCT rid, hash FROM blocks) b JOIN held h USING (hash) GROUP BY 1, 2)
 SELECT a.rid, l.worker, l.blocks + a.n - coalesce(s.s, 0) AS blocks, CAST(l.tokens + greatest(0, p.isl - p.overlap * 512) AS BIGINT) AS tokens FROM asked a CROSS JOIN loads l JOIN prompts p ON p.rid = a.rid LEFT JOIN shared s ON s.rid = a.rid AND s.worker = l.worker"""
)
def potential_load(spark, sf):
    blocks, requests = trace_blocks(spark, sf, 200), _requests(spark, sf)
    now = state.active(requests)
    held = now.join(blocks, "rid").select("worker", "hash").distinct()
    gone = requests.where("freed").select("rid")
    asked = blocks.join(gone, "rid").groupBy("rid").agg(F.collect_set("hash").alias("hashes")).join(_prompts(spark, sf), "rid")
    return state.potential(state.load(now, blocks, _prompts(spark, sf), 512), held, asked, 512)


@query(f"WITH {_EVENTS} SELECT block AS adapter, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) AS BIGINT) AS active FROM ev WHERE block IS NOT NULL GROUP BY 1")
def adapter_load(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "purchase", "free").otherwise("prefilled")
    return state.adapter_load(cache_events(spark, sf).select(F.col("block").alias("adapter"), kind.alias("kind")), "adapter")


@query(
    f"""WITH {_EVENTS}, s AS (SELECT ms // 86400000 AS tick, block AS key, count(*) AS n FROM ev GROUP BY 1, 2), f AS (SELECT key, min(tick) AS since FROM s GROUP BY 1),
 w AS (SELECT f.key, t.tick FROM f JOIN (SELECT DISTINCT tick FROM s) t ON t.tick >= f.since), c AS (SELECT w.key, w.tick, coalesce(n, 0) AS count FROM w LEFT JOIN s ON s.key = w.key AND s.tick = w.tick)
 SELECT key, tick, count FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tick DESC) AS k FROM c) WHERE k <= 10"""
)
def load_samples(spark, sf):
    s = cache_events(spark, sf).groupBy(F.expr("ms div 86400000").alias("tick"), F.col("block").alias("key")).agg(F.count("*").alias("count"))
    return state.load_series(s, 10)


@query(
    f"""WITH RECURSIVE {_EVENTS}, t AS (SELECT block, event_id, row_number() OVER (PARTITION BY block ORDER BY event_id) AS k FROM ev),
 r AS (SELECT block, event_id, k, CAST(1 AS BIGINT) AS n FROM t WHERE k = 1 UNION ALL
  SELECT t.block, t.event_id, t.k, CASE WHEN r.n - (t.event_id // 200 - r.event_id // 200) > 0 THEN least((r.n - (t.event_id // 200 - r.event_id // 200)) * 2, 1099511627776) ELSE 1 END FROM r JOIN t ON t.block = r.block AND t.k = r.k + 1)
 SELECT block, arg_max(n, k) AS count, arg_max(n, k) >= 8 AS offload FROM r GROUP BY 1"""
)
def frequency_gate(spark, sf):
    return state.frequency_gate(cache_events(spark, sf).select("block", "event_id"), "block", "event_id", 200, 8)


@query(
    """WITH b AS (SELECT min(event_id) AS a, max(event_id) AS z FROM events WHERE event_id >= 300 AND event_id < 900), q AS (SELECT p_partkey, CASE WHEN p_size > 3 THEN p_partkey * 7 END AS s, CASE WHEN p_size % 5 > 0 THEN p_partkey * 7 + p_size - 6 END AS e FROM part),
 o AS (SELECT *, CASE WHEN s IS NOT NULL AND e IS NOT NULL AND e < s THEN 'invalid_range' WHEN s IS NULL THEN 'tree_dump' WHEN s > z THEN 'too_new' WHEN s < a THEN 'tree_dump' ELSE 'events' END AS outcome FROM q, b)
 SELECT p_partkey, outcome, CASE WHEN outcome = 'events' THEN s END AS begin, CASE WHEN outcome = 'events' THEN least(coalesce(e, z), z) END AS stop FROM o"""
)
def event_ranges(spark, sf):
    asked = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_partkey") * 7).alias("s"), F.when(F.col("p_size") % 5 > 0, F.col("p_partkey") * 7 + F.col("p_size") - 6).alias("e"))
    buffer = table(spark, sf, "events").where("event_id >= 300 and event_id < 900")
    return state.in_range(buffer, F.col("s"), F.col("e"), asked, "event_id").select("p_partkey", "outcome", "begin", "stop")


# ------------------------------------------------------------------ pools and match variants


def _pools(spark, sf):
    b = trace_blocks(spark, sf, 300)
    return b.where("rid % 4 = 0"), b.where("rid % 4 = 1"), b.where("rid % 4 >= 2")


_POOLS = f"""{_blocks_sql(300)}, act AS (SELECT DISTINCT hash FROM blocks WHERE rid % 4 = 0 AND hash % 3 > 0), ina AS (SELECT DISTINCT hash FROM blocks WHERE rid % 4 = 1 AND hash % 5 > 1),
 asked AS (SELECT * FROM blocks WHERE rid % 4 >= 2), known AS (SELECT * FROM act UNION SELECT * FROM ina),
 run AS (SELECT rid, coalesce(min(CASE WHEN k.hash IS NULL THEN pos END), count(*)) AS depth, count(*) AS n FROM asked a LEFT JOIN known k ON a.hash = k.hash GROUP BY 1)"""


@query(f"WITH {_POOLS} SELECT rid, depth FROM run")
def pool_match(spark, sf):
    a, i, q = _pools(spark, sf)
    return pools.pool_match(a.where("hash % 3 > 0"), i.where("hash % 5 > 1"), q)


@query(f"WITH {_POOLS} SELECT DISTINCT a.hash, CASE WHEN a.hash IN (SELECT hash FROM act) THEN 'active' ELSE 'inactive' END AS pool FROM asked a WHERE a.hash IN (SELECT hash FROM known)")
def pool_scan(spark, sf):
    a, i, q = _pools(spark, sf)
    return pools.scan(a.where("hash % 3 > 0"), i.where("hash % 5 > 1"), q)


@query("SELECT DISTINCT l_partkey AS hash, l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'R')) AS present FROM lineitem")
def presence_any(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("hash"), F.col("l_returnflag").alias("kind"))
    return pools.presence_any(rows, rows, ["A", "R"])


@query(f"WITH {_POOLS} SELECT rid, n - depth AS new_blocks, n * 60 - least(depth * 64, n * 60) AS new_tokens FROM run")
def prefill_cost(spark, sf):
    a, i, q = _pools(spark, sf)
    held = a.where("hash % 3 > 0").select("hash").unionByName(i.where("hash % 5 > 1").select("hash"))
    return pools.prefill_cost(held, q, q.groupBy("rid").agg((F.count("*") * 60).alias("isl")), 64)


_N = "n AS (SELECT rid, count(*) AS n FROM blocks WHERE rid % 2 = 1 GROUP BY 1)"


@query(f"WITH {_PATHS}, {_N} SELECT d.rid, d.worker, d.depth AS leaves_at, d.depth = n.n AS whole FROM depth d JOIN n USING (rid)")
def drain_scan(spark, sf):
    return pools.drain(*_split(spark, sf))


@query(
    f"""WITH {_PATHS}, k AS (SELECT rid, list(depth ORDER BY depth DESC, worker DESC) AS d FROM depth GROUP BY 1)
 SELECT rid, worker, least(depth, CASE WHEN len(d) > 1 THEN least(d[1], d[2] + 1) ELSE 1 END) AS depth FROM depth JOIN k USING (rid)"""
)
def early_exit_match(spark, sf):
    return pools.early_exit(*_split(spark, sf))


@query(f"WITH {_PATHS} SELECT p.rid, p.pos, CAST(count(*) AS BIGINT) AS n FROM paths p JOIN idx i USING (path) WHERE p.rid % 2 = 1 GROUP BY 1, 2")
def sharded_frequencies(spark, sf):
    index, asked = _split(spark, sf)
    return pools.frequencies([index.where(f"worker % 2 = {i}") for i in range(2)], asked)


@query(f"WITH {_PATHS}, q AS (SELECT DISTINCT rid FROM paths WHERE rid % 2 = 1) SELECT q.rid, w.worker, coalesce(d.depth, 0) AS depth FROM q CROSS JOIN (SELECT DISTINCT worker FROM idx) w LEFT JOIN depth d ON d.rid = q.rid AND d.worker = w.worker")
def match_all_workers(spark, sf):
    index, asked = _split(spark, sf)
    shards = [index.where(f"worker % {WORKERS} = {i}") for i in range(WORKERS)]
    return pools.for_all(index, pools.sharded(shards, asked), asked, state.few)


# ------------------------------------------------------------------ reports

_RANK = "arg_min(v, v) FILTER (upto > n * {q} // 100)"


def _rank_sql(source: str, key: str) -> str:
    return f"""c AS (SELECT {key}, v, count(*) AS c FROM {source} GROUP BY 1, 2), u AS (SELECT *, sum(c) OVER (PARTITION BY {key} ORDER BY v) AS upto, sum(c) OVER (PARTITION BY {key}) AS n FROM c)
 SELECT {key}, CAST(max(n) AS BIGINT) AS n, {", ".join(f"min(CASE WHEN upto > n * {q} // 100 THEN v END) AS p{q}" for q in (50, 95, 99))} FROM u GROUP BY 1"""


@query(f"WITH {_EVENTS}, s AS (SELECT ms // 3600000 AS bucket, value AS v FROM ev), {_rank_sql('s', 'bucket')}")
def bucket_latency(spark, sf):
    return reports.bucket_stats(cache_events(spark, sf), "ms", "value", 3_600_000)


@query(f"WITH s AS (SELECT turn, length(text) AS v FROM conversations WHERE role = 'assistant'), {_rank_sql('s', 'turn')}")
def turn_latency(spark, sf):
    c = table(spark, sf, "conversations").withColumn("v", F.length("text").cast("long"))
    return reports.turn_stats(c, "turn", "v", F.col("role") == "assistant")


@query("SELECT o_orderpriority, list(o_totalprice ORDER BY o_totalprice)[count(*) // 2 + 1] AS median FROM orders GROUP BY 1")
def upper_median(spark, sf):
    return reports.upper_median(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


_SERVED = """r AS (SELECT l_linestatus, l_returnflag <> 'R' AS ok, l_partkey AS input, CAST(l_quantity AS BIGINT) AS output, l_tax * 1000 AS ttft, l_tax * 1000 + l_quantity * 20 * (1 + l_discount) AS latency FROM lineitem),
 t AS (SELECT *, CASE WHEN output > 1 THEN (latency - ttft) / (output - 1) ELSE 0.0 END AS tpot FROM r WHERE ok)"""


@query(
    f"""WITH {_SERVED} SELECT l_linestatus, count(*) AS completed, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, round(count(*) / 600.0, 6) AS rps, round(sum(output) / 600.0, 6) AS tps,
 round(count(CASE WHEN ttft <= 50 AND tpot <= 22 THEN 1 END) / 600.0, 6) AS goodput, {", ".join(f"round({f}({c}), 4) AS {n}_{c}" for c in ("ttft", "tpot", "latency") for n, f in (("mean", "avg"), ("std", "stddev_pop")))} FROM t GROUP BY 1"""
)
def serving_report(spark, sf):
    ttft = F.col("l_tax") * 1000
    r = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_returnflag") != "R").alias("ok"), F.col("l_partkey").alias("input"), F.col("l_quantity").cast("long").alias("output"), ttft.alias("ttft"), (ttft + F.col("l_quantity") * 20 * (1 + F.col("l_discount"))).alias("latency"))
    s = reports.serving(r, "l_linestatus", 600.0, 50, 22)
    return s.select(*[F.round(c, 6).alias(c) if c in ("rps", "tps", "goodput") else F.round(c, 4).alias(c) if "_" in c and c != "l_linestatus" else F.col(c) for c in s.columns])


_FAULT = "TIMESTAMP '1995-06-17'"


@query(
    "SELECT o_orderpriority, "
    + ", ".join(
        f"count(CASE WHEN {side} AND {ok} THEN 1 END) AS {n}_ok, count(CASE WHEN {side} AND NOT {ok} THEN 1 END) AS {n}_failed, round(avg(CASE WHEN {side} AND {ok} THEN o_totalprice END), 4) AS {n}_mean, round(stddev_samp(CASE WHEN {side} AND {ok} THEN o_totalprice END), 4) AS {n}_std, count(CASE WHEN {side} AND {ok} AND o_totalprice > 200000 THEN 1 END) AS {n}_violations"
        for n, side, ok in (("before", f"o_orderdate <= {_FAULT}", "(o_orderstatus <> 'P')"), ("after", f"o_orderdate > {_FAULT}", "(o_orderstatus <> 'P')"))
    )
    + " FROM orders GROUP BY 1"
)
def fault_report(spark, sf):
    s = reports.around_fault(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", F.lit("1995-06-17").cast("timestamp"), F.col("o_orderstatus") != "P", "o_totalprice", 200_000)
    return s.select(*[F.round(c, 4).alias(c) if c.endswith(("mean", "std")) else F.col(c) for c in s.columns])


@query(f"WITH {_EVENTS} SELECT worker, CASE WHEN max(ms) FILTER (kind = 'add') > 1e9 * (worker + 1000) THEN max(ms) FILTER (kind = 'add') - CAST(1e9 * (worker + 1000) AS BIGINT) END AS recovery FROM ev WHERE kind = 'add' GROUP BY 1")
def recovery_time(spark, sf):
    return reports.recovery(cache_events(spark, sf).where("kind = 'add'"), "worker", "ms", ((F.col("worker") + 1000) * 1_000_000_000).cast("long"))


_COUNTER = f"{_EVENTS}, c AS (SELECT worker, user_id, event_type, event_id, ms, sum(block) OVER w AS total, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


def _counter(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return cache_events(spark, sf).withColumn("total", F.sum("block").over(w)).withColumn("n", F.count("*").over(w))


@query(
    f"""WITH {_COUNTER}, e AS (SELECT worker, user_id, CAST(arg_max(total, event_id) - arg_min(total, event_id) AS DOUBLE) AS s, arg_max(n, event_id) - arg_min(n, event_id) AS n FROM c GROUP BY 1, 2)
 SELECT worker, round(coalesce(avg(CASE WHEN n > 0 THEN s / n END), 0), 6) AS mean, CAST(sum(n) AS BIGINT) AS requests FROM e GROUP BY 1"""
)
def counter_average(spark, sf):
    return reports.average_of(_counter(spark, sf), "worker", "user_id", "event_id", "total", "n").select("worker", F.round("mean", 6).alias("mean"), "requests")


@query(
    f"""WITH {_EVENTS}, v AS (SELECT worker, user_id, event_id, ms, CAST(block AS DOUBLE) AS v, lag(CAST(block AS DOUBLE)) OVER (PARTITION BY worker, user_id ORDER BY ms, event_id) AS p FROM ev),
 s AS (SELECT worker, user_id, ms // 86400000 AS step, sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END) / 86400 AS rate FROM v GROUP BY 1, 2, 3) SELECT worker, step, round(sum(rate), 9) AS rate FROM s GROUP BY 1, 2"""
)
def counter_rates(spark, sf):
    e = cache_events(spark, sf).withColumn("v", F.col("block").cast("double"))
    return reports.sum_rates(e, ["worker", "user_id"], ["worker"], "ms", "v", 86_400_000).select("worker", "step", F.round("rate", 9).alias("rate"))


@query(f"WITH {_EVENTS}, e AS (SELECT worker, event_type, arg_max(value, event_id) AS recent, avg(value) AS mean FROM ev GROUP BY 1, 2) SELECT event_type, round(avg(recent), 6) AS recent, round(avg(mean), 6) AS mean FROM e GROUP BY 1")
def recent_and_average(spark, sf):
    return reports.recent_and_average(cache_events(spark, sf), "worker", "event_type", "event_id", "value")[1].select("event_type", F.round("recent", 6).alias("recent"), F.round("mean", 6).alias("mean"))


@query("SELECT l_linestatus, round(100 - avg(l_discount) * 100, 6) AS busy FROM lineitem GROUP BY 1")
def busy_percent(spark, sf):
    return reports.busy_percent(table(spark, sf, "lineitem"), "l_linestatus", "l_discount").select("l_linestatus", F.round("busy", 6).alias("busy"))


@query("SELECT max(value) AS most, round(avg(value), 6) AS mean FROM events")
def gauge_summary(spark, sf):
    return reports.gauge(table(spark, sf, "events"), "value").select("most", F.round("mean", 6).alias("mean"))


@query(
    f"""WITH {_EVENTS}, d AS (SELECT worker, ms // 86400000 AS day, sum(CASE WHEN kind = 'stored' THEN 1 ELSE 0 END) AS h, sum(CASE WHEN kind <> 'stored' THEN 1 ELSE 0 END) AS m FROM ev GROUP BY 1, 2),
 s AS (SELECT worker, day * 86400000 AS ms, sum(h) OVER w AS hits, sum(m) OVER w AS misses FROM d WINDOW w AS (PARTITION BY worker ORDER BY day)),
 r AS (SELECT worker, ms, hits, misses, (hits - lag(hits) OVER w) / ((ms - lag(ms) OVER w) / 1000.0) AS hits_rate, hits - lag(hits) OVER w AS dh, misses - lag(misses) OVER w AS dm FROM s WINDOW w AS (PARTITION BY worker ORDER BY ms))
 SELECT worker, ms, CAST(hits AS BIGINT) AS hits, CAST(misses AS BIGINT) AS misses, round(hits_rate, 9) AS hits_rate, round(hits_rate - lag(hits_rate) OVER (PARTITION BY worker ORDER BY ms), 9) AS hits_gradient, round(CASE WHEN dh + dm > 0 THEN dh / (dh + dm) END, 9) AS hit_ratio FROM r"""
)
def pool_rates(spark, sf):
    w = Window.partitionBy("worker").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    d = cache_events(spark, sf).groupBy("worker", (F.expr("ms div 86400000") * 86400000).alias("ms")).agg(F.count(F.when(F.col("kind") == "stored", 1)).alias("h"), F.count(F.when(F.col("kind") != "stored", 1)).alias("m"))
    s = d.select("worker", "ms", F.sum("h").over(w).alias("hits"), F.sum("m").over(w).alias("misses"))
    r = reports.pool_rates(s, "worker", "ms", ["hits"], "hits", "misses")
    return r.select("worker", "ms", "hits", "misses", *[F.round(c, 9).alias(c) for c in ("hits_rate", "hits_gradient", "hit_ratio")])


@query(f"WITH {_EVENTS} SELECT worker, event_id, round(sum(block * 180.0 / 3600) OVER (PARTITION BY worker ORDER BY event_id), 6) AS gpu_hours FROM ev")
def gpu_hours(spark, sf):
    return reports.gpu_hours(cache_events(spark, sf), "worker", "event_id", F.col("block"), 180.0).select("worker", "event_id", F.round("gpu_hours", 6).alias("gpu_hours"))


@query("SELECT l_linestatus, round(CASE WHEN sum(l_quantity) > 0 THEN sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity) ELSE 0 END, 9) AS rate FROM lineitem GROUP BY 1")
def tier_hit_rates(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("hit", F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0))
    return reports.tier_hit_rates(rows, "l_linestatus", "hit", "l_quantity").select("l_linestatus", F.round("rate", 9).alias("rate"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_discount) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY 1, 2")
def label_ratio(spark, sf):
    r = reports.ratio(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice") * F.col("l_discount"), F.col("l_quantity"))
    return r.select("l_returnflag", "l_linestatus", F.round("ratio", 6).alias("ratio"))


@query("SELECT o_orderkey, round(o_totalprice * c_acctbal, 4) AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def phase_product(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("pod"), F.col("o_totalprice").alias("value"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("pod"), F.col("c_acctbal").alias("phase"))
    return reports.with_phase(o, c, ["pod"], "value", "phase").select("o_orderkey", F.round("value", 4).alias("value"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(text, 'th') AND contains(text, 'an')")
def log_lines(spark, sf):
    return reports.log_lines(table(spark, sf, "conversations").withColumn("line", F.col("text")), {"role": "user"}, "th", "an").select("conv_id", "turn")


@query(f"WITH {_EVENTS}, b AS (SELECT worker, min(ms) AS a, max(ms) AS z FROM ev GROUP BY 1) SELECT worker, event_id, (ms - a) * 60000 // (z - a) AS ms FROM ev JOIN b USING (worker)")
def rescaled_trace(spark, sf):
    return reports.rescale(cache_events(spark, sf).select("worker", "event_id", "ms"), "worker", "ms", 60_000).select("worker", "event_id", "ms")


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN round(p_retailprice / (p_size - 10), 6) ELSE 0.0 END AS per_gpu FROM part")
def per_gpu(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(reports.per_gpu(F.col("p_retailprice"), F.greatest(F.col("p_size") - 10, F.lit(0))), 6).alias("per_gpu"))


@query(f"WITH {_EVENTS} SELECT event_id AS concurrency, CAST(block AS DOUBLE) AS value FROM ev WHERE event_type <> 'error'")
def metric_series(spark, sf):
    e = cache_events(spark, sf)
    payload = F.when(F.col("event_type") == "error", F.lit('{"records": {}}')).otherwise(F.concat(F.lit('{"records": {"itl": {"avg": '), F.col("block").cast("string"), F.lit("}}}")))
    return reports.series(e.select(F.col("event_id").alias("concurrency"), payload.alias("json")), "records.itl")


@query(f"WITH {_EVENTS}, c AS (SELECT DISTINCT user_id, worker FROM ev), l AS (SELECT user_id, worker, sum(block) AS t FROM ev WHERE kind = 'stored' GROUP BY 1, 2) SELECT bool_and(coalesce(t, 0) > 0.01 * 100) AS all_busy FROM c LEFT JOIN l USING (user_id, worker)")
def all_workers_busy(spark, sf):
    e = cache_events(spark, sf).withColumn("rank", F.col("user_id"))
    loads = e.where("kind = 'stored'").groupBy("worker", "rank").agg(F.sum("block").alias("tokens"))
    return reports.all_busy(e.select("worker", "rank", F.lit(100).alias("capacity")).distinct(), loads, 0.01)


@query("SELECT a.p_brand, a.p_size, a.p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))")
def pareto_equals_kept(spark, sf):
    return reports.frontier_both(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice")


_OTHER = [(1.0, 900.0), (20.0, 1200.0), (50.0, 1000.0)]


@query(
    """WITH o AS (SELECT p_size AS x, p_retailprice AS y, CASE WHEN p_size <= 20 THEN 900 + (p_size - 1) * (300.0 / 19) ELSE 1200 + (p_size - 20) * (-200.0 / 30) END AS other FROM part WHERE p_size BETWEEN 5 AND 50 AND p_size >= 5)
 , g AS (SELECT x, y, CASE WHEN x <= 20 THEN 1200.0 ELSE other END AS other FROM o WHERE x >= 20), r AS (SELECT x, y, other, y / other AS ratio FROM g)
 SELECT x, y, round(other, 6) AS other, round(ratio, 9) AS ratio FROM r ORDER BY ratio DESC, x DESC LIMIT 1"""
)
def widest_gap(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return reports.widest(p, _OTHER, "x", "y", 5).select("x", "y", F.round("other", 6).alias("other"), F.round("ratio", 9).alias("ratio"))


# ------------------------------------------------------------------ log probabilities

_LP = """lp AS (SELECT vec_id, vec_id % 4 AS choice, list_transform(embedding[1:5], lambda x: CAST(-5 * abs(CAST(x AS DOUBLE)) AS DOUBLE)) AS t, -5 * abs(CAST(embedding[(vec_id % 9 + 1)::INT] AS DOUBLE)) AS s FROM embeddings),
 c AS (SELECT choice, vec_id AS position, list_sort(CASE WHEN vec_id % 9 < 5 THEN t ELSE list_append(t, s) END, 'DESC') AS l FROM lp),
 p AS (SELECT choice, position, l, l[1] - l[2] AS logprob_gap, exp(l[1]) - exp(l[2]) AS gap, 1 - list_sum(list_transform(l, lambda x: exp(x))) AS remaining FROM c)"""


def _positions(spark, sf):
    e = table(spark, sf, "embeddings")
    lp = lambda x: -5 * F.abs(x.cast("double"))
    top = F.transform(F.slice("embedding", 1, 5), lambda x, i: F.struct(lp(x).alias("logprob"), i.cast("string").alias("token")))
    at = (F.col("vec_id") % 9).cast("int")
    selected = F.struct(lp(F.get("embedding", at)).alias("logprob"), at.cast("string").alias("token"))
    return logprobs.closeness(e.select((F.col("vec_id") % 4).alias("choice"), F.col("vec_id").alias("position"), selected.alias("selected"), top.alias("top")))


@query(f"WITH {_LP} SELECT choice, position, round(logprob_gap, 9) AS logprob_gap, round(gap, 9) AS gap, round(remaining, 9) AS remaining, len(l) AS candidates FROM p")
def logprob_sensitivity(spark, sf):
    p = _positions(spark, sf)
    return p.select("choice", "position", *[F.round(c, 9).alias(c) for c in ("logprob_gap", "gap", "remaining")], F.size("candidates").cast("long").alias("candidates"))


@query(f"WITH {_LP} SELECT choice, position, round(gap, 9) AS gap FROM p WHERE gap <= 0.05")
def close_positions(spark, sf):
    return logprobs.close_positions(_positions(spark, sf), 0.05).select("choice", "position", F.round("gap", 9).alias("gap"))


@query(
    f"""WITH {_LP} SELECT choice, count(*) AS positions, round(100.0 * count(CASE WHEN gap <= 0.05 THEN 1 END) / count(*), 6) AS close_percent, round(100.0 * count(CASE WHEN gap < 0.01 OR gap > 0.05 THEN 1 END) / count(*), 6) AS greedy_percent,
 count(CASE WHEN gap < 0.01 OR gap > 0.05 THEN 1 END) / count(*) > 0.5 AS greedy FROM p GROUP BY 1"""
)
def logprob_report(spark, sf):
    return logprobs.report(_positions(spark, sf), 0.05).select("choice", "positions", F.round("close_percent", 6).alias("close_percent"), F.round("greedy_percent", 6).alias("greedy_percent"), "greedy")


@query(f"WITH {_LP}, k AS (SELECT choice, position, list_filter(l, lambda x: exp(l[1]) - exp(x) <= 0.1) AS n, l FROM p) SELECT choice, position, CAST(len(n) AS INTEGER) AS close, round(exp(l[1]) - exp(n[-1]), 9) AS spread FROM k WHERE len(n) > 2")
def several_close_tokens(spark, sf):
    return logprobs.several_close(_positions(spark, sf), 0.1).select("choice", "position", "close", F.round("spread", 9).alias("spread"))


@query(f"WITH {_LP} SELECT choice, CAST(k AS INTEGER) AS place, position FROM (SELECT *, row_number() OVER (PARTITION BY choice ORDER BY gap, position) AS k FROM p) WHERE k <= 5")
def closest_positions(spark, sf):
    return logprobs.closest(_positions(spark, sf), 5).select("choice", "place", "position")


# ------------------------------------------------------------------ checks of requests


@query(
    f"""WITH {_EVENTS}, v AS (SELECT event_id, value / 40 AS t, block / 90.0 AS p, block - 3 AS k, value / 30 - 2 AS f, value / 40 - 0.2 AS r, CASE WHEN block % 3 > 0 THEN block END AS n, block % 40 AS b FROM ev)
 SELECT event_id, concat_ws(',', CASE WHEN NOT t BETWEEN 0 AND 2 THEN 'temperature' END, CASE WHEN NOT p BETWEEN 0 AND 1 THEN 'top_p' END, CASE WHEN NOT (k = -1 OR k >= 1) THEN 'top_k' END, CASE WHEN NOT f BETWEEN -2 AND 2 THEN 'frequency_penalty' END,
  CASE WHEN NOT (r > 0 AND r <= 2) THEN 'repetition_penalty' END, CASE WHEN NOT p BETWEEN 0 AND 1 THEN 'min_p' END, CASE WHEN n IS NOT NULL AND NOT n BETWEEN 1 AND 128 THEN 'n' END, CASE WHEN n > 1 AND round(t, 1) = 0 THEN 'n_temperature' END, CASE WHEN round(t, 1) <> 1 AND round(p, 1) <> 1 THEN 'temperature_top_p' END,
  CASE WHEN NOT f BETWEEN -2 AND 2 THEN 'presence_penalty' END, CASE WHEN b * coalesce(n, 1) > 128 THEN 'total_choices' END, CASE WHEN NOT b BETWEEN 0 AND 20 THEN 'top_logprobs' END, CASE WHEN NOT b BETWEEN 0 AND 5 THEN 'logprobs' END,
  CASE WHEN NOT (b BETWEEN 0 AND 20 AND b >= coalesce(n, 1)) THEN 'best_of' END, CASE WHEN NOT k >= 1 THEN 'max_tokens' END) AS failed FROM v"""
)
def sampling_checks(spark, sf):
    e, v, c = cache_events(spark, sf), F.col("value"), F.col("block")
    n = F.when(c % 3 > 0, c)
    t, p, k, f, b = v / 40, c / 90.0, c - 3, v / 30 - 2, c % 40
    checks = [
        ("temperature", validate.in_range("temperature", t)),
        ("top_p", validate.in_range("top_p", p)),
        ("top_k", validate.top_k(k)),
        ("frequency_penalty", validate.in_range("frequency_penalty", f)),
        ("repetition_penalty", validate.repetition_penalty(v / 40 - 0.2)),
        ("min_p", validate.in_range("min_p", p)),
        ("n", validate.in_range("n", n)),
        ("n_temperature", validate.choices_vary(n, F.round(t, 1))),
        ("temperature_top_p", validate.one_sampler(F.round(t, 1), F.round(p, 1))),
        ("presence_penalty", validate.in_range("presence_penalty", f)),
        ("total_choices", validate.total_choices(b, n)),
        ("top_logprobs", validate.in_range("top_logprobs", b)),
        ("logprobs", validate.in_range("logprobs", b)),
        ("best_of", validate.best_of(b, n)),
        ("max_tokens", validate.at_least_one(k)),
    ]
    return e.select("event_id", validate.failed(checks).alias("failed"))


@query(
    """WITH w AS (SELECT conv_id, turn, role, text, string_split(text, ' ') AS w FROM conversations)
 SELECT conv_id, turn, concat_ws(',', CASE WHEN trim(w[1], ' ') = '' THEN 'model' END, CASE WHEN turn % 3 = 0 AND trim(w[2], ' ') = '' THEN 'user' END, CASE WHEN len(w) = 0 OR len(list_filter(w, lambda x: x = '')) > 0 THEN 'prompt' END, CASE WHEN len(w) > 32 OR len(list_filter(w, lambda x: x = '')) > 0 THEN 'stop' END,
  CASE WHEN len(list_filter(w, lambda x: strlen(x) > 96 OR trim(x, concat(' ', chr(9), chr(10), chr(13))) = '')) > 0 THEN 'tools' END, CASE WHEN turn > 0 THEN 'unsupported' END, CASE WHEN role <> 'user' AND (turn = 0 OR turn = 1) THEN 'response_format' END, CASE WHEN turn % 7 = 1 THEN 'reasoning_effort' END, CASE WHEN turn % 5 = 1 THEN 'service_tier' END,
  CASE WHEN length(text) > 100 THEN 'suffix' END, CASE WHEN turn % 2 = 1 OR (turn % 2 = 0 AND length(text) < 1) THEN 'logit_bias' END) AS failed FROM w"""
)
def content_checks(spark, sf):
    c = table(spark, sf, "conversations").withColumn("w", F.split("text", " "))
    t, lit = F.col("turn"), F.lit
    shape = F.struct(F.when(F.col("role") == "user", "text").otherwise("json_schema").alias("type"), F.lit("n").alias("name"), F.when(t > 1, "{}").alias("schema"))
    bias = F.create_map(lit("1"), F.when(t % 2 == 1, "101").when(F.length("text") < 1, "x").otherwise("-100"))
    checks = [
        ("model", validate.not_blank(F.col("w")[0])),
        ("user", validate.user(F.when(t % 3 == 0, F.get("w", lit(1))))),
        ("prompt", validate.prompt(F.col("w"))),
        ("stop", validate.stops(F.col("w"))),
        ("tools", validate.tools(F.col("w"))),
        ("unsupported", validate.no_unsupported(F.when(t > 0, F.array(lit("x"))).otherwise(F.array().cast("array<string>")))),
        ("response_format", validate.response_format(shape)),
        ("reasoning_effort", validate.one_of(F.when(t % 7 == 1, "most").otherwise("low"), validate.EFFORTS)),
        ("service_tier", validate.one_of(F.when(t % 5 == 1, "none"), validate.TIERS)),
        ("suffix", validate.suffix(F.col("text"), 100)),
        ("logit_bias", validate.logit_bias(bias)),
    ]
    return c.select("conv_id", "turn", validate.failed(checks).alias("failed"))


# ------------------------------------------------------------------ planner formulas


@query(
    f"""WITH {_EVENTS}, r AS (SELECT user_id, count(*) AS n, regr_slope(value, block) AS m, regr_intercept(value, block) AS b, min(CASE WHEN value < 40 THEN block END) AS f, min(block) AS l FROM ev GROUP BY 1)
 SELECT user_id, round(CASE WHEN n >= 5 THEN greatest(0.0, CASE WHEN m > 0 THEN (40.0 - b) / m ELSE coalesce(f, l) END) END, 4) AS most FROM r"""
)
def reverse_regression(spark, sf):
    return planner.reverse_regression(cache_events(spark, sf), "user_id", "block", "value", 40.0).select("user_id", F.round("most", 4).alias("most"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size * 4 <= 96 THEN p_size ELSE greatest(2, floor(p_size * (96.0 / (p_size * 4)))) END AS BIGINT) AS replicas FROM part")
def component_budget(spark, sf):
    return table(spark, sf, "part").select("p_partkey", planner.component_budget(F.col("p_size"), 4, 96, 2).cast("long").alias("replicas"))


@query(
    """SELECT p_partkey, CAST(CASE WHEN p_size < 2 OR floor(p_size * 0.3) = 0 THEN 0 ELSE least(greatest(floor(p_size * 0.3), 2), p_size) END AS BIGINT) AS thinking, CAST(least(10 * power(2, least(p_size, 8)), 2000) AS BIGINT) AS backoff,
 coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, CASE WHEN p_size % 3 = 0 THEN p_size * 24 END, 97) AS frames, least(p_partkey + 4294967000, 4294967295) AS usage, CAST(greatest(0, floor((80.0 - p_size) / 1.5)) AS BIGINT) AS batch, least(greatest(CAST(round_even((p_retailprice - 900) / 25, 0) AS INTEGER), 0), 31) AS cell FROM part"""
)
def planner_formulas(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        planner.thinking_tokens(s, 0.3).alias("thinking"),
        planner.backoff(s, 10, 8, 2000).alias("backoff"),
        planner.frames(F.when(s % 2 == 0, s), F.when(s % 3 == 0, s), F.lit(None).cast("int"), 24, 97).alias("frames"),
        planner.usage_total(F.col("p_partkey"), F.lit(4294967000)).alias("usage"),
        planner.max_batch(s, F.lit(1.5), 80.0).alias("batch"),
        planner.grid_index(F.col("p_retailprice"), 900, 25, 32).alias("cell"),
    )


@query(
    """WITH c AS (SELECT p_partkey, p_size, least(p_size * 8, 256) // (p_size % 4 + 1) AS e, p_size % 4 + 1 AS r FROM part)
 SELECT p_partkey, CASE WHEN e < 1 THEN [] WHEN e < 6 THEN list_transform(range(1, e + 1), lambda i: CAST(i * r AS INTEGER)) ELSE list_transform(range(0, 6), lambda i: CAST(r + CAST(floor(i * ((e - 1) * r / 5)) AS INTEGER) * r AS INTEGER)) END AS tried FROM c"""
)
def sweep_concurrencies(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", planner.concurrencies(s % 4 + 1, s * 8, 6, 256).alias("tried"))


@query(
    """WITH g AS (SELECT p_brand, p_size, min(p_retailprice) AS itl, count(*) AS thpt FROM part GROUP BY 1, 2), a AS (SELECT p_brand, max({'k': p_size, 'i': itl, 't': thpt}) AS a FROM g WHERE itl <= 1000 GROUP BY 1), b AS (SELECT p_brand, min({'k': p_size, 'i': itl, 't': thpt}) AS b FROM g GROUP BY 1)
 SELECT p_brand, coalesce(a.k, b.k) AS p_size, coalesce(a.i, b.i) AS itl, coalesce(a.t, b.t) AS thpt FROM b LEFT JOIN a USING (p_brand)"""
)
def best_cell(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.min("p_retailprice").alias("itl"), F.count("*").alias("thpt"))
    return planner.best_cell(g, ["p_brand"], "p_size", "itl", 1000)


# ------------------------------------------------------------------ text


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) ELSE '' END AS granite, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS r1 FROM conversations")
def reasoning_families(spark, sf):
    said = F.concat(F.when(F.col("turn") % 2 == 0, "Here is my thought process:x Here is my response:").otherwise("Here's my thought process:"), F.col("text"))
    r1 = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.col("text"), F.lit("</think>")))
    inner = text.reasoning_by("deepseek_r1", r1)
    c = table(spark, sf, "conversations").where("not contains(text, '</think>')")
    return c.select("conv_id", "turn", text.reasoning_by("granite", said)[0].alias("granite"), F.when(F.col("turn") % 2 == 0, inner[1]).otherwise(inner[0]).alias("r1"))


@query("SELECT conv_id, turn, contains(text, 'than') OR text LIKE '%t' OR text LIKE '%th' OR text LIKE '%tha' AS begins, CASE WHEN instr(text, 'the') > 0 THEN instr(text, 'the') + 2 ELSE length(text) END AS stop FROM conversations")
def call_markers(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tools.call_begins(F.col("text"), ["than"]).alias("begins"), tools.call_end(F.col("text"), "the").cast("long").alias("stop"))


@query(
    """WITH w AS (SELECT conv_id, turn, [{'start': 0, 'stop': 10}, {'start': 12, 'stop': 20}] AS r, CASE WHEN turn % 3 = 0 THEN [4, 6, 8] WHEN turn % 3 = 1 THEN [10, 3, 5] ELSE [4, 8, 6] END AS s FROM conversations)
 SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '0-4,4-10,12-20' WHEN 1 THEN '0-10,12-15,15-20' END AS items FROM w"""
)
def split_ranges(spark, sf):
    t = F.col("turn") % 3
    ranges = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((0, 10), (12, 20))])
    sizes = F.when(t == 0, F.array(*map(F.lit, (4, 6, 8)))).when(t == 1, F.array(*map(F.lit, (10, 3, 5)))).otherwise(F.array(*map(F.lit, (4, 8, 6))))
    items = text.split_ranges(ranges, sizes)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.transform(items, lambda i: F.concat_ws("-", i["start"].cast("string"), i["stop"].cast("string"))), ",").alias("items"))
