"""Further registered queries: selection, joins, text and planner formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, tools
from ..operators import planner, selection
from ..sources.tables import cache_events, table, trace_blocks, trace_requests
from .registry import _EVENTS, _REQUESTS, _blocks_sql, query


@query(f"WITH {_EVENTS} SELECT event_id, worker, greatest(event_id - block * 10, 0) AS effective, row_number() OVER (PARTITION BY worker ORDER BY greatest(event_id - block * 10, 0), event_id) AS place FROM ev")
def queue_order(spark, sf):
    q = selection.queue_order(cache_events(spark, sf), "worker", F.col("event_id"), F.col("block") * 10, "event_id")
    return q.select("event_id", "worker", "effective", "place")


@query(f"WITH {_EVENTS} SELECT event_id, row_number() OVER (PARTITION BY worker ORDER BY block DESC, event_id) AS place FROM ev")
def offload_order(spark, sf):
    return selection.offload_order(cache_events(spark, sf), "worker", "block", "event_id").select("event_id", "place")


@query(
    f"""WITH {_EVENTS}, p AS (SELECT worker, block, count(*) AS touches, max(event_id) AS last FROM ev GROUP BY 1, 2), l AS (SELECT *, CAST(touches >= 2 AS INTEGER) + CAST(touches >= 4 AS INTEGER) + CAST(touches >= 8 AS INTEGER) AS level FROM p)
 SELECT worker, block, touches, last, level, row_number() OVER (PARTITION BY worker, level ORDER BY last) AS place FROM l"""
)
def frequency_levels(spark, sf):
    return selection.frequency_levels(cache_events(spark, sf), ["worker", "block"], "event_id")


@query(f"WITH {_EVENTS}, k AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM ev) SELECT event_id, user_id FROM k WHERE n <= 20 OR k <= 16")
def index_prune(spark, sf):
    return selection.prune(cache_events(spark, sf).select("event_id", "user_id"), "user_id", "event_id", 20, 0.8)


@query(f"WITH {_EVENTS} SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 5 AS worker FROM ev")
def round_robin(spark, sf):
    return selection.round_robin(cache_events(spark, sf).drop("worker"), "event_type", "event_id", 5).select("event_id", F.col("worker").cast("long").alias("worker"))


@query("SELECT p_partkey, round(2 * (p_size / 50.0) - p_retailprice / 2000 - p_size * 1.0 / max(p_size) OVER (PARTITION BY p_brand), 9) AS score FROM part")
def routing_score(spark, sf):
    most = F.max("p_size").over(Window.partitionBy("p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.round(selection.score(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000, F.col("p_size"), most), 9).alias("score"))


@query(
    """WITH a AS (SELECT p_brand, max({'t': p_size, 'l': p_retailprice}) AS a FROM part WHERE p_retailprice <= 1000 GROUP BY 1), b AS (SELECT p_brand, min({'l': p_retailprice, 't': p_size}) AS b FROM part GROUP BY 1)
 SELECT p_brand, coalesce(a.l, b.l) AS p_retailprice, coalesce(a.t, b.t) AS p_size FROM b LEFT JOIN a USING (p_brand)"""
)
def config_choice(spark, sf):
    return selection.choose(table(spark, sf, "part"), "p_brand", "p_retailprice", "p_size", 1000)


@query(f"WITH {_EVENTS}, p AS (SELECT block, worker, max(event_id) AS last FROM ev GROUP BY 1, 2) SELECT block, max(last) AS removed_at, count(*) AS sources FROM p GROUP BY 1")
def last_sources(spark, sf):
    return selection.last_sources(cache_events(spark, sf), "block", "worker", "event_id")


@query(
    """WITH r AS (SELECT l_orderkey AS rid, l_partkey AS image, l_partkey % 97 AS start, l_partkey % 97 + CAST(l_quantity AS BIGINT) AS stop FROM lineitem),
 b AS (SELECT DISTINCT l_orderkey AS rid, unnest([0, 16, 32, 48, 64, 80, 96, 112, 128]) AS b_start FROM lineitem)
 SELECT r.rid, image, start, stop, b_start FROM r JOIN b ON r.rid = b.rid AND b_start + 16 > start AND b_start < stop"""
)
def interval_overlap(spark, sf):
    rows = table(spark, sf, "lineitem")
    images = rows.select(F.col("l_orderkey").alias("rid"), F.col("l_partkey").alias("image"), (F.col("l_partkey") % 97).alias("start"), (F.col("l_partkey") % 97 + F.col("l_quantity").cast("long")).alias("stop"))
    starts = F.explode(F.array(*[F.lit(16 * i).cast("int") for i in range(9)])).alias("b_start")
    b = rows.select(F.col("l_orderkey").alias("rid")).distinct().select("rid", starts).withColumn("b_stop", F.col("b_start") + 16)
    return selection.overlaps(images, b, "rid", 64).select("rid", "image", "start", "stop", "b_start")


@query("SELECT p_partkey, least(greatest(CAST(trunc((p_retailprice - 950) / 800 * 12) AS INTEGER), 0), 11) AS cell FROM part")
def nearest_cell(spark, sf):
    return table(spark, sf, "part").select("p_partkey", selection.nearest_cell(F.col("p_retailprice"), 950, 1750, 12).alias("cell"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey BETWEEN 16 AND 65536 AND (l_partkey & (l_partkey - 1)) = 0 GROUP BY 1")
def position_class(spark, sf):
    return table(spark, sf, "lineitem").where(selection.position_class(F.col("l_partkey"))).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, [role, 'then'] AS names, concat('{\"turn\":', turn, '}') AS first_arguments, trim(text, concat(' ', chr(9), chr(10), chr(13))) AS rest FROM conversations")
def tool_call_json(spark, sf):
    c = table(spark, sf, "conversations")
    first = F.concat(F.lit('<tool_call>{"name": "'), F.col("role"), F.lit('", "arguments": {"turn":'), F.col("turn").cast("string"), F.lit("}}</tool_call>"))
    said = F.concat(first, F.col("text"), F.lit('<tool_call>\n[{"name": "then", "parameters": {}}]\n</tool_call><tool_call>no call</tool_call>'))
    t = c.select("conv_id", "turn", tools.tool_calls(said).alias("t"))
    return t.select("conv_id", "turn", F.transform("t.calls", lambda x: x["name"]).alias("names"), F.col("t.calls")[0]["arguments"].alias("first_arguments"), "t.rest")


@query(f"WITH {_EVENTS} SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE block END AS tokens, CAST(worker AS INTEGER) AS c FROM ev")
def telemetry_fields(spark, sf):
    e = cache_events(spark, sf)
    payload = F.when(F.col("event_type") == "error", F.lit("{}")).otherwise(F.concat(F.lit('{"usage": {"completion_tokens": '), F.col("block").cast("string"), F.lit("}}")))
    path = F.concat(F.lit("runs/c"), F.col("worker").cast("string"), F.lit("/profile.json"))
    return e.select("event_id", tools.output_tokens(payload).alias("tokens"), tools.concurrency(path).alias("c"))


@query(
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), n AS (SELECT doc_id, t, len(t) // 16 AS n, len(t) % 16 AS rest FROM w)
 SELECT doc_id, n AS blocks, rest AS partial, CASE WHEN n > 0 THEN md5(array_to_string(t[1:16], ' ')) END AS first_block, CASE WHEN n > 0 THEN md5(array_to_string(t[(n - 1) * 16 + 1 : n * 16], ' ')) END AS last_block FROM n"""
)
def token_blocks(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("t"))
    b = w.select("doc_id", F.size("t").alias("n"), tools.blocks(F.col("t"), 16).alias("b"))
    whole = F.expr("n div 16")
    hashed = lambda i: F.when(whole > 0, F.md5(F.array_join(F.element_at("b", i), " ")))
    return b.select("doc_id", whole.alias("blocks"), (F.col("n") % 16).cast("long").alias("partial"), hashed(1).alias("first_block"), hashed(-1).alias("last_block"))


@query("SELECT o_orderpriority, round(100.0 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 6) AS percent FROM orders GROUP BY 1")
def success_percent(spark, sf):
    ok = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(100.0 * ok / F.count("*"), 6).alias("percent"))


@query(f"WITH {_EVENTS} SELECT worker, kind, event_type, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def request_counters(spark, sf):
    return cache_events(spark, sf).groupBy("worker", "kind", "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {_REQUESTS}, {_blocks_sql(50)}, b AS (SELECT rid, count(*) AS n, count(DISTINCT hash) AS d FROM blocks GROUP BY 1) SELECT rid, round(1 - CAST(d AS DOUBLE) / n, 9) AS hit_rate, round(input_length / greatest(output_length - 1, 1.0), 6) AS per_token FROM requests JOIN b USING (rid)")
def request_hit_rate(spark, sf):
    b = trace_blocks(spark, sf).groupBy("rid").agg(F.count("*").alias("n"), F.countDistinct("hash").alias("d"))
    return trace_requests(spark, sf).join(b, "rid").select("rid", F.round(1 - F.col("d") / F.col("n"), 9).alias("hit_rate"), F.round(F.col("input_length") / F.greatest(F.col("output_length") - 1, F.lit(1.0)), 6).alias("per_token"))


@query(f"WITH {_EVENTS}, d AS (SELECT event_type, block, count(*) AS n FROM ev GROUP BY 1, 2) SELECT event_type, block, round(CAST(sum(n) OVER (PARTITION BY event_type ORDER BY block ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER (PARTITION BY event_type), 9) AS cdf FROM d")
def empirical_cdf(spark, sf):
    w = Window.partitionBy("event_type")
    d = cache_events(spark, sf).groupBy("event_type", "block").agg(F.count("*").alias("n"))
    return d.select("event_type", "block", F.round(F.sum("n").over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w), 9).alias("cdf"))


@query(f"WITH {_EVENTS} SELECT user_id, event_id, round(CAST(sum(block) OVER w AS DOUBLE) / sum(block + 10) OVER w, 9) AS hit_rate FROM ev WHERE block > 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def sliding_hit_rate(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    return cache_events(spark, sf).where("block > 0").select("user_id", "event_id", F.round(F.sum("block").over(w) / F.sum(F.col("block") + 10).over(w), 9).alias("hit_rate"))


@query(f"WITH {_EVENTS} SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM ev")
def rolling_mean(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    return cache_events(spark, sf).select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


_ZEROS = "CASE WHEN block % 3 = 0 THEN 0.0 WHEN block % 7 = 1 THEN 'nan'::DOUBLE ELSE value END"


@query(
    f"""WITH {_EVENTS}, v AS (SELECT user_id, event_id, {_ZEROS} AS v FROM ev), z AS (SELECT user_id, event_id, CASE WHEN isnan(v) THEN 0.0 ELSE v END AS v FROM v),
 f AS (SELECT user_id, min(CASE WHEN v <> 0 THEN event_id END) AS first FROM z GROUP BY 1) SELECT user_id, coalesce(arg_max(v, event_id) FILTER (event_id >= first), 0.0) AS forecast FROM z JOIN f USING (user_id) GROUP BY 1"""
)
def last_value_forecast(spark, sf):
    v = F.when(F.col("block") % 3 == 0, 0.0).when(F.col("block") % 7 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return planner.forecast_last(cache_events(spark, sf).select("user_id", "event_id", v.alias("v")), "user_id", "event_id", "v")


@query("WITH p AS (SELECT p_size AS x, min(p_retailprice) AS c FROM part WHERE p_size <= 25 GROUP BY 1), d AS (SELECT p_size AS y, min(p_retailprice) AS c FROM part WHERE p_size > 25 GROUP BY 1) SELECT x, y, round(1000.0 / x * p.c / 3600 + 1000.0 / y * d.c / 3600, 6) AS gpu_hours FROM p CROSS JOIN d")
def cost_cross(spark, sf):
    part = table(spark, sf, "part")
    p = part.where("p_size <= 25").groupBy(F.col("p_size").alias("x")).agg(F.min("p_retailprice").alias("a"))
    d = part.where("p_size > 25").groupBy(F.col("p_size").alias("y")).agg(F.min("p_retailprice").alias("b"))
    return planner.cost_pairs(p, d).select("x", "y", F.round("gpu_hours", 6).alias("gpu_hours"))


@query("SELECT l_orderkey, l_partkey, round(0.00001 * l_quantity * l_quantity + 0.02 * l_quantity + 5, 6) AS prefill_ms, round(4 + 0.01 * l_quantity + 0.0001 * l_extendedprice, 6) AS decode_ms FROM lineitem")
def timing_polynomials(spark, sf):
    q = F.col("l_quantity")
    prefill, decode = planner.timing(q, 0.00001, 0.02, 5), planner.decode_timing(q, F.col("l_extendedprice"), 4, 0.01, 0.0001)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.round(prefill, 6).alias("prefill_ms"), F.round(decode, 6).alias("decode_ms"))


@query("SELECT conv_id, turn, concat_ws(',', CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN trim(text, ' ') = '' THEN 'text' END, CASE WHEN length(text) > 200 THEN 'length' END, CASE WHEN turn > 6 THEN 'turn' END) AS violations FROM conversations")
def message_violations(spark, sf):
    checks = [("role", F.col("role").isin("user", "assistant")), ("text", F.trim("text") != ""), ("length", F.length("text") <= 200), ("turn", F.col("turn") <= 6)]
    return table(spark, sf, "conversations").select("conv_id", "turn", text.violations(checks).alias("violations"))


@query("SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def chat_prompt(spark, sf):
    m = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("m"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(m, lambda x: x["m"]), "\n").alias("prompt"))


@query("SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN NULL ELSE length(text) END AS delay FROM conversations")
def session_delay(spark, sf):
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(~first, F.length("text")).cast("long").alias("delay"))


@query(f"WITH {_EVENTS}, p AS (SELECT worker, event_id, block FROM ev WHERE kind = 'stored'), c AS (SELECT worker, event_id, block, lag(block) OVER (PARTITION BY worker ORDER BY event_id) AS parent FROM p) SELECT c.worker, c.event_id, c.block, c.parent FROM c WHERE parent IS NULL OR EXISTS (SELECT 1 FROM p WHERE p.worker = c.worker AND p.block = c.parent)")
def parent_resolution(spark, sf):
    p = cache_events(spark, sf).where("kind = 'stored'").select("worker", "event_id", "block")
    c = p.withColumn("parent", F.lag("block").over(Window.partitionBy("worker").orderBy("event_id")))
    known = p.select("worker", F.col("block").alias("parent")).distinct().withColumn("_k", F.lit(True))
    return c.join(known, ["worker", "parent"], "left").where("parent is null or _k").select("worker", "event_id", "block", "parent")


@query("SELECT p_partkey, round(CASE WHEN p_size > 3 THEN p_retailprice / (p_size * 40.0) ELSE 1.0 END, 9) AS correction FROM part")
def correction_factor(spark, sf):
    expected = F.when(F.col("p_size") > 3, F.col("p_size") * 40.0).otherwise(F.lit(0.0))
    return table(spark, sf, "part").select("p_partkey", F.round(planner.correction(F.col("p_retailprice"), expected), 9).alias("correction"))


_CURVE = [(0.0, 1.0), (60_000.0, 1.3), (150_000.0, 2.4), (250_000.0, 2.9), (400_000.0, 5.0)]


def _spline_sql(x: str) -> str:
    """Each stretch's cubic, its powers written out."""
    pieces = planner.spline(_CURVE)
    x = f"greatest(least({x}, {_CURVE[-1][0]}), {_CURVE[0][0]})"
    cases = " ".join(f"WHEN {x} < {end} THEN {c[0]!r} + ({x} - {x0}) * {c[1]!r} + power({x} - {x0}, 2) * {c[2]!r} + power({x} - {x0}, 3) * {c[3]!r}" for (x0, c), (end, _) in zip(pieces[:-1], _CURVE[1:]))
    x0, c = pieces[-1]
    return f"CASE {cases} ELSE {c[0]!r} + ({x} - {x0}) * {c[1]!r} + power({x} - {x0}, 2) * {c[2]!r} + power({x} - {x0}, 3) * {c[3]!r} END"


@query(f"SELECT o_orderkey, round({_spline_sql('o_totalprice')}, 6) AS itl FROM orders")
def decode_interpolation(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(planner.cubic(F.col("o_totalprice"), _CURVE), 6).alias("itl"))
