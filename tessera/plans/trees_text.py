"""Registered queries: the prefix tree, token sequences, stops, tool formats, reproducible draws."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stops, text, tokens, tool_formats
from ..operators import folds, policies, sampling, trace, tree
from ..sources.tables import cache_events, table, trace_blocks
from .registry import _EVENTS, _blocks_sql, query

# ------------------------------------------------------------------ prefix tree

_TREE = f"""{_blocks_sql(5)}, paths AS (SELECT rid, pos, array_to_string(list(hash) OVER (PARTITION BY rid ORDER BY pos), '/') AS path, max(pos) OVER (PARTITION BY rid) AS last FROM blocks),
 nodes AS (SELECT path, max(pos) AS pos, count(*) AS visited, sum(CASE WHEN pos = last THEN 1 ELSE 0 END) AS ended, CASE WHEN max(pos) = 0 THEN 'root' ELSE regexp_replace(path, '/[0-9]+$', '') END AS parent FROM paths GROUP BY path),
 leafy AS (SELECT n.*, CASE WHEN visited > 1 THEN (SELECT count(*) FROM nodes c WHERE c.parent = n.path AND c.visited = 1) ELSE 0 END AS to_leaf FROM nodes n)"""


def _paths(spark, sf):
    return trace.normalise(trace_blocks(spark, sf, 5))


@query(f"WITH {_TREE} SELECT pos, count(*) AS nodes, CAST(sum(visited) AS BIGINT) AS visits, CAST(sum(ended) AS BIGINT) AS ended, CAST(sum(to_leaf) AS BIGINT) AS to_leaf FROM leafy GROUP BY 1")
def tree_to_leaf(spark, sf):
    t = tree.to_leaf(tree.nodes(_paths(spark, sf)))
    return t.groupBy("pos").agg(F.count("*").alias("nodes"), F.sum("visited").alias("visits"), F.sum("ended").alias("ended"), F.sum("to_leaf").alias("to_leaf"))


@query(f"WITH {_TREE} SELECT pos, visited, ended FROM nodes n WHERE visited <> ended + coalesce((SELECT sum(visited) FROM nodes c WHERE c.parent = n.path), 0)")
def tree_unbalanced(spark, sf):
    return tree.unbalanced(tree.nodes(_paths(spark, sf))).select("pos", "visited", "ended")


@query(f"WITH {_blocks_sql(40)}, up AS (SELECT hash AS path, coalesce(CAST(lag(hash) OVER (PARTITION BY rid ORDER BY pos) AS VARCHAR), 'root') AS parent FROM blocks) SELECT path, count(DISTINCT parent) AS parents FROM up GROUP BY 1 HAVING count(DISTINCT parent) > 1")
def several_parents(spark, sf):
    b = trace_blocks(spark, sf, 40)
    up = F.expr("lag(hash) over (partition by rid order by pos)").cast("string")
    return tree.several_parents(b.select(F.col("hash").alias("path"), F.coalesce(up, F.lit(tree.ROOT)).alias("parent")))


_RADIX = f"""{_TREE}, v AS (SELECT p.*, n.visited, CASE WHEN lag(n.visited) OVER w = n.visited THEN 0 ELSE 1 END AS new FROM paths p JOIN nodes n USING (path) WINDOW w AS (PARTITION BY rid ORDER BY p.pos)),
 r AS (SELECT rid, run, max(pos) AS pos, count(*) AS length, max(visited) AS visited, arg_max(path, pos) AS path FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS run FROM v) GROUP BY 1, 2),
 radix AS (SELECT DISTINCT path, pos, length, visited, run = 1 AS top FROM r)"""


@query(f"WITH {_RADIX} SELECT pos, length, visited, count(*) AS nodes FROM radix GROUP BY 1, 2, 3")
def tree_contracted(spark, sf):
    return tree.contracted(_paths(spark, sf)).groupBy("pos", "length", "visited").agg(F.count("*").alias("nodes"))


@query(f"WITH {_RADIX} SELECT length, count(*) AS leaves FROM radix WHERE visited = 1 GROUP BY 1")
def tree_cut_leaves(spark, sf):
    return tree.without_leaves(tree.contracted(_paths(spark, sf)))[1]


@query(f"WITH {_RADIX} SELECT length, count(*) AS nodes, list(visited ORDER BY visited DESC) AS visits FROM radix WHERE top AND visited >= 5 GROUP BY 1")
def tree_root_report(spark, sf):
    return tree.root_report(tree.contracted(_paths(spark, sf)))


@query(
    f"""WITH {_TREE}, e AS (SELECT parent AS path, 0 AS k, visited AS w FROM nodes WHERE visited > 1 AND parent <> 'root' UNION ALL SELECT path, 1, to_leaf FROM leafy WHERE visited > 1 UNION ALL SELECT path, 2, ended FROM leafy WHERE visited > 1),
 s AS (SELECT path, sum(CASE WHEN k = 0 THEN w ELSE 0 END) AS a, sum(CASE WHEN k <= 1 THEN w ELSE 0 END) AS b, sum(w) AS t FROM e GROUP BY 1)
 SELECT n.pos, n.visited, round(CASE WHEN t > 0 THEN b / t ELSE 0 END, 9) AS upto_leaf, CAST(CASE WHEN t > 0 THEN 1 ELSE 0 END AS DOUBLE) AS upto_end FROM s JOIN nodes n USING (path)"""
)
def tree_transitions(spark, sf):
    t = tree.to_leaf(tree.nodes(_paths(spark, sf)))
    at = lambda name: F.round(F.max(F.when(F.col("next") == name, F.col("cdf"))), 9)
    cdf = tree.transitions(t).groupBy("path").agg(at(tree.CACHE_END).alias("upto_leaf"), at(tree.END).alias("upto_end"))
    return cdf.join(t.select("path", "pos", "visited"), "path").select("pos", "visited", "upto_leaf", "upto_end")


@query(f"WITH {_TREE} SELECT count(*) AS nodes, CAST(sum(visited) AS BIGINT) AS visits, max(pos) + 1 AS depth FROM nodes")
def index_size(spark, sf):
    return tree.size(tree.nodes(_paths(spark, sf)))


# ------------------------------------------------------------------ token sequences


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey * 300 < 256 THEN 0 WHEN l_partkey * 300 < 65536 THEN 1 ELSE 2 END AS mode, CASE WHEN l_partkey * 300 < 256 THEN 54 WHEN l_partkey * 300 < 65536 THEN 46 ELSE 38 END AS bits FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, CAST(mode AS INTEGER) AS mode, CAST(CAST(mode AS HUGEINT) * 4611686018427387904 + CAST(l_partkey * 300 AS HUGEINT) * (CAST(1 AS HUGEINT) << bits) + l_orderkey - CASE WHEN mode >= 2 THEN CAST(18446744073709551616 AS HUGEINT) ELSE 0 END AS BIGINT) AS upper, l_partkey * 300 AS position FROM m"""
)
def positional_hash(spark, sf):
    at = F.col("l_partkey") * 300
    h = tokens.positional(F.col("l_orderkey"), at, F.col("l_orderkey"))
    t = table(spark, sf, "lineitem").withColumn("h", h)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", tokens.mode(at).alias("mode"), F.col("h.upper").alias("upper"), tokens.position_of(F.col("h")).alias("position"))


_SEQ = f"{_blocks_sql(50)}, s AS (SELECT rid, list(hash ORDER BY pos) AS t FROM blocks GROUP BY 1)"


def _sequences(spark, sf):
    return trace_blocks(spark, sf, 50).groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("t"))


@query(
    f"""WITH {_SEQ} SELECT rid, len(t) + 3 AS extended, len(t) // 2 AS first, (len(t) + 3) // 2 AS stop, t[1:2] AS truncated, CASE WHEN len(t) >= 3 THEN t[1:len(t) - 3] END AS unwound, t[2:3] AS part, len(t) // 2 AS whole, CASE WHEN len(t) % 2 = 1 THEN t[-1:] ELSE [] END AS rest FROM s"""
)
def token_sequences(spark, sf):
    t = F.col("t")
    e = tokens.extend(t, F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]), 2)
    return _sequences(spark, sf).select(
        "rid", F.size(e["tokens"]).cast("long").alias("extended"), e["first"].alias("first"), e["stop"].alias("stop"), tokens.truncate(t, F.lit(2)).alias("truncated"),
        tokens.unwind(t, F.lit(3)).alias("unwound"), tokens.part(t, F.lit(1), F.lit(3)).alias("part"), F.size(tokens.split(t, 2)["blocks"]).cast("long").alias("whole"), tokens.split(t, 2)["rest"].alias("rest"),
    )


@query(f"WITH {_SEQ}, r AS (SELECT rid, t, list_filter(range(len(t)), lambda i: t[i + 1] = 7) AS p FROM s) SELECT rid, list_transform(range(len(t)), lambda i: CASE WHEN t[i + 1] = 7 THEN -1 ELSE t[i + 1] END) AS t FROM r")
def replaced_ranges(spark, sf):
    s = _sequences(spark, sf)
    return s.select("rid", text.replace_ranges(F.col("t"), text.marker_ranges(F.col("t"), 7), F.lit(-1).cast("long")).alias("t"))


@query(f"WITH {_SEQ} SELECT rid, len(t) * 3 AS n, t[1] AS first, t[-1] AS last FROM s")
def trace_tokens(spark, sf):
    t = _sequences(spark, sf).select("rid", tokens.from_ids(F.col("t"), 3).alias("x"))
    return t.select("rid", F.size("x").cast("long").alias("n"), F.col("x")[0].alias("first"), F.element_at("x", -1).alias("last"))


# ------------------------------------------------------------------ stops


@query(
    """WITH w AS (SELECT conv_id, turn, concat(text, ' ') AS t, string_split(text, ' ') AS p FROM conversations), u AS (SELECT conv_id, turn, t, len(p) AS n, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM w),
 e AS (SELECT *, length(x) + 1 AS l, sum(length(x) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) AS z FROM u), b AS (SELECT *, z - l AS a FROM e),
 h AS (SELECT *, instr(substr(t, greatest(a - 2, 0)::INT + 1, (z - greatest(a - 2, 0))::INT), 'th ') AS th, instr(substr(t, greatest(a - 1, 0)::INT + 1, (z - greatest(a - 1, 0))::INT), '. ') AS dot FROM b),
 f AS (SELECT conv_id, turn, min(i) AS i FROM h WHERE i >= 3 AND (l = 9 OR th > 0 OR dot > 0) GROUP BY 1, 2)
 SELECT w.conv_id, w.turn, CAST(coalesce(f.i, len(w.p)) AS INTEGER) AS tokens, CASE WHEN f.i IS NULL THEN 'none' WHEN l = 9 THEN 'hidden id' WHEN th > 0 THEN 'hidden sequence' ELSE 'visible sequence' END AS reason,
  CASE WHEN f.i IS NULL THEN w.t WHEN l = 9 THEN left(w.t, a::INT) WHEN th > 0 THEN left(w.t, (greatest(a - 2, 0) + th - 1)::INT) ELSE left(w.t, (greatest(a - 1, 0) + dot + 1)::INT) END AS text
 FROM w LEFT JOIN f USING (conv_id, turn) LEFT JOIN h ON h.conv_id = w.conv_id AND h.turn = w.turn AND h.i = f.i"""
)
def stop_decoder(spark, sf):
    c = table(spark, sf, "conversations").withColumn("p", F.transform(F.split("text", " "), lambda x: F.concat(x, F.lit(" "))))
    # the length of a piece is its id
    s = stops.first_stop(c.withColumn("ids", F.transform("p", lambda x: F.length(x))), "p", "ids", 3, [9], [], ["th "], [". "])
    return s.select("conv_id", "turn", "stop.tokens", "stop.reason", "stop.text")


@query(
    """SELECT conv_id, turn, CASE WHEN instr(text, 'qua') > 0 THEN 'complete' WHEN text LIKE '%qu' OR text LIKE '%q' OR text LIKE '%e' THEN 'partial' ELSE 'none' END AS match,
 CASE WHEN instr(text, 'qua') > 0 THEN instr(text, 'qua') - 1 WHEN text LIKE '%qu' THEN length(text) - 2 WHEN text LIKE '%q' OR text LIKE '%e' THEN length(text) - 1 END AS at FROM conversations WHERE instr(text, 'e!') = 0"""
)
def pattern_match(spark, sf):
    c = table(spark, sf, "conversations").where("instr(text, 'e!') = 0")
    return c.select("conv_id", "turn", stops.partial(F.col("text"), ["qua", "e!"]).alias("m")).select("conv_id", "turn", "m.match", F.col("m.at").cast("long").alias("at"))


# ------------------------------------------------------------------ tool formats

_PLAIN = "regexp_replace(text, '[^A-Za-z .]', '', 'g')"


@query(
    f"""SELECT conv_id, turn, 'f' AS name, CASE turn % 3 WHEN 0 THEN concat('{{"a":"', {_PLAIN}, '","n":', turn, '}}') ELSE concat('{{"a": "', {_PLAIN}, '", "n": ', turn, '}}') END AS arguments, trim({_PLAIN}, ' ') AS rest FROM conversations"""
)
def tool_families(spark, sf):
    plain = F.regexp_replace("text", "[^A-Za-z .]", "")
    n = F.col("turn").cast("string")
    lit = F.lit
    body = F.concat(lit('{"a": "'), plain, lit('", "n": '), n, lit("}"))
    xml = F.concat(plain, lit("<tool_call>\n<function=f>\n<parameter=a>\n"), plain, lit("\n</parameter>\n<parameter=n>"), n, lit("</parameter>\n</function>\n</tool_call>"))
    v3 = F.concat(plain, lit("<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>function<｜tool▁sep｜>f\n```json\n"), body, lit("\n```<｜tool▁call▁end｜><｜tool▁calls▁end｜>"))
    v31 = F.concat(plain, lit("<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>f<｜tool▁sep｜>"), body, lit("<｜tool▁call▁end｜><｜tool▁calls▁end｜>"))
    kinds = {"n": "integer"}
    said = F.when(F.col("turn") % 3 == 0, tool_formats.parse(xml, "qwen3_coder", kinds)).when(F.col("turn") % 3 == 1, tool_formats.parse(v3, "deepseek_v3")).otherwise(tool_formats.parse(v31, "deepseek_v3_1"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", said.alias("t"))
    return c.select("conv_id", "turn", F.col("t.calls")[0]["name"].alias("name"), F.col("t.calls")[0]["arguments"].alias("arguments"), "t.rest")


# ------------------------------------------------------------------ draws


@query(f"WITH {_EVENTS} SELECT worker, round((10 + 2) / 2.0 - (10 - 2) / 2.0 * cos(event_id * (2 * pi() / 600)), 6) AS rate, event_id FROM ev")
def sinusoid_rate(spark, sf):
    return cache_events(spark, sf).select("worker", "event_id", F.round(sampling.sinusoid(F.col("event_id"), 2, 10, 600), 6).alias("rate"))


@query(f"WITH {_blocks_sql(50)} SELECT rid, pos, hash + 1000000 AS hash FROM blocks")
def offset_ids(spark, sf):
    return sampling.offset_ids(trace_blocks(spark, sf), 1_000_000)


# ------------------------------------------------------------------ folds and policies

_DELTAS = "d AS (SELECT conv_id % 50 AS id, turn % 2 AS choice, conv_id * 100 + turn AS seq, CASE WHEN turn < 2 THEN role END AS role, CASE WHEN turn % 3 <> 2 THEN text END AS content, CASE WHEN turn > 2 THEN concat('stop', turn) END AS finish, length(text) AS n, CASE WHEN conv_id % 50 = 7 AND turn = 1 THEN 'broken' END AS error FROM conversations)"


@query(
    f"""WITH {_DELTAS}, w AS (SELECT id, arg_min(error, seq) FILTER (error IS NOT NULL) AS error, arg_max(n, seq) AS n FROM d GROUP BY 1),
 c AS (SELECT id, choice, arg_min(role, seq) FILTER (role IS NOT NULL) AS role, coalesce(string_agg(content, '' ORDER BY seq), '') AS content, arg_max(finish, seq) FILTER (finish IS NOT NULL) AS finish FROM d GROUP BY 1, 2)
 SELECT c.id, choice, CASE WHEN error IS NULL THEN role END AS role, CASE WHEN error IS NULL THEN content END AS content, CASE WHEN error IS NULL THEN finish END AS finish, CASE WHEN error IS NULL THEN n END AS prompt_tokens, CASE WHEN error IS NULL THEN n END AS completion_tokens, error FROM c JOIN w ON c.id = w.id"""
)
def fold_chat(spark, sf):
    c, t = table(spark, sf, "conversations"), F.col("turn")
    n = F.length("text").cast("long")
    d = c.select(
        (F.col("conv_id") % 50).alias("id"), (t % 2).alias("choice"), (F.col("conv_id") * 100 + t).alias("seq"), F.when(t < 2, F.col("role")).alias("role"), F.when(t % 3 != 2, F.col("text")).alias("content"),
        F.when(t > 2, F.concat(F.lit("stop"), t.cast("string"))).alias("finish"), n.alias("prompt_tokens"), n.alias("completion_tokens"), F.when((F.col("conv_id") % 50 == 7) & (t == 1), "broken").alias("error"),
    )
    return folds.chat(d)


@query("SELECT vec_id % 100 AS id, count(*) * 64 AS n, arg_min(embedding[1], vec_id) AS first, CAST(sum(vec_id % 7) AS BIGINT) AS prompt_tokens FROM embeddings GROUP BY 1")
def fold_embeddings(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 100).alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("data"), (F.col("vec_id") % 7).alias("prompt_tokens"))
    f = folds.embeddings(e)
    return f.select("id", F.size("data").cast("long").alias("n"), F.col("data")[0].alias("first"), "prompt_tokens")


@query("SELECT o_custkey AS id, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS value, CASE WHEN count(*) <> 1 THEN concat('expected one response, got ', count(*)) END AS error FROM orders GROUP BY 1")
def fold_only_one(spark, sf):
    return folds.only_one(table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("value")))


_STOCK = f"{_EVENTS}, s AS (SELECT worker, block, min(event_id) AS inserted, max(event_id) AS touched, count(*) AS touches, block % 3 AS children FROM ev GROUP BY 1, 2)"


def _stock(spark, sf):
    g = cache_events(spark, sf).groupBy("worker", "block")
    return g.agg(F.min("event_id").alias("inserted"), F.max("event_id").alias("touched"), F.count("*").alias("touches")).withColumn("children", F.col("block") % 3)


_BY = {"fifo": "inserted, block", "lru": "touched, block", "levels": "CAST(touches >= 2 AS INTEGER) + CAST(touches >= 4 AS INTEGER) + CAST(touches >= 8 AS INTEGER), touched, block", "lineage": "touched, block"}


@query(
    f"WITH {_STOCK} "
    + " UNION ALL ".join(f"SELECT '{name}' AS policy, worker, block, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY {by}) AS k FROM s{' WHERE children = 0' if name == 'lineage' else ''}) WHERE k <= 5" for name, by in _BY.items())
)
def reuse_policies(spark, sf):
    out = [policies.reuse(_stock(spark, sf), "worker", 5, name).select(F.lit(name).alias("policy"), "worker", "block", "place") for name in _BY]
    return functools.reduce(DataFrame.unionByName, out)


@query(f"WITH {_EVENTS}, b AS (SELECT *, coalesce(sum(block) OVER (PARTITION BY worker ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ev) SELECT worker, event_id, block FROM b WHERE before < 200")
def preempted_requests(spark, sf):
    e = cache_events(spark, sf).select("worker", "event_id", "block").withColumn("need", F.lit(200))
    return policies.preempted(e, "worker", "event_id", "block", "need").select("worker", "event_id", "block")


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / 0.7, 6) AS first, len(embedding) AS n FROM embeddings")
def tempered_logits(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", policies.processed(F.col("embedding").cast("array<double>"), policies.temperature(0.7)).alias("l"))
    return e.select("vec_id", F.round(F.col("l")[0], 6).alias("first"), F.size("l").cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size <= 40 THEN p_size END AS worker, CAST(floor(p_retailprice / power(2.0, p_size % 5)) AS BIGINT) AS halved, greatest(0, p_size - 30) AS less FROM part")
def direct_and_decay(spark, sf):
    p = table(spark, sf, "part")
    workers = p.where("p_size <= 40").select(F.col("p_size").alias("worker"))
    d = policies.direct(p, workers, "p_size")
    return d.select("p_partkey", "worker", policies.decayed(F.col("p_retailprice"), F.col("p_size") % 5).alias("halved"), policies.decayed(F.col("p_size"), F.lit(30), "less").alias("less"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey BETWEEN 16 AND 65536 AND (l_partkey & (l_partkey - 1)) = 0")
def emitted_events(spark, sf):
    return policies.emitted(table(spark, sf, "lineitem"), "l_partkey", "powers").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT DISTINCT p_brand, replace(replace(lower(p_brand), '#', '_'), ' ', '_') AS slug FROM part")
def model_slugs(spark, sf):
    return table(spark, sf, "part").select("p_brand", text.slug(F.col("p_brand")).alias("slug")).distinct()


@query("SELECT p_partkey, p_size AS gen, p_partkey AS batch FROM part WHERE p_size % 2 = 0")
def folder_configs(spark, sf):
    path = F.concat(F.lit("runs/"), F.when(F.col("p_size") % 2 == 0, "ctx1_gen").otherwise("gen"), F.col("p_size").cast("string"), F.lit("_batch"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.folder_config(path).alias("c")).where("c is not null").select("p_partkey", F.col("c")["gen"].alias("gen"), F.col("c")["batch"].alias("batch"))
