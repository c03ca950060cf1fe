import json

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.functions import text, tokens, tool_formats, validate
from tessera.operators import reports, sampling, state
from tessera.sources import readers
from tessera.streaming import state as streaming


def parsed(spark, said, family, schema=None):
    r = spark.createDataFrame([(said,)], "t string").select(tool_formats.parse(F.col("t"), family, schema).alias("p")).first().p
    return [(c.name, json.loads(c.arguments)) for c in r.calls], r.rest


def test_tool_formats(spark):
    assert parsed(spark, 'Hi <tool_call>{"name": "a", "arguments": {"x": 1}}</tool_call> <tool_call>{"name": "b", "parameters": {}}</tool_call>', "hermes") == ([("a", {"x": 1}), ("b", {})], "Hi")
    assert parsed(spark, '<TOOLCALL>[{"name": "a", "arguments": {"x": "<b>"}}]</TOOLCALL>', None) == ([("a", {"x": "<b>"})], "")
    assert parsed(spark, '[TOOL_CALLS][{"name": "a", "arguments": {}}, {"name": "c", "arguments": {"y": [1]}}]', "mistral")[0] == [("a", {}), ("c", {"y": [1]})]
    assert parsed(spark, '<|python_tag|>{"name": "a", "parameters": {"q": 2}}', "llama3_json") == ([("a", {"q": 2})], "")
    dsml = '<｜DSML｜function_calls>\n<｜DSML｜invoke name="f">\n<｜DSML｜parameter name="s" string="true">it\'s "x"</｜DSML｜parameter>\n<｜DSML｜parameter name="n" string="false">3</｜DSML｜parameter>\n</｜DSML｜invoke>\n</｜DSML｜function_calls>'
    assert parsed(spark, "ok " + dsml, "deepseek_v3_2", {"n": "integer"}) == ([("f", {"s": 'it\'s "x"', "n": 3})], "ok")
    glm = "<tool_call>go\n<arg_key>to</arg_key>\n<arg_value>Rome</arg_value>\n<arg_key>now</arg_key>\n<arg_value>True</arg_value>\n</tool_call>"
    assert parsed(spark, glm + " done", "glm47", {"now": "boolean"}) == ([("go", {"to": "Rome", "now": True})], "done")
    mini = '<minimax:tool_call><invoke name="f"><parameter name="l">[1, 2]</parameter><parameter name="bad">x1</parameter></invoke></minimax:tool_call>'
    assert parsed(spark, mini, "minimax_m2", {"l": "array", "bad": "integer"}) == ([("f", {"l": [1, 2], "bad": "x1"})], "")
    harmony = '<|channel|>analysis<|message|>thinking<|end|><|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{"x": 1}<|call|>'
    assert parsed(spark, harmony, "harmony")[0] == [("f", {"x": 1})]
    assert parsed(spark, "<tool_call>no call</tool_call> text", "hermes") == ([], "<tool_call>no call</tool_call> text")
    rows = tool_formats.pythonic(spark.createDataFrame([(1, 'So [f(a=1, b="x"), g.h(c=[1, {"d": None}])]'), (2, "[1, 2]"), (3, None), (4, "[f(x)]")], "i int, t string"), "t").orderBy("i").collect()
    assert [(c.name, json.loads(c.arguments)) for c in rows[0].calls] == [("f", {"a": 1, "b": "x"}), ("g.h", {"c": [1, {"d": None}]})] and rows[0].rest == "So"
    assert [r.calls for r in rows[1:]] == [[], [], []] and [r.rest for r in rows[1:]] == ["[1, 2]", None, "[f(x)]"]


def test_reasoning_markers(spark):
    cases = [("abc</think>def<think>x", "abc</think>def", "x"), ("a<think>b<think>c</think>d", "ad", "b<think>c"), (" plain ", " plain ", ""), ("<think>a</think> b <think>c</think>", "b", "ac")]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    normal, inner = text.reasoning(F.col("t"))
    assert [(r.n, r.r) for r in df.select(normal.alias("n"), inner.alias("r")).collect()] == [c[1:] for c in cases]
    normal, inner = text.reasoning_by("deepseek_r1", F.col("t"))
    assert [(r.n, r.r) for r in spark.createDataFrame([("think</think>say",), ("only thought",)], "t string").select(normal.alias("n"), inner.alias("r")).collect()] == [("say", "think"), ("", "only thought")]


def test_block_hashes(spark):
    ids = list(range(10))
    r = tokens.hashed(spark.createDataFrame([(1, ids, [[5, -1], []]), (2, None, None), (3, [1], None)], "i int, t array<long>, e array<array<long>>"), "t", 4).orderBy("i").collect()
    first, second = (xxhash.xxh3_64_intdigest(np.array(ids[a : a + 4], "<u4").tobytes(), 1337) for a in (0, 4))
    chained = xxhash.xxh3_64_intdigest(first.to_bytes(8, "little") + second.to_bytes(8, "little"), 1337)
    assert [x % (1 << 64) for x in r[0].blocks] == [first, second] and [x % (1 << 64) for x in r[0].sequence] == [first, chained]
    assert r[1].blocks == r[2].blocks == []
    more = tokens.hashed(spark.createDataFrame([(ids, [[5, -1], []])], "t array<long>, e array<array<long>>"), "t", 4, extra="e").first()
    assert more.blocks[0] % (1 << 64) == xxhash.xxh3_64_intdigest(np.array(ids[:4], "<u4").tobytes() + (5).to_bytes(8, "little") + b"\xff" * 8, 1337) and more.blocks[1] == r[0].blocks[1]


def test_positional_hashes(spark):
    """Modes by the bits of the position, the layout of the reference, the fourth mode too (which the query's SQL lacks)."""
    block = 0xFEDCBA9876543210 - (1 << 64)
    at = [0, 100, 255, 256, 1000, 65535, 65536, 100_000, (1 << 24) - 1, 1 << 24, 20_000_000, (1 << 25) + 3, 360_000_000, (1 << 31) - 1]
    df = spark.createDataFrame([(p, block) for p in at], "p long, b long")
    h = tokens.positional(F.lit(7), F.col("p"), F.col("b"))
    got = {r.p: r for r in df.select("p", tokens.mode(F.col("p")).alias("m"), h.alias("h"), tokens.position_of(h).alias("back")).collect()}
    for p in at:
        m, low = next((m, low) for m, bits, low in [(0, 8, 54), (1, 16, 46), (2, 24, 38), (3, 31, 31)] if p < 1 << bits)
        assert (got[p].m, got[p].h.upper % (1 << 64), got[p].h.lower, got[p].back) == (m, m << 62 | p << low | block % (1 << low), 7, p)


def test_checks(spark):
    df = spark.createDataFrame([("a", "QUJD" * 50, None), ("", "QUJD" * 50, "x"), (None, "QUJD", "x"), (None, None, None), ("", None, "x"), (None, "?" * 200, None)], "p string, e string, u string")
    texts = F.when(F.col("p").isNotNull(), F.array("p"))
    assert [r[0] for r in df.select(validate.prompt_or_embeddings(texts, F.col("e"))).collect()] == [True, True, False, False, False, False]


def test_draws(spark):
    rows = spark.range(20_000)
    parts = sampling.partition(rows, "id", 4, 1).groupBy("part").count().collect()
    assert len(parts) == 4 and all(4700 < r["count"] < 5300 for r in parts)
    tiers = {r.tier: r["count"] for r in sampling.tiers(rows, "id", [0.5, 0.3, 0.2], 2).groupBy("tier").count().collect()}
    assert abs(tiers[0] - 10_000) < 400 and abs(tiers[2] - 4000) < 300
    values = {r.value: r["count"] for r in sampling.from_cdf(rows, "id", ["a", "b", "c"], [0.1, 0.1, 1.0], 3).groupBy("value").count().collect()}
    assert set(values) == {"a", "c"} and abs(values["a"] - 2000) < 250
    d = sampling.delays(rows, "id", 50.0, 4).agg(F.avg("delay"), F.min("delay")).first()
    assert abs(d[0] - 50) < 2 and d[1] >= 0
    p = rows.select(sampling.poisson(F.lit(7.0), 5, F.col("id")).alias("k"), sampling.poisson(F.lit(400.0), 6, F.col("id")).alias("l")).agg(F.avg("k"), F.var_samp("k"), F.avg("l"), F.var_samp("l")).first()
    assert abs(p[0] - 7) < 0.15 and abs(p[1] - 7) < 0.5 and abs(p[2] - 400) < 2 and abs(p[3] - 400) < 30
    r = sampling.replicas(spark.range(100), "id", [1, 2, 3], 2, 7).groupBy("id").agg(F.countDistinct("worker").alias("n")).collect()
    assert len(r) == 100 and all(x.n == 2 for x in r)
    s = sampling.sequences(spark, 50, 10, 3, 0.4, 8)
    assert s.where("pos = 0").select("hash").distinct().count() <= 3 and s.where("pos = 9").select("hash").distinct().count() == 50


def run(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_events_build_the_index(spark, tmp_path):
    log = [(1, 1, "stored", 10, None), (1, 2, "stored", 11, 10), (1, 3, "stored", 99, 50), (1, 4, "removed", 77, None), (2, 5, "stored", 10, None), (1, 6, "removed", 11, None), (1, 7, "stored", 11, 10), (2, 8, "cleared", None, None), (2, 9, "stored", 12, None), (1, 10, "stored", 13, 13)]
    df = spark.createDataFrame(log, "worker long, at long, kind string, block long, parent long")
    for i, cut in enumerate(((0, 4), (4, 7), (7, 10))):
        df.where(f"at > {cut[0]} and at <= {cut[1]}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    changes = run(streaming.apply_events(stream), tmp_path, "index_changes")
    held = {}
    for r in sorted(changes, key=lambda r: r["at"]):
        if r.held is not None:
            held[r.worker, r.block] = r.held
    assert {k for k, v in held.items() if v} == {(1, 10), (1, 11), (2, 12)}
    assert sorted((r["at"], r.block) for r in changes if r.held is None) == [(3, 99), (4, 77), (10, 13)]
    # the batch form agrees where no event is refused
    good = df.where("at not in (3, 4, 10)")
    assert {tuple(r) for r in state.index(good).collect()} == {(1, 10), (1, 11), (2, 12)}


def test_active_requests(spark, tmp_path):
    log = [(1, 1, "add", 100, 0), (1, 2, "add", 50, 1), (1, 1, "prefilled", 0, 2), (1, 1, "add", 7, 3), (1, 2, "free", 0, 4), (1, 3, "add", 9, 5)]
    df = spark.createDataFrame(log, "worker long, rid long, kind string, tokens long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = run(streaming.active_requests(stream, "ts", "1 second", 3_600_000), tmp_path, "active")
    assert [(r.worker, r.requests, r.tokens) for r in got][:1] == [(1, 2, 9)]


def test_files(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=[1.0, 2.0], y=[3, 4])
    assert sorted((r.place, r.x, r.y) for r in readers.arrays(spark, str(tmp_path), ["x", "y"]).collect()) == [(0, 1.0, 3.0), (1, 2.0, 4.0)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "client_0.log.txt").write_text('{"time": "2024-01-01T00:00:01", "results": [{"status": 200, "request_elapsed_time": 0.5, "result": {"choices": [{"message": {"content": "abcdef"}}]}}, {"status": 500, "request_elapsed_time": 1.0}]}\nnot json\n')
    rows = readers.client_logs(spark, str(tmp_path / "c"), 5).collect()
    assert sorted((r.client, r.status, r.seconds, r.ok) for r in rows) == [("0", 200, 0.5, True), ("0", 500, 1.0, False)]
    (tmp_path / "c" / "w.log").write_text("2024-01-01T00:00:05 worker is ready\nother\n2024-01-01T00:00:09Z worker is ready again\n")
    marks = readers.marked_lines(spark, str(tmp_path / "c"), {"ready": "is ready"}, "*.log").collect()
    assert sorted((r.process, r.time.second, r.marker) for r in marks) == [("w.log", 5, "ready"), ("w.log", 9, "ready")]
    fault = F.lit("2024-01-01 00:00:02").cast("timestamp").cast("long")
    starts = spark.createDataFrame([("a", 5), ("a", 9)], "g string, at long")
    assert reports.recovery(starts, "g", "at", F.lit(4)).first().recovery == 5 and fault is not None
    (tmp_path / "p.jsonl").write_text('{"text": "one"}\n{"other": 1}\n{"text": "two"}\n')
    assert sorted(r.text for r in readers.prompts(spark, str(tmp_path / "p.jsonl")).collect()) == ["one", "two"]
    d = tmp_path / "pair" / "r1"
    d.mkdir(parents=True)
    (d / "result.json").write_text('{"v": 1}')
    (d / "deploy.yaml").write_text("gpus: 2")
    pair = readers.result_pairs(spark, str(tmp_path / "pair"), "result.json", "deploy.yaml").first()
    assert pair.json == '{"v": 1}' and pair.deployment == "gpus: 2"
