import json

from pyspark.sql import functions as F

from tessera.sources import readers, sinks


def test_trace_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 100, 5, [1, 2]), (7, 200, 6, [1, 3])], "timestamp long, input_length long, output_length long, hash_ids array<long>")
    sinks.write_trace(rows, f"{tmp_path}/t", 1)
    got = readers.trace(spark, f"{tmp_path}/t")
    assert sorted((r.timestamp, r.hash_ids) for r in got.collect()) == [(0, [1, 2]), (7, [1, 3])]
    assert got.select("request_id").distinct().count() == 2


def test_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Timestamp,Model,Request tokens,Response tokens,Log Type\n1.2345,a,10,20,x\n")
    assert tuple(readers.load_csv(spark, f"{tmp_path}/l.csv").first()) == (1234, "a", 10, 20, "x")


def test_robust_json_and_calls(spark, tmp_path):
    step = lambda k, u, t: {"payload": {"event_type": k, "UUID": u, "name": "m", "event_timestamp": t}}
    good = [{"request_number": i, "intermediate_steps": [step("LLM_START", f"u{i}", 1.0), step("LLM_END", f"u{i}", 1.5 + i)]} for i in range(3)]
    (tmp_path / "r.json").write_text(json.dumps(good)[:-60])  # the last object is cut off
    got = readers.calls(readers.robust_json(spark, f"{tmp_path}/r.json")).collect()
    assert sorted((r.request_number, r.seconds) for r in got) == [(0, 0.5), (1, 1.5)]


def test_telemetry_results_and_recordings(spark, tmp_path):
    call = lambda s, t, n: json.dumps({"event_type": "llm_call", "session_id": s, "timestamp": t, "response_payload": {"usage": {"completion_tokens": n}}})
    (tmp_path / "t.jsonl").write_text("\n".join([call("a", 2.0, 5), call("a", 1.0, None), '{"event_type": "other"}']))
    assert sorted((r.turn, r.output_length) for r in readers.telemetry(spark, f"{tmp_path}/t.jsonl").collect()) == [(1, 0), (2, 5)]
    for n in (1, 8):
        (tmp_path / f"runs/c{n}/x").mkdir(parents=True)
        (tmp_path / f"runs/c{n}/x/profile_export_a.json").write_text(json.dumps({"time_to_first_token": {"avg": n * 2.0}}))
    got = readers.load_results(spark, f"{tmp_path}/runs", "time_to_first_token STRUCT<avg: DOUBLE>").select("concurrency", "time_to_first_token.avg").collect()
    assert sorted(map(tuple, got)) == [(1, 2.0), (8, 16.0)]
    (tmp_path / "rec").write_text('{"timestamp": 1, "event": {"a": 2}}\n\nnot json\n{"timestamp": 3}\n')
    assert [tuple(r) for r in readers.recorded(spark, f"{tmp_path}/rec", "STRUCT<a: INT>").select("timestamp", "event.a").collect()] == [(1, 2)]


def test_exposition(spark, tmp_path):
    rows = spark.createDataFrame([("up", {}, 1.0), ("req_total", {"b": "2", "a": "x"}, 3.5)], "name string, labels map<string,string>, value double")
    sinks.write_exposition(rows.withColumn("labels", sinks.inject("labels", job="j", a="no")), f"{tmp_path}/m")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/m").collect())
    assert lines == ['req_total{a="x",b="2",job="j"} 3.5', 'up{a="no",job="j"} 1.0']
    got = {r.name: (r.labels, r.value) for r in readers.exposition(spark, f"{tmp_path}/m").collect()}
    assert got["req_total"] == ({"a": "x", "b": "2", "job": "j"}, 3.5)
    kept = sinks.only(spark.createDataFrame([("# HELP up x",), ("up 1",), ("",), ("go_x 1",), ("req 1",)], "value string"), ["up", "go"], ["go"])
    assert sorted(r.value for r in kept.collect()) == ["# HELP up x", "up 1"]


def test_sse_timestamps_registry_and_snapshots(spark, tmp_path):
    (tmp_path / "s.txt").write_text('event: delta\ndata: {"a":1}\n\ndata: x\ndata: y\n\n')
    assert [(r.place, r.event, r.data) for r in readers.sse_messages(spark, f"{tmp_path}/s.txt").orderBy("place").collect()] == [(0, "delta", '{"a":1}'), (1, None, "x\ny")]
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("02/01/2024",), ("never",)], "s string")
    assert [str(r[0]) for r in df.select(readers.timestamp(F.col("s"), "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy")).collect()] == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", "None"]
    changes = spark.createDataFrame([("v1/a", 1, "x"), ("v1/a", 2, "y"), ("v1/b", 1, "z"), ("v1/b", 3, None), ("v2/c", 1, "w")], "key string, revision long, value string")
    assert [tuple(r) for r in readers.registry_state(changes, "v1/").collect()] == [("v1/a", 2, "y")]
    state = spark.createDataFrame([(1, None, 5, 0), (1, 5, 6, 1)], "worker long, parent long, block long, pos int")
    sinks.snapshot(state, f"{tmp_path}/snap")
    assert spark.read.parquet(f"{tmp_path}/snap").where("kind = 'stored'").count() == 2
    assert sinks.merge_profiles(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "a int, b int")).columns == ["a", "b"]
