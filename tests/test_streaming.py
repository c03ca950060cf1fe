import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import events as batch
from tessera.sources.tables import cache_events
from tessera.streaming import folds

SF = "/root/testdata/sf0.001"


@pytest.fixture
def source(spark, tmp_path):
    """Cache events as a stream of files in order of event_id."""
    rows = cache_events(spark, SF).withColumn("ts", F.timestamp_millis("ms"))
    path = f"{tmp_path}/in"
    for i in range(4):
        rows.where(f"event_id div 250 = {i}").coalesce(1).write.mode("append").parquet(path)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), tmp_path


def run(stream, tmp_path, mode="append"):
    name = f"out_{abs(hash(str(tmp_path))) % 10**9}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_interval_load(source):
    rows, stream, tmp = source
    got = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in run(folds.interval_load(stream, "ts", ["event_type"], "value", "1 day", "1 hour"), tmp, "append")}
    want = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in rows.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 10


def test_batches(source):
    rows, stream, tmp = source
    got = sorted((r.worker, r.first_event, r.kind, r.events) for r in run(folds.batches(stream, "worker", "event_id", 2), tmp))
    want = sorted((r.worker, r.first_event, r.kind, r.events) for r in batch.batches(rows, "worker", "event_id", 2).collect())
    assert set(got) <= set(want) and len(want) - len(got) <= 8  # the last of each worker is still open


def test_a_quiet_batch_is_given_out(spark, tmp_path):
    rows = cache_events(spark, SF)
    rows.where("event_id < 100").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = folds.batches(stream, "worker", "event_id", 2, 200).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="300 milliseconds").start()
    want = sorted((r.worker, r.first_event, r.events) for r in batch.batches(rows.where("event_id < 100"), "worker", "event_id", 2).collect())
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("quiet").count() < len(want):
            time.sleep(0.5)
        assert sorted((r.worker, r.first_event, r.events) for r in spark.table("quiet").collect()) == want
    finally:
        q.stop()


def test_first_sources(source):
    rows, stream, tmp = source
    got = run(folds.first_sources(stream, "ts", ["block"], "60 days"), tmp)
    assert {(r.block, r.event_id) for r in got} == {(r.block, r.event_id) for r in batch.first_sources(rows, "block", "event_id").collect()}


def test_expiring(source):
    rows, stream, tmp = source
    got = run(folds.expiring(stream, "user_id", "ts", 3_600_000, "1 minute"), tmp)
    last = {r.user_id: r.ts for r in rows.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    assert got and all(r.last <= last[r.user_id] and r.touches >= 1 for r in got)
