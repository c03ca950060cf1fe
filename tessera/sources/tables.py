"""Views of the driver's tables as traces, cache events and metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_blocks(spark: SparkSession, sf_dir: str, modulus: int = 50) -> DataFrame:
    """rid, pos, hash: the block-hash sequence of each request; the request's id is also its place in the trace."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rows.select(F.col("l_orderkey").alias("rid"), (F.row_number().over(order) - 1).cast("long").alias("pos"), (F.col("l_partkey") % modulus).alias("hash"))


def trace_requests(spark: SparkSession, sf_dir: str, block: int = 512) -> DataFrame:
    """rid, ts (ms), input_length, output_length."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count("*") * block).alias("input_length"), F.sum("l_quantity").cast("long").alias("output_length"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ts"))
    return orders.join(lines, F.col("rid") == F.col("l_orderkey")).select("rid", "ts", "input_length", "output_length")


def cache_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ms, worker, kind, block, value: cache events in the order of event_id."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for x in ("click", "stored", "view", "stored", "purchase", "removed", "error", "cleared", "signup", "add")])
    return e.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("user_id") % 8).alias("worker"), "user_id", "event_type", kind[F.col("event_type")].alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("block"), "value")
