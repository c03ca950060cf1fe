"""Readers of trace, telemetry, load-test and metric files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

TRACE = "timestamp LONG, input_length LONG, output_length LONG, hash_ids ARRAY<LONG>, session_id STRING, delay LONG, agent_type STRING, priority LONG"
TELEMETRY = (
    "event_type STRING, session_id STRING, timestamp DOUBLE, latency_priority LONG, "
    "request_payload STRUCT<messages: ARRAY<STRUCT<role: STRING, content: STRING>>>, response_payload STRUCT<usage: STRUCT<completion_tokens: LONG>>"
)
CALLS = "request_number LONG, intermediate_steps ARRAY<STRUCT<payload: STRUCT<event_type: STRING, UUID: STRING, name: STRING, event_timestamp: DOUBLE>>>"
LOAD = "`Timestamp` DOUBLE, `Model` STRING, `Request tokens` INT, `Response tokens` INT, `Log Type` STRING"


def trace(spark: SparkSession, path: str) -> DataFrame:
    """Request traces, JSON lines (S1-S3).  A file's order isn't kept by Spark; request_id hashes the whole row."""
    rows = spark.read.schema(TRACE).json(path)
    return rows.withColumn("request_id", F.sha2(F.to_json(F.struct(*rows.columns)), 256))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Load logs with a header (S4), lengths and milliseconds truncated (trap 18)."""
    rows = spark.read.option("header", True).schema(LOAD).csv(path)
    return rows.select((F.col("Timestamp") * 1000).cast("long").alias("timestamp"), F.col("Model").alias("model"), F.col("Request tokens").alias("input_length"), F.col("Response tokens").alias("output_length"), F.col("Log Type").alias("log_type"))


def robust_json(spark: SparkSession, path: str, schema: str = CALLS) -> DataFrame:
    """Whole documents, or the complete objects of a cut-off one (S5): objects are parted at "request_number"."""
    raw = spark.read.text(path, wholetext=True)
    parts = raw.select(F.explode(F.split("value", r'(?=\{\s*"request_number")')).alias("p")).where(F.col("p").contains("request_number"))
    body = F.regexp_replace(F.trim("p"), r"[,\]\s]+$", "")
    return parts.select(F.from_json(body, schema, {"mode": "PERMISSIVE"}).alias("x")).where("x.request_number is not null").select("x.*")


def calls(requests: DataFrame) -> DataFrame:
    """Start and end events of each call paired by UUID."""
    each = requests.select("request_number", F.explode("intermediate_steps").alias("s")).select("request_number", "s.payload.*")
    begin = each.where("event_type = 'LLM_START'").select("UUID", "request_number", "name", F.col("event_timestamp").alias("started"))
    end = each.where("event_type = 'LLM_END'").select("UUID", F.col("event_timestamp").alias("ended"))
    return begin.join(end, "UUID").withColumn("seconds", F.col("ended") - F.col("started"))


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Model calls of a telemetry log, with their place in the session."""
    rows = spark.read.schema(TELEMETRY).json(path).where("event_type = 'llm_call'")
    place = F.expr("row_number() over (partition by session_id order by timestamp)")
    return rows.withColumn("turn", place).withColumn("output_length", F.coalesce(F.col("response_payload.usage.completion_tokens"), F.lit(0)))


def load_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Result files of c<N> folders with N."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "profile_export*.json").json(folder)
    return rows.withColumn("concurrency", F.regexp_extract(F.col("_metadata.file_path"), r"/c(\d+)/", 1).try_cast("int")).where("concurrency is not null")


def recorded(spark: SparkSession, path: str, event: str) -> DataFrame:
    """Recorded {timestamp, event} lines; blank and bad ones are left out."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(F.from_json("value", f"timestamp LONG, event {event}").alias("x")).where("x.timestamp is not null and x.event is not null").select("x.*")


def exposition(spark: SparkSession, path: str) -> DataFrame:
    """Samples of Prometheus text files: name, labels, value."""
    raw = spark.read.text(path).where(~F.col("value").startswith("#"))
    return raw.select(text.sample_line(F.col("value")).alias("s")).where("s is not null").select("s.*")


def sse_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of recorded event streams, a file each."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", F.posexplode(text.sse(F.col("value"))).alias("place", "m")).select("file", "place", "m.*")


def timestamp(value: Column, *formats: str) -> Column:
    """The first of several formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])


def registry_state(changes: DataFrame, prefix: str) -> DataFrame:
    """Latest value of each key below a prefix, deletions left out (S25-S28).  changes: key, revision, value (null: deleted)."""
    last = changes.where(F.col("key").startswith(prefix)).groupBy("key").agg(F.max_by(F.struct("value"), "revision").alias("x"), F.max("revision").alias("revision"))
    return last.select("key", "revision", "x.value").where("value is not null")




def arrays(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """NPZ files: a row for each place of their equally long one-dimensional arrays, file, place and a double for each name.

    Files are read where they lie, a task each; one that lacks an array, or whose arrays differ in length, stops the job.
    """
    import pyarrow as pa

    def step(batches):
        import io

        import numpy as np

        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    columns = [np.asarray(z[n], float).ravel() for n in names]
                if len({len(c) for c in columns}) > 1:
                    raise ValueError(f"{file}: arrays of different lengths")
                n = len(columns[0]) if columns else 0
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(range(n), pa.int32()), *[pa.array(c, pa.float64()) for c in columns]], ["file", "place", *names])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return raw.mapInArrow(step, "file string, place int, " + ", ".join(f"`{n}` double" for n in names))


def result_pairs(spark: SparkSession, folder: str, results: str, deployment: str) -> DataFrame:
    """Result documents with the deployment document of their folder: folder, json, deployment."""
    read = lambda glob: spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("folder"), "value")
    return read(results).withColumnRenamed("value", "json").join(read(deployment).withColumnRenamed("value", "deployment"), "folder")


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON list, a row for each item."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def throughput_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Result rows of CSV files with a header."""
    return spark.read.option("header", True).schema(columns).csv(path)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """A batch of prompts, JSON lines: text and its place by file and offset; lines without text are left out."""
    rows = spark.read.schema("text STRING").json(path).where("text is not null")
    return rows.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"), "text")


CLIENT = "time TIMESTAMP, results ARRAY<STRUCT<status: INT, request_elapsed_time: DOUBLE, result: STRUCT<choices: ARRAY<STRUCT<message: STRUCT<content: STRING>>>>>>"


def client_logs(spark: SparkSession, folder: str, expected: int = 100) -> DataFrame:
    """Results of fault-test clients (files client_<n>.log.txt, JSON lines): client, time, status, seconds, ok.

    A result is good if it has content of at least the expected length (S29); lines that aren't JSON are left out.
    """
    rows = spark.read.schema(CLIENT).option("pathGlobFilter", "client_*.log.txt").option("recursiveFileLookup", True).json(folder)
    rows = rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"client_([^_.]+)", 1).alias("client"), "time", F.explode("results").alias("r"))
    content = F.get(F.col("r.result.choices"), F.lit(0))["message"]["content"]
    return rows.select("client", "time", F.col("r.status").alias("status"), F.col("r.request_elapsed_time").alias("seconds"), F.coalesce(F.length(content) >= expected, F.lit(False)).alias("ok"))


def marked_lines(spark: SparkSession, folder: str, markers: dict[str, str], glob: str = "*.log*") -> DataFrame:
    """Lines of process logs that hold a marker: process (the file), time (at the line's begin, ISO), marker."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(folder).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("process"), "value")
    kind = F.lit(None).cast("string")
    for name, text_ in markers.items():
        kind = F.coalesce(kind, F.when(F.contains("value", F.lit(text_)), name))
    at = F.regexp_extract("value", r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?Z?)", 1)
    return rows.select("process", F.try_to_timestamp(F.nullif(at, F.lit(""))).alias("time"), kind.alias("marker")).where("marker is not null")


def load_totals(results: DataFrame) -> DataFrame:
    """Result files of several clients as one report: requests, errors, mean weighted by requests (S32).  results: requests, errors, mean."""
    return results.agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), (F.sum(F.col("mean") * F.col("requests")) / F.sum("requests")).alias("mean"))


def replayed(spark: SparkSession, path: str, event: str, most: int | None = None, files_at_once: int = 1) -> DataFrame:
    """A recording as a stream, file by file, up to so many events by time if asked."""
    rows = spark.readStream.schema(f"timestamp LONG, event {event}").option("maxFilesPerTrigger", files_at_once).json(path)
    return rows if most is None else rows.limit(most)
