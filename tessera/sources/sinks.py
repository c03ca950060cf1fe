"""Writers of traces, metrics, profiles and index snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_trace(rows: DataFrame, path: str, rows_a_file: int = 0) -> None:
    """JSON lines, rotated after rows_a_file lines (K1-K4)."""
    rows.write.option("maxRecordsPerFile", rows_a_file).mode("overwrite").json(path)


def exposition_line(name: str, labels: str, value: str) -> Column:
    """A sample as a line of the Prometheus text format, labels by name, their values escaped (K7)."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    return F.concat(F.col(name), F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit("")), F.lit(" "), F.col(value).cast("string"))


def write_exposition(samples: DataFrame, path: str) -> None:
    samples.select(exposition_line("name", "labels", "value").alias("value")).write.mode("overwrite").text(path)


def inject(labels: str, **constant: str) -> Column:
    """Constant labels on every sample; the sample's own stay (K9)."""
    return F.map_filter(F.map_concat(F.map_filter(F.create_map(*[x for k, v in constant.items() for x in (F.lit(k), F.lit(v))]), lambda k, _: ~F.map_contains_key(labels, k)), labels), lambda _, v: v.isNotNull())


def only(lines: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Lines of a text exposition by metric prefix, blank ones dropped (K8)."""
    name = F.regexp_extract("value", r"^(?:# (?:HELP|TYPE) )?([a-zA-Z_:][a-zA-Z0-9_:]*)", 1)
    rows = lines.where(F.trim("value") != "")
    if include:
        rows = rows.where(F.greatest(F.lit(False), F.lit(False), *[name.startswith(p) for p in include]))
    for p in exclude:
        rows = rows.where(~name.startswith(p))
    return rows


def merge_profiles(*sweeps: DataFrame) -> DataFrame:
    """Profiling results of several sweeps, columns that some lack are null."""
    out = sweeps[0]
    for s in sweeps[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def snapshot(state: DataFrame, path: str) -> None:
    """An index state as store events that can be replayed."""
    events = state.select("worker", F.lit("stored").alias("kind"), "parent", "block", "pos")
    # a large worker is several tasks: parents stand before their children in the order of place, file by file
    events.repartitionByRange("worker", "pos").sortWithinPartitions("worker", "pos").write.mode("overwrite").parquet(path)
