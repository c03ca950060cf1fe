"""Chunks of a streamed response folded into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(order: str, value: Column) -> Column:
    """Non-null values in order as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v"))))), lambda x: x["v"]), "")


def _last(order: str, value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def chat(deltas: DataFrame, key: str = "id") -> DataFrame:
    """deltas: key, choice, seq, role, content, finish, prompt_tokens, completion_tokens, error.  A row for each choice: role (the first),
    content, finish (the last), and the response's usage (its last); a response with an error has it alone (A38, A39)."""
    each = deltas.groupBy(key, "choice").agg(
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        _joined("seq", F.col("content")).alias("content"),
        _last("seq", F.col("finish")).alias("finish"),
    )
    whole = deltas.groupBy(key).agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"),
        _last("seq", F.col("prompt_tokens")).alias("prompt_tokens"),
        _last("seq", F.col("completion_tokens")).alias("completion_tokens"),
    )
    kept = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return each.join(whole, key).select(key, "choice", *map(kept, ("role", "content", "finish", "prompt_tokens", "completion_tokens")), "error")


def embeddings(parts: DataFrame, key: str = "id") -> DataFrame:
    """parts: key, seq, data (array), prompt_tokens.  Data one after another, tokens summed."""
    data = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]))
    return parts.groupBy(key).agg(data.alias("data"), F.sum("prompt_tokens").alias("prompt_tokens"))


def only_one(parts: DataFrame, key: str = "id") -> DataFrame:
    """Responses of exactly one part; others have an error in its place."""
    n = F.count("*")
    each = parts.groupBy(key).agg(n.alias("parts"), F.first("value").alias("value"))
    return each.select(key, F.when(F.col("parts") == 1, F.col("value")).alias("value"), F.when(F.col("parts") != 1, F.concat(F.lit("expected one response, got "), F.col("parts"))).alias("error"))
