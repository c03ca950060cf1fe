"""Tool calls and nested JSON in model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tool_calls(text: Column, begin: str = "<tool_call>", end: str = "</tool_call>") -> Column:
    """All JSON calls between markers, in order, as (name, arguments as JSON), and the text without them.

    A body may be one call or a list of them; one that is no JSON, or has no name, is no call and stays in the text.
    """
    bodies = F.regexp_extract_all(text, F.lit(f"(?s){begin}\\s*(.*?)\\s*(?:{end}|\\z)"), 1)
    shape = "array<struct<name string, arguments string, parameters string>>"
    listed = lambda body: F.from_json(F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]"))), shape)
    parsed = F.flatten(F.transform(bodies, lambda body: F.coalesce(listed(body), F.array().cast(shape))))
    calls = F.transform(F.filter(parsed, lambda c: c["name"].isNotNull()), lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["arguments"], c["parameters"], F.lit("{}")).alias("arguments")))
    rest = F.btrim(F.regexp_replace(text, f"(?s){begin}.*?(?:{end}|\\z)", ""), F.lit(" \t\r\n"))
    return F.when(F.size(calls) > 0, F.struct(calls.alias("calls"), rest.alias("rest"))).otherwise(F.struct(calls.alias("calls"), text.alias("rest")))


def call_begins(text: Column, markers: list[str]) -> Column:
    """Whether a call begins in the text, or may begin at its end with part of a marker."""
    whole = F.lit(False)
    for m in markers:
        whole |= F.contains(text, F.lit(m))
        for i in range(1, len(m)):
            whole |= F.endswith(text, F.lit(m[:i]))
    return whole


def call_end(text: Column, end: str) -> Column:
    """The place after the first end marker, the text's length if there is none."""
    at = F.instr(text, end)
    return F.when(at > 0, at - 1 + len(end)).otherwise(F.length(text))


def output_tokens(payload: Column) -> Column:
    """Completion tokens of a nested response, 0 if there are none."""
    return F.coalesce(F.get_json_object(payload, "$.usage.completion_tokens").try_cast("long"), F.lit(0))


def concurrency(path: Column) -> Column:
    """N of a folder named cN."""
    return F.regexp_extract(path, r"(?:^|/)c(\d+)(?:/|$)", 1).try_cast("int")


def blocks(tokens: Column, size: int) -> Column:
    """Complete blocks of a token sequence (H1, H14); the rest is left out, a short sequence has none."""
    n = F.floor(F.size(tokens) / size).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(tokens, (i - 1) * size + 1, size))
    return F.when(n > 0, each).otherwise(F.slice(each, 1, 0))


def remainder(tokens: Column, size: int) -> Column:
    """What is left after the complete blocks."""
    whole = (F.floor(F.size(tokens) / size) * size).cast("int")
    return F.slice(tokens, whole + 1, size)
