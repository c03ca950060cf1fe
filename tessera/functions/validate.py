"""Checks of request parameters; each is true if the parameter passes.  A null parameter is not given and passes."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges and limits of the request format.
RANGES = {"temperature": (0.0, 2.0), "top_p": (0.0, 1.0), "min_p": (0.0, 1.0), "frequency_penalty": (-2.0, 2.0), "presence_penalty": (-2.0, 2.0), "n": (1, 128), "top_logprobs": (0, 20), "logprobs": (0, 5), "best_of": (0, 20)}
MOST_CHOICES, MOST_STOPS, MOST_TOOLS, LONGEST_NAME, LEAST_EMBEDDING, MOST_EMBEDDING = 128, 32, 1536, 96, 100, 10 * 1024 * 1024
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh")
TIERS = ("auto", "default", "flex", "scale", "priority")


def _given(x: Column, ok: Column) -> Column:
    return x.isNull() | F.coalesce(ok, F.lit(False))


def in_range(name: str, x: Column) -> Column:
    """temperature, top_p, min_p, penalties, n, top_logprobs, logprobs, best_of."""
    return _given(x, ~F.isnan(x.cast("double")) & x.between(*RANGES[name]))


def top_k(x: Column) -> Column:
    """-1 for all, or one at least."""
    return _given(x, (x == -1) | (x >= 1))


def repetition_penalty(x: Column) -> Column:
    """Over 0, up to 2."""
    return _given(x, (x > 0) & (x <= 2))


def logit_bias(x: Column) -> Column:
    """A map of strings: every value is a number from -100 to 100."""
    return _given(x, F.forall(F.map_values(x), lambda v: F.coalesce(v.try_cast("double").between(-100, 100), F.lit(False))))


def choices_vary(n: Column, temperature: Column) -> Column:
    """Several choices need a temperature that isn't 0; not given it is 1."""
    return ~(F.coalesce(n, F.lit(1)) > 1) | (F.coalesce(temperature, F.lit(1.0)) != 0)


def one_sampler(temperature: Column, top_p: Column) -> Column:
    """Not both set to other than 1."""
    return ~(F.coalesce(temperature, F.lit(1.0)) != 1) | ~(F.coalesce(top_p, F.lit(1.0)) != 1)


def no_unsupported(fields: Column) -> Column:
    """fields: a map or array of what the format doesn't know."""
    return fields.isNull() | (F.size(fields) == 0)


def response_format(x: Column) -> Column:
    """A struct of type, name, schema: a JSON schema has both of the others."""
    schema = (F.coalesce(x["name"], F.lit("")) != "") & x["schema"].isNotNull()
    return _given(x, x["type"].isin("text", "json_object") | ((x["type"] == "json_schema") & schema))


def not_blank(x: Column) -> Column:
    """A model must be given."""
    return F.coalesce(F.btrim(x, F.lit(" \t\r\n")) != "", F.lit(False))


def user(x: Column) -> Column:
    """(F31)"""
    return x.isNull() | not_blank(x)


def one_of(x: Column, values: tuple[str, ...]) -> Column:
    """Reasoning effort, service tier."""
    return _given(x, x.isin(*values))


def prompt(x: Column) -> Column:
    """Texts or token lists as an array: none, and none of them, is empty."""
    return (F.size(x) > 0) & F.forall(x, lambda p: F.length(p) > 0)


def prompt_or_embeddings(texts: Column, embeddings: Column) -> Column:
    """One of them at least; embeddings are base64 of a size, and with them the prompt may be empty."""
    size = F.length(F.try_to_binary(embeddings, F.lit("base64")))
    return F.when(embeddings.isNotNull(), F.coalesce(size.between(LEAST_EMBEDDING, MOST_EMBEDDING), F.lit(False))).otherwise(F.coalesce(prompt(texts), F.lit(False)))


def suffix(x: Column, most: int = 10_000) -> Column:
    """(F36)"""
    return _given(x, F.length(x) <= most)


def at_least_one(x: Column) -> Column:
    """max_tokens, max_completion_tokens."""
    return _given(x, x >= 1)


def total_choices(batch: Column, n: Column) -> Column:
    """(F38)"""
    return batch * F.coalesce(n, F.lit(1)) <= MOST_CHOICES


def stops(x: Column) -> Column:
    """An array that is not empty, not over 32, with none empty in it."""
    return _given(x, F.size(x).between(1, MOST_STOPS) & F.forall(x, lambda s: s != ""))


def tools(names: Column) -> Column:
    """Names of functions: so many, so long in bytes, none blank."""
    return _given(names, (F.size(names) <= MOST_TOOLS) & F.forall(names, lambda n: (F.octet_length(n) <= LONGEST_NAME) & not_blank(n)))


def best_of(best: Column, n: Column) -> Column:
    """Within its range, and not under n."""
    return in_range("best_of", best) & (best.isNull() | (best >= F.coalesce(n, F.lit(1))))


def messages(x: Column) -> Column:
    """(F43)"""
    return F.coalesce(F.size(x) > 0, F.lit(False))


def failed(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that fail, comma-joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks])), ",")


