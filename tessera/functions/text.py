"""Text and stream expressions: folds, reasoning, stops, agents, exposition format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(deltas: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Chunks of a stream joined in order."""
    return deltas.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("text"), F.count("*").alias("chunks"))


_WHITE = " \t\r\n\f\v"


def reasoning(text: Column, begin: str = "<think>", end: str = "</think>", forced: bool = False) -> tuple[Column, Column]:
    """(normal, reasoning), read from left to right: a begin marker opens a span up to the next end marker or the end of the text.

    Markers are regular expressions.  A begin marker within a span and an end marker outside one are text.  Without a begin marker the
    text is as it stands: normal, or reasoning if forced and no end marker either.  forced: the text begins within a span.
    """
    span = f"(?s)(?:{begin})(.*?)(?:{end}|\\z)"
    if forced:
        span = f"(?s)(?:\\A|{begin})(.*?)(?:{end}|\\z)"
    inner = F.btrim(F.array_join(F.regexp_extract_all(text, F.lit(span), 1), ""), F.lit(_WHITE))
    outer = F.btrim(F.regexp_replace(text, span, ""), F.lit(_WHITE))
    if forced:
        plain = ~text.rlike(f"(?:{begin})|(?:{end})")
        return F.when(plain, F.lit("")).otherwise(outer), F.when(plain, text).otherwise(inner)
    there = text.rlike(begin)
    return F.when(there, outer).otherwise(text), F.when(there, inner).otherwise(F.lit(""))


# Markers of reasoning by model family; the third says whether a text begins within a span.
REASONING = {
    "basic": ("<think>", "</think>", False),
    "qwen": ("<think>", "</think>", False),
    "nemotron_deci": ("<think>", "</think>", False),
    "deepseek_r1": ("<think>", "</think>", True),
    "step3": ("<think>", "</think>", True),
    "kimi": ("◁think▷", "◁/think▷", False),
    "mistral": (r"\[THINK\]", r"\[/THINK\]", True),
    "granite": ("Here's my thought process:|Here is my thought process:", "Here's my response:|Here is my response:", False),
}


def reasoning_by(family: str, text: Column) -> tuple[Column, Column]:
    """The split of a model family (X3, X6); an unknown one reads as basic."""
    begin, end, forced = REASONING.get(family, REASONING["basic"])
    return reasoning(text, begin, end, forced)


def append_think(text: Column, begin: str = "<think>") -> Column:
    """The text as one that opens with the marker, nothing split off."""
    return F.concat(F.lit(begin), text)


def stop(text: Column, stops: list[str]) -> Column:
    """The text before whichever stop sequence stands first."""
    first = F.array_min(F.filter(F.array(*[F.instr(text, s) for s in stops]), lambda i: i > 0))
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def agent(system: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule whose keyword the prompt holds."""
    out = F.lit(default)
    for word, name in reversed(rules):
        out = F.when(F.contains(F.lower(system), F.lit(word)), name).otherwise(out)
    return out


def violations(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that fail; null passes."""
    return F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks])), ",")


_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def _unescape(value: Column) -> Column:
    for sign, plain in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\x00", "\\")):
        value = F.replace(value, F.lit(sign), F.lit(plain))
    return value


def sample_line(line: Column) -> Column:
    """A line of the Prometheus text format as name, labels and value; null if it is none.

    Label values may hold commas, braces and escaped quotes; of a label that stands twice the first counts.
    """
    p = rf"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{{((?:\s*{_LABEL}\s*,?)*)\s*\}})?\s+(\S+)"
    inner = F.regexp_extract(line, p, 2)
    names, values = F.regexp_extract_all(inner, F.lit(_LABEL), 1), F.regexp_extract_all(inner, F.lit(_LABEL), 2)
    places = F.filter(F.transform(names, lambda n, i: F.when(F.array_position(names, n) == i + 1, i)), lambda i: i.isNotNull())
    labels = F.map_from_entries(F.transform(places, lambda i: F.struct(F.get(names, i).alias("key"), _unescape(F.get(values, i)).alias("value"))))
    return F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).alias("name"), labels.alias("labels"), F.regexp_extract(line, p, 5).try_cast("double").alias("value")))


def sse(stream: Column) -> Column:
    """Messages of a server-sent-event text: arrays of event, data, id and comments (S17).  Lines end in LF, CR LF or CR."""
    plain = F.regexp_replace(stream, "\r\n?", "\n")
    parts = F.filter(F.split(plain, "\n\n+"), lambda m: F.trim(m) != "")
    field = lambda m, name: F.regexp_extract_all(m, F.lit(rf"(?m)^{name}(?:$|: ?(.*)$)"), 1)
    joined = lambda m, name: F.when(F.size(field(m, name)) > 0, F.array_join(field(m, name), "\n"))
    last = lambda m, name: F.try_element_at(field(m, name), F.lit(-1))
    return F.transform(
        parts,
        lambda m: F.struct(last(m, "event").alias("event"), joined(m, "data").alias("data"), last(m, "id").alias("id"), F.regexp_extract_all(m, F.lit(r"(?m)^: ?(.*)$"), 1).alias("comments")),
    )


def marker_ranges(tokens: Column, marker: int) -> Column:
    """[start, end) of each run of the marker."""
    n = F.size(tokens)
    is_ = lambda i: F.coalesce(F.get(tokens, i) == marker, F.lit(False))
    places = F.sequence(F.lit(0), n)
    starts = F.filter(places, lambda i: is_(i) & ~is_(i - 1))
    ends = F.filter(places, lambda i: ~is_(i) & is_(i - 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))


def replace_ranges(tokens: Column, ranges: Column, value: Column) -> Column:
    """The tokens with those in the ranges replaced in place."""
    return F.transform(tokens, lambda t, i: F.when(F.exists(ranges, lambda r: (r["start"] <= i) & (i < r["stop"])), value).otherwise(t))


def split_ranges(ranges: Column, sizes: Column) -> Column:
    """Contiguous ranges cut into items of given sizes, in order; null unless every range is filled exactly.

    As the items lie one after another and none spans two ranges, the running sums of the sizes must hold those of the ranges.
    """
    running = lambda xs: F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, 1, i + 1), F.lit(0), lambda a, x: a + x.cast("int")))
    lengths = F.transform(ranges, lambda r: r["stop"] - r["start"])
    ends, wanted = running(lengths), running(sizes)

    def item(size, i):
        begin = F.get(wanted, i) - size
        own = F.size(F.filter(ends, lambda e: e <= begin))
        start = F.get(ranges, own)["start"] + begin - F.coalesce(F.get(ends, own - 1), F.lit(0))
        return F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("stop"))

    exact = (F.size(ranges) > 0) & (F.size(F.array_except(ends, wanted)) == 0) & (F.element_at(ends, -1) == F.element_at(wanted, -1))
    return F.when(exact, F.transform(sizes, item))


def message_text(messages: Column) -> Column:
    """An array of (role, content, parts) as lines: content, or the texts of its parts."""
    one = lambda m: F.coalesce(m["content"], F.array_join(F.transform(F.filter(m["parts"], lambda p: p["type"] == "text"), lambda p: p["text"]), "\n"), F.lit(""))
    return F.array_join(F.transform(messages, lambda m: F.concat_ws(": ", m["role"], one(m))), "\n")


def slug(name: Column) -> Column:
    """A model name as a label: lower case, anything but letters, digits, dash and underscore an underscore."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "_")


def folder_config(path: Column, prefix: str = "ctx") -> Column:
    """Numbers in a folder name such as ctx2_gen4_dep16_batch64, by the word before each."""
    name = F.regexp_extract(path, r"([^/]+)/?$", 1)
    words, numbers = (F.regexp_extract_all(name, F.lit(r"([a-z]+)(\d+)"), i) for i in (1, 2))
    first = F.filter(F.transform(words, lambda w, i: F.when(F.array_position(words, w) == i + 1, i)), lambda i: i.isNotNull())
    pairs = F.map_from_entries(F.transform(first, lambda i: F.struct(F.get(words, i).alias("key"), F.get(numbers, i).cast("long").alias("value"))))
    return F.when(F.map_contains_key(pairs, F.lit(prefix)), pairs)


def json_dump(value: Column) -> Column:
    """JSON with a blank after each comma and colon outside of strings."""
    return F.regexp_replace(F.to_json(value) if not isinstance(value, str) else F.col(value), r'([,:])(?=(?:[^"\\]|\\.|"(?:[^"\\]|\\.)*")*$)', "$1 ")
