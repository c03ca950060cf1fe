"""Where generation stops: hidden and visible ids and sequences, least tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _running(lengths: Column) -> Column:
    """Running sums, in blocks of 64 so that a long list isn't summed anew for each of its items."""
    size = 64
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / size).cast("int"), F.lit(0))), lambda b: F.slice(lengths, b * size + 1, size))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    within = lambda xs: F.transform(xs, lambda _, i: total(F.slice(xs, 1, i + 1)))
    step = lambda s, xs: F.struct((s["t"] + total(xs)).alias("t"), F.concat(s["a"], F.transform(within(xs), lambda x: x + s["t"])).alias("a"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("a")), step)["a"]


def _is_one(ids: str, wanted: list[int], least: Column):
    return lambda i: (i >= least) & F.get(ids, i).isin(*wanted)


def _ends_before(place: Column):
    return lambda e: e < place


def first_stop(rows: DataFrame, pieces: str, ids: str, least: int, hidden_ids: list[int], visible_ids: list[int], hidden: list[str], visible: list[str], into: str = "stop") -> DataFrame:
    """rows with a struct of text (what is given out), tokens (how many were taken) and reason.

    pieces: texts of the tokens, ids: their ids.  Tokens are taken in order until one is a stop id, or completes a stop sequence in the
    text so far; nothing stops before ``least`` tokens.  A hidden stop isn't in the text, a visible one is; of an id that is both, hidden
    wins; an id goes before a sequence that ends with the same token.  Each sequence is searched for once, from where it may first end.
    """
    n = F.size(pieces)
    rows = rows.withColumn("_whole", F.array_join(pieces, ""))
    rows = rows.withColumn("_ends", _running(F.transform(pieces, lambda p: F.length(p))))
    begin = lambda i: F.coalesce(F.get("_ends", i - 1), F.lit(0))
    least_at = F.lit(max(least - 1, 0))
    tries = []
    for rank, (kind, wanted) in enumerate((("hidden", hidden_ids), ("visible", visible_ids))):
        if wanted:
            at = F.get(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), _is_one(ids, wanted, least_at)), F.lit(0))
            tries.append(F.when(at.isNotNull(), F.struct((at + 1).alias("tokens"), F.lit(rank).alias("rank"), (begin(at) if kind == "hidden" else F.get("_ends", at)).alias("cut"), F.lit(f"{kind} id").alias("reason"))))
    for rank, (kind, words) in enumerate((("hidden", hidden), ("visible", visible)), 2):
        for w in words:
            start = F.greatest(begin(least_at) - (len(w) - 1), F.lit(0))
            found = F.instr(F.substring(F.col("_whole"), start + 1, F.length("_whole")), w)
            first = start + found - 1
            taken = F.size(F.filter("_ends", _ends_before(first + len(w)))) + 1
            tries.append(F.when(found > 0, F.struct(taken.alias("tokens"), F.lit(rank).alias("rank"), (first + (0 if kind == "hidden" else len(w))).alias("cut"), F.lit(f"{kind} sequence").alias("reason"))))
    best = F.array_min(F.array_compact(F.array(*tries))) if tries else F.lit(None).cast("struct<tokens int, rank int, cut int, reason string>")
    rows = rows.withColumn("_best", best)
    none = F.struct(F.col("_whole").alias("text"), n.alias("tokens"), F.lit("none").alias("reason"))
    stop = F.struct(F.substring(F.col("_whole"), F.lit(1), F.col("_best.cut")).alias("text"), F.col("_best.tokens").alias("tokens"), F.col("_best.reason").alias("reason"))
    return rows.withColumn(into, F.when(F.col("_best").isNull() | (n == 0), none).otherwise(stop)).drop("_whole", "_ends", "_best")


def partial(text: Column, patterns: list[str]) -> Column:
    """Of several patterns: complete with the place of the leftmost, partial with the place from which the text's end may begin one, or none."""
    whole = F.array_min(F.filter(F.array(*[F.instr(text, p) for p in patterns]), lambda i: i > 0)) - 1
    begun = [F.when(F.endswith(text, F.lit(p[:i])), F.length(text) - i) for p in patterns for i in range(1, len(p))]
    part = F.least(F.lit(None).cast("int"), F.lit(None).cast("int"), *begun)
    return F.struct(F.when(whole.isNotNull(), "complete").when(part.isNotNull(), "partial").otherwise("none").alias("match"), F.coalesce(whole, part).alias("at"))


def released(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """What of a chunk may be given out now, and what is held back as it may begin a pattern."""
    m = partial(text, patterns)
    held = F.when(m["match"] == "partial", F.substring(text, m["at"] + 1, F.length(text))).otherwise(F.lit(""))
    return F.substring(text, F.lit(1), F.length(text) - F.length(held)), held
