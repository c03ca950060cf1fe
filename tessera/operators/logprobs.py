"""How sure a model was of its tokens: rows of choice, position, selected (logprob, token) and top (array of the same)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAME = 1e-6
TIE, CLEAR = 0.01, 0.05


def merged(selected: Column, top: Column) -> Column:
    """Candidates by falling logprob, the selected one put after those at least as likely, unless it is there."""
    there = F.exists(top, lambda t: (t["token"] == selected["token"]) & (F.abs(t["logprob"] - selected["logprob"]) < SAME))
    ranked = F.array_sort(F.transform(top, lambda t, i: F.struct((-t["logprob"]).alias("k"), F.lit(0).alias("late"), i.alias("i"), t.alias("t"))))
    own = F.struct((-selected["logprob"]).alias("k"), F.lit(1).alias("late"), F.lit(0).alias("i"), selected.alias("t"))
    all_ = F.when(there, ranked).otherwise(F.array_sort(F.array_append(ranked, own)))
    return F.transform(all_, lambda x: x["t"])


def with_selected(token_id: Column, selected: Column, top: Column) -> Column:
    """A payload's top list with the selected token at its end if its id isn't there."""
    return F.when(F.exists(top, lambda t: t["id"] == token_id), top).otherwise(F.array_append(top, selected))


def closeness(rows: DataFrame) -> DataFrame:
    """choice, position, logprob_gap, gap (of the two most likely), remaining (mass of no candidate), candidates; positions with fewer than two are left out."""
    c = rows.select("choice", "position", merged(F.col("selected"), F.col("top")).alias("candidates")).where(F.size("candidates") >= 2)
    a, b = F.col("candidates")[0]["logprob"], F.col("candidates")[1]["logprob"]
    mass = F.aggregate("candidates", F.lit(0.0), lambda s, t: s + F.exp(t["logprob"]))
    return c.select("choice", "position", (a - b).alias("logprob_gap"), (F.exp(a) - F.exp(b)).alias("gap"), (1 - mass).alias("remaining"), "candidates")


def close_positions(positions: DataFrame, threshold: float) -> DataFrame:
    """(M16)"""
    return positions.where(F.col("gap") <= threshold)


def closest(positions: DataFrame, count: int) -> DataFrame:
    """The count most uncertain positions of each choice; ties by position (O7).  Each task keeps no more than count of a choice before the shuffle."""
    place = F.row_number().over(Window.partitionBy("choice").orderBy("gap", "position"))
    return positions.withColumn("place", place).where(F.col("place") <= count).select("choice", "place", "position", "gap")


def several_close(positions: DataFrame, threshold: float) -> DataFrame:
    """Positions where more than two candidates are within threshold of the first: close (their number) and spread.

    Candidates fall, so that those within are the first ones.
    """
    first = F.exp(F.col("candidates")[0]["logprob"])
    near = F.filter("candidates", lambda t: first - F.exp(t["logprob"]) <= threshold)
    found = positions.select("choice", "position", F.size(near).alias("close"), (first - F.exp(F.element_at(near, -1)["logprob"])).alias("spread"))
    return found.where("close > 2")


def report(positions: DataFrame, threshold: float) -> DataFrame:
    """Of each choice: positions, close_percent (M17), greedy_percent (M20), greedy: over half tie or win clearly."""
    close, likely = F.col("gap") <= threshold, (F.col("gap") < TIE) | (F.col("gap") > CLEAR)
    percent = lambda what: 100.0 * F.count(F.when(what, 1)) / F.count("*")
    return positions.groupBy("choice").agg(F.count("*").alias("positions"), percent(close).alias("close_percent"), percent(likely).alias("greedy_percent"), (F.count(F.when(likely, 1)) / F.count("*") > 0.5).alias("greedy"))
