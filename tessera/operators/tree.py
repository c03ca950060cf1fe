"""The prefix tree of a trace as tables: nodes (path, parent, pos, visited), chains contracted, leaves cut, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import trace

ROOT, CACHE_END, END = "root", "cache end", "end"


def nodes(paths: DataFrame) -> DataFrame:
    """path, parent, pos, visited, ended: how often a request has gone through a node, and ended there (G1)."""
    last = F.max("pos").over(Window.partitionBy("rid"))
    ends = paths.withColumn("_l", last).where("pos = _l").groupBy("path").agg(F.count("*").alias("ended"))
    return trace.tree_edges(paths).join(ends, "path", "left").select("path", "parent", "pos", "visited", F.coalesce("ended", F.lit(0)).alias("ended"))


def several_parents(edges: DataFrame) -> DataFrame:
    """Nodes with more than one parent: none in a tree."""
    return edges.groupBy("path").agg(F.countDistinct("parent").alias("parents")).where("parents > 1")


def to_leaf(tree: DataFrame) -> DataFrame:
    """The nodes with how many of their children one request alone has visited; 0 for nodes visited once."""
    once = tree.where("visited = 1").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("_n"))
    return tree.join(once, "path", "left").select(*tree.columns, F.when(F.col("visited") > 1, F.coalesce("_n", F.lit(0))).otherwise(0).alias("to_leaf"))


def unbalanced(tree: DataFrame) -> DataFrame:
    """Nodes whose visits aren't those of their children and the requests that end there: none."""
    below = tree.groupBy(F.col("parent").alias("path")).agg(F.sum("visited").alias("_n"))
    return tree.join(below, "path", "left").where(F.col("visited") != F.coalesce("_n", F.lit(0)) + F.col("ended")).select(*tree.columns)


def contracted(paths: DataFrame) -> DataFrame:
    """The tree with each run of nodes that the same requests visit as one node, its last, with the run's length.

    A child with its parent's visits is its only child and nobody has ended between, so that a run is where visits don't change
    along a request; requests are read one by one, each as long as it is.
    """
    counts = paths.groupBy("path").agg(F.count("*").alias("visited"))
    w = Window.partitionBy("rid").orderBy("pos")
    rows = paths.join(counts, "path").withColumn("_new", F.coalesce((F.lag("visited").over(w) != F.col("visited")).cast("int"), F.lit(1)))
    runs = rows.withColumn("_run", F.sum("_new").over(w)).groupBy("rid", "_run").agg(F.max_by("path", "pos").alias("path"), F.max("pos").alias("pos"), F.count("*").alias("length"), F.first("visited").alias("visited"))
    up = F.coalesce(F.lag("path").over(Window.partitionBy("rid").orderBy("_run")), F.lit(ROOT))
    return runs.withColumn("parent", up).groupBy("path").agg(*[F.first(c).alias(c) for c in ("parent", "pos", "length", "visited")])


def without_leaves(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that more than one request has visited, and the lengths of those cut off."""
    return tree.where("visited > 1"), tree.where("visited = 1").groupBy("length").agg(F.count("*").alias("leaves"))


def transitions(tree: DataFrame) -> DataFrame:
    """path, next, cdf: from each node to its children that stay, to a leaf (CACHE_END) or to the end of the request (END).

    tree: with visited, ended and to_leaf.
    """
    stays = tree.where("visited > 1")
    down = stays.where(F.col("parent") != ROOT).select(F.col("parent").alias("path"), F.lit(0).alias("k"), F.col("path").alias("next"), F.col("visited").alias("w"))
    special = [stays.select("path", F.lit(k).alias("k"), F.lit(name).alias("next"), F.col(c).cast("long").alias("w")) for k, name, c in ((1, CACHE_END, "to_leaf"), (2, END, "ended"))]
    each = down.unionByName(special[0]).unionByName(special[1])
    w = Window.partitionBy("path")
    run = F.sum("w").over(w.orderBy("k", "next").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("total", F.sum("w").over(w)).select("path", "next", F.when(F.col("total") > 0, run / F.col("total")).otherwise(0.0).alias("cdf"))


def root_report(tree: DataFrame, least: int = 5) -> DataFrame:
    """Of the nodes at the root with so many visits: of each length how many, and their visits."""
    return tree.where((F.col("parent") == ROOT) & (F.col("visited") >= least)).groupBy("length").agg(F.count("*").alias("nodes"), F.sort_array(F.collect_list("visited"), False).alias("visits"))


def scaled(tree: DataFrame, factor: float) -> DataFrame:
    """Lengths times a factor, at least one."""
    return tree.withColumn("length", F.greatest(F.lit(1), F.round(F.col("length") * factor)).cast("long"))


def size(tree: DataFrame) -> DataFrame:
    """Nodes, blocks and the deepest place of an index."""
    return tree.agg(F.count("*").alias("nodes"), F.sum("visited").alias("visits"), (F.max("pos") + 1).alias("depth"))
