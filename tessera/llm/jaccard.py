"""Exact self-join of documents by Jaccard similarity of word shingles, with signature trees.

Documents with equal shingle sets are one class.  Classes are dealt to trees so
that no link is lost, and each tree is searched against itself:

1. Bands of minhashes are the keys that deal classes to trees: sets with a band in common, and whose
   sizes allow similarity t along the chain of sizes, go to the same tree.  There are so many
   bands that a link at exactly similarity t is missed with a probability of MISS
   at most, which is of the order of the hashes' own collisions.
2. A tree has leaves of LEAF sets and nodes of FANOUT children; each node holds
   the OR of its sets' token bitmaps, its range of sizes and the most tokens
   that its bitmap can hide.  Two nodes are searched together only if the
   largest overlap that these allow reaches the overlap that t needs.  Pairs of
   sets that survive are compared exactly.  A tree over TREE_TOKENS
   tokens is several trees by size range, paired with each other as tasks.
3. Links become components.

Edge cases: words are split at ASCII white space after lower-casing A-Z; with
fewer words than a shingle takes, the whole sequence is one shingle; a null or
empty text has no shingles and links with nothing; repeated rows are kept; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

MISS = 1e-12
LEAF = 8
FANOUT = 8
TREE_TOKENS = 1_000_000
WORDS_KEPT = 400_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    if len(_WORDS) > WORDS_KEPT:
        _WORDS.clear()
    words = [t.encode().lower().split() if t else [] for t in texts]
    counts = [len(w) for w in words]
    flat = np.fromiter((h for ws in words for h in map(_WORDS.__getitem__, ws)), np.uint64, sum(counts))
    rolled = flat[: max(0, len(flat) - k + 1)].copy()
    for i in range(1, k):
        rolled = rolled * _A + flat[i : i + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts:
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            h = np.uint64(n)
            for x in flat[at : at + n]:
                h = h * _A + x
            out.append(mix(np.array([h ^ _C], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _slices(batch: pa.RecordBatch, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def bands(percent: int, most: int = 640) -> tuple[int, int]:
    """(bands, rows of each): the most selective rows for which MISS takes no more than most hashes."""
    best = (0, 0)
    for rows in range(1, 33):
        count = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))
        if count * rows <= most:
            best = (count, rows)
    return best


def band_keys(tokens: np.ndarray, count: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of the set's minhashes."""
    a = mix(np.arange(1, count * rows + 1, dtype=np.uint64) * _A).astype(np.uint32) | np.uint32(1)
    x = (tokens >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(count * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512] * a).min(0), out=least)
    h = np.arange(count, dtype=np.uint64)
    for column in least.reshape(count, rows).T:
        h = mix(h * _A + column)
    return h


CLASSES_SEEN = 200_000
_KEYED = "doc_id long, text_hash long, n int, class long, keys array<long>"


def _keys(k: int, percent: int):
    count, rows = bands(percent)

    def keyed(batches):
        common.claim("jaccard", _WORDS.clear)
        seen: set[int] = set()  # a class that this task has dealt already needs no keys: hot copies leave it once
        with np.errstate(over="ignore"):
            for batch in batches:
                for some in _slices(batch):
                    sets = shingles(some.column(2).to_pylist(), k)
                    ids, keys, ends = [], [], [0]
                    for s in sets:
                        c = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                        ids.append(c)
                        new = c is not None and c not in seen
                        if new:
                            if len(seen) >= CLASSES_SEEN:
                                seen.clear()
                            seen.add(c)
                            keys.append(band_keys(s, count, rows))
                        ends.append(ends[-1] + count * new)
                    values = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), some.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                        ["doc_id", "text_hash", "n", "class", "keys"],
                    )

    return keyed


class Tree:
    """A signature tree over sets sorted by size, searched against itself or another."""

    def __init__(self, classes: list[int], sets: list[np.ndarray], bits: int):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]), classes[i]))
        self.classes = [classes[i] for i in order]
        self.sets = [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        words = bits // 64
        self.maps = np.zeros((len(order), words), np.uint64)
        for row, s in zip(self.maps, self.sets, strict=True):
            place = (s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(row, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        self.hidden = self.sizes - np.bitwise_count(self.maps).sum(1).astype(np.int64)
        # levels[0]: leaves.  A node: begin and end of its sets, OR map, least and largest size, most hidden tokens
        self.levels = [[self._node(b, min(b + LEAF, len(order))) for b in range(0, len(order), LEAF)]]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append([self._over(low[b : b + FANOUT]) for b in range(0, len(low), FANOUT)])

    def _node(self, b: int, e: int):
        return b, e, np.bitwise_or.reduce(self.maps[b:e], 0), int(self.sizes[b]), int(self.sizes[e - 1]), int(self.hidden[b:e].max())

    @staticmethod
    def _over(nodes):
        return nodes[0][0], nodes[-1][1], np.bitwise_or.reduce([x[2] for x in nodes], 0), nodes[0][3], nodes[-1][4], max(x[5] for x in nodes)


def _search(x: Tree, y: Tree, percent: int, group: np.ndarray, shift: int) -> None:
    """Give one group (a number for each of x's sets, then y's from shift on) to all sets that links join.

    Pairs that are of one group already need no look.
    """
    same = x is y
    members = {int(g): [int(g)] for g in group}  # of each group; the smaller one takes the other's number
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        li, i, lj, j = stack.pop()
        p, q = x.levels[li][i], y.levels[lj][j]
        if p[4] * 100 < percent * q[3] or q[4] * 100 < percent * p[3]:
            continue
        need = -(-percent * (p[3] + q[3]) // (100 + percent))
        if min(p[4], q[4], int(np.bitwise_count(p[2] & q[2]).sum()) + min(p[5], q[5])) < need:
            continue
        g, h = group[p[0] : p[1]], group[q[0] + shift : q[1] + shift]
        if g[0] == h[0] and (g == g[0]).all() and (h == g[0]).all():
            continue
        if li == 0 and lj == 0:
            shared = np.bitwise_count(x.maps[p[0] : p[1], None] & y.maps[None, q[0] : q[1]]).sum(2).astype(np.int64)
            a, b = x.sizes[p[0] : p[1], None], y.sizes[None, q[0] : q[1]]
            most = np.minimum(shared + np.minimum(x.hidden[p[0] : p[1], None], y.hidden[None, q[0] : q[1]]), np.minimum(a, b))
            for u, v in np.argwhere((most * (100 + percent) >= percent * (a + b)) & (g[:, None] != h[None])).tolist():
                u, v = u + p[0], v + q[0]
                if (same and u >= v) or group[u] == group[v + shift]:
                    continue
                s, t = x.sets[u], y.sets[v]
                inside = int(np.isin(s, t, assume_unique=True, kind="sort").sum())
                if 100 * inside >= percent * (len(s) + len(t) - inside):
                    big, small = sorted((int(group[u]), int(group[v + shift])), key=lambda g: -len(members[g]))
                    group[members[small]] = big
                    members[big] += members.pop(small)
            continue
        if li >= lj:  # open the higher one
            down = [(li - 1, c, lj, j) for c in range(i * FANOUT, min((i + 1) * FANOUT, len(x.levels[li - 1])))]
        else:
            down = [(li, i, lj - 1, c) for c in range(j * FANOUT, min((j + 1) * FANOUT, len(y.levels[lj - 1])))]
        for d in down:
            # of a tree against itself, a pair of nodes and its mirror are one
            if not same or x.levels[d[0]][d[1]][0] < y.levels[d[2]][d[3]][1]:
                stack.append(d)


def links_of(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join what links join among left (right None), or between left and right: each set with its group's least class."""
    read = lambda rows: ([c for c, _ in rows], [s for _, s in rows])
    most = max(len(s) for _, s in left + (right or []))
    bits = min(1 << 16, max(256, 1 << (2 * most - 1).bit_length()))
    x = Tree(*read(left), bits)
    y = x if right is None else Tree(*read(right), bits)
    classes = x.classes if right is None else x.classes + y.classes
    group = np.arange(len(classes))
    _search(x, y, percent, group, 0 if right is None else len(x.classes))
    groups: dict[int, list[int]] = {}
    for g, c in zip(group.tolist(), classes, strict=True):
        groups.setdefault(g, []).append(c)
    return [(min(g), c) for g in groups.values() if len(g) > 1 for c in g if c != min(g)]


def _trees(k: int, percent: int):
    """Rows of a task stand together: task, side of the pair (0 or 1), whether there are two sides, class, text."""

    def trees(batches):
        common.claim("jaccard", _WORDS.clear)
        now, sides, paired = None, ({}, {}), False

        def done():
            if sides[0] and (sides[1] or not paired):
                found = links_of(list(sides[0].items()), list(sides[1].items()) if paired else None, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        with np.errstate(over="ignore"):
            for batch in batches:
                for some in _slices(batch):
                    sets = shingles(some.column(4).to_pylist(), k)
                    for task, side, two, c, s in zip(*(some.column(i).to_pylist() for i in range(4)), sets, strict=True):
                        if task != now:
                            yield from done()
                            now, sides, paired = task, ({}, {}), two
                        sides[side].setdefault(c, s)  # a row may be there more than once
            yield from done()

    return trees


def classify(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs: doc_id, text.  Returns for each row: doc_id, text_hash, n_shingles, class, root, component_id.

    class names the shingle set (null: none), root the component, also where doc_ids repeat; component_id is the least doc_id
    that links reach, the row's own included.
    """
    spark = docs.sparkSession
    common.ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    marked = common.materialise(rows.mapInArrow(_keys(words, percent), _KEYED), "keyed")

    routed = marked.where("n > 0").select("class", "n", F.explode("keys").alias("key"))
    by_size = Window.partitionBy("key").orderBy("n", "class")
    gap = F.coalesce(F.lag("n").over(by_size) * 100 < F.col("n") * percent, F.lit(True))
    chained = routed.withColumn("gap", gap).withColumn("a", F.last(F.when(F.col("gap"), F.col("class")), True).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    forest = components(chained.where("a != class").select("a", F.col("class").alias("b")))

    # whose sets are wanted, and which tree they stand in
    firsts = marked.where("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"))
    firsts = firsts.select("class", "n", "least_id", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    members = common.materialise(firsts.join(forest.withColumnRenamed("node", "class"), "class"), "members")
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).cast("int")
    totals = members.groupBy("root").agg(F.sum("n").alias("all_tokens"))
    ranged = members.join(totals, "root").withColumn("range", F.when(F.col("all_tokens") > TREE_TOKENS, size).otherwise(0))
    held = ranged.groupBy("root", "range").agg(F.ceil(F.sum("n") / TREE_TOKENS).cast("int").alias("trees"))
    placed = ranged.join(held, ["root", "range"]).withColumn("tree", F.pmod(F.xxhash64("class"), F.col("trees")).cast("int"))
    nodes = held.select("root", "range", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    p, q = nodes.alias("p"), nodes.alias("q")
    # two trees meet if they are of one size range or of neighbouring ones; a class of the range below may be a tree of its own
    meet = (F.col("p.root") == F.col("q.root")) & (((F.col("p.range") == F.col("q.range")) & (F.col("p.tree") <= F.col("q.tree"))) | (F.col("q.range") - F.col("p.range")).isin(1, 2))
    pairs = p.join(q, meet).select(F.col("p.root").alias("root"), F.col("p.range").alias("r1"), F.col("p.tree").alias("t1"), F.col("q.range").alias("r2"), F.col("q.tree").alias("t2"))
    pairs = pairs.withColumn("two", (F.col("r1") != F.col("r2")) | (F.col("t1") != F.col("t2")))
    one = pairs.select("root", F.col("r1").alias("range"), F.col("t1").alias("tree"), F.lit(0).alias("side"), "two", F.xxhash64("root", "r1", "t1", "r2", "t2").alias("task"))
    two = pairs.where("two").select("root", F.col("r2").alias("range"), F.col("t2").alias("tree"), F.lit(1).alias("side"), "two", F.xxhash64("root", "r1", "t1", "r2", "t2").alias("task"))
    sides = one.unionByName(two)

    places = common.materialise(placed.select("class", "first_id", "first_hash", "root", "range", "tree").join(sides, ["root", "range", "tree"]), "places")
    match = (F.col("text_hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    # by merge at any size: neither side has a bound
    wanted = rows.join(places.hint("merge"), match).select("task", "side", "two", "class", "text")
    ordered = wanted.repartition(common.partitions(spark), "task").sortWithinPartitions("task", "side")
    found = ordered.mapInArrow(_trees(words, percent), "a long, b long")
    linked = components(found)

    heads = firsts.join(linked.withColumnRenamed("node", "class"), "class", "left").select("class", "least_id", F.coalesce("root", "class").alias("root"))
    least = heads.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = heads.join(least, "root").select("class", "root", "component_id")
    return marked.join(named, "class", "left").select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "class", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the least (doc_id, text hash); rows without shingles all stay."""
    found = classify(docs, words, percent).where("n_shingles > 0")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("x"))
    h, there = common.fresh_name(docs, "text_hash"), common.fresh_name(docs, "kept_id")
    best = first.select(F.col("x.doc_id").alias(there), F.col("x.text_hash").alias(h)).distinct()
    marked = docs.withColumn(h, F.xxhash64("text"))
    some = marked.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    one = some.join(best, (some["doc_id"].eqNullSafe(best[there])) & (some[h] == best[h]), "left_semi").dropDuplicates(["doc_id", h])
    return one.drop(h).unionByName(marked.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).drop(h))
