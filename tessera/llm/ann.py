"""Nearest neighbours by cosine over shifted space-filling curves.

Unit vectors are projected by CURVES orthonormal maps to DIMS numbers each, shifted
and quantised; their Hilbert keys give CURVES orderings of all rows.  Each ordering
is cut at quantiles into blocks of at most BLOCK_ROWS rows; a query meets the
blocks within its window, ``share`` of the ordering, and what it finds on all curves is merged and ranked by
the exact cosine of the original vectors in double precision.

Equal vectors stand in the orderings once, with their k + 1 smallest ids: any query's
k nearest among them are of those, so large groups of copies cost nothing and lose nothing.

The maps are random; only the centres and widths of the projections are fitted, on
FIT_ROWS rows.  Every row is indexed.

Edge cases: vectors that are null, zero, of another length than most of the fitted rows, or hold null or
non-finite numbers take no part, nor does a null id; rows that repeat an id and its vector count
once; equal scores rank by id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CURVES = 8
DIMS = 4
BITS = 10
BLOCK_ROWS = 8192
LEAST_BLOCKS = 40
FIT_ROWS = 10_000
SEED = 17


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of integer cells (rows x dims), by the transpose algorithm."""
    x = cells.T.astype(np.int64).copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        below = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    gray, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        gray ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= gray
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


class Curves:
    """The fitted orderings: fixed in size, sent with the tasks."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        columns = []
        while sum(c.shape[1] for c in columns) < curves * dims:
            columns.append(np.linalg.qr(rng.normal(size=(width, width)))[0])
        self.map = np.hstack(columns)[:, : curves * dims]
        projected = sample @ self.map
        self.middle, self.spread = projected.mean(0), np.maximum(projected.std(0), 1e-12)
        self.shift = rng.uniform(-0.05, 0.05, curves * dims)
        self.curves, self.dims, self.width = curves, dims, width

    def keys(self, unit: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """rows x curves.  The low 20 bits come from the id, so that quantiles also part rows of one cell."""
        at = ((unit @ self.map - self.middle) / self.spread / 8 + 0.5 + self.shift) * (1 << BITS)
        cells = np.clip(at, 0, (1 << BITS) - 1).astype(np.int64)
        low = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        return np.stack([hilbert(cells[:, c * self.dims : (c + 1) * self.dims], BITS) << 20 | low for c in range(self.curves)], 1)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _keyed(curves: Curves):
    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                keys = curves.keys(_unit(_vectors(batch.column("embedding"))), batch.column("vec_id").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    return keyed


def _meet(k: int, width: int):
    """Rows of a (curve, block) stand together, candidates (side 0) before queries."""

    def found(queries, ids, vectors, norms, lists):
        own = _vectors_of(queries, width)
        score = own @ vectors.T / (np.linalg.norm(own, axis=1)[:, None] * norms[None])
        few = min(k + 1, score.shape[1])
        kth = -np.partition(-score, few - 1, axis=1)[:, few - 1]
        for row, (query, limit) in enumerate(zip(queries, kth, strict=True)):
            # the product of matrices picks, one sum of fixed order ranks: a pair has the same score in any block
            near = np.flatnonzero(score[row] >= limit - 1e-12)
            exact = [-float(np.dot(own[row], vectors[c]) / (np.sqrt(np.dot(own[row], own[row])) * np.sqrt(np.dot(vectors[c], vectors[c])))) for c in near]
            some = sorted((s, i) for s, c in zip(exact, near, strict=True) for i in lists[c] if i != query[0])
            for s, i in some[:k]:
                ids.append((query[0], i, -s))

    def _vectors_of(rows, width):
        return np.array([v for _, v in rows], np.float64).reshape(len(rows), width)

    def meet(batches):
        now, vectors, lists, norms, waiting, out = None, [], [], None, [], []

        def flush():
            nonlocal norms, vectors
            if waiting and lists:
                if norms is None:
                    vectors = np.array(vectors, np.float64)
                    norms = np.linalg.norm(vectors, axis=1)
                found(waiting, out, vectors, norms, lists)
            waiting.clear()

        def drain():
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            curve, block, side, ids, own = (batch.column(n) for n in ("curve", "block", "side", "ids", "embedding"))
            matrix = _vectors(own) if batch.num_rows else []
            for c, b, s, i, v in zip(curve.to_pylist(), block.to_pylist(), side.to_pylist(), ids.to_pylist(), matrix, strict=True):
                if (c, b) != now:
                    flush()
                    now, vectors, lists, norms = (c, b), [], [], None
                if s == 0:
                    vectors.append(v)
                    lists.append(i)
                else:
                    waiting.append((i[0], v))
                    if len(waiting) >= 256:
                        flush()
            if len(out) > 50_000:
                yield drain()
        flush()
        if out:
            yield drain()

    return meet


def _valid(rows: DataFrame) -> DataFrame:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, share: float = 0.15) -> DataFrame:
    """rows, queries: vec_id, embedding.  Returns query_id, rank, vec_id, score: the k nearest found of other ids."""
    spark = rows.sparkSession
    common.ship_package(spark)
    pick = lambda df: _valid(df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    rows, queries = pick(rows), pick(queries)
    sample = [r[0] for r in rows.orderBy(F.xxhash64("vec_id")).limit(FIT_ROWS).select("embedding").collect()]
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], empty)
    lengths = [len(v) for v in sample]
    width = max(sorted(set(lengths)), key=lengths.count)
    curves = Curves(_unit(np.array([v for v in sample if len(v) == width])))

    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    sized = rows.where(F.size("embedding") == width).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    # Spark limits the rows of each vector to k + 1 before they leave the tasks that have them
    few = sized.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    classes = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    listed = classes.select(F.col("ids")[0].alias("vec_id"), "ids", "embedding")
    shape = "vec_id long, ids array<long>, embedding array<double>, keys array<long>"
    index = common.materialise(listed.mapInArrow(_keyed(curves), shape), "index")
    # of an id with several vectors the one with the least hash asks
    asked = queries.where(F.size("embedding") == width).groupBy("vec_id").agg(F.min_by("embedding", F.struct(F.xxhash64("embedding"), F.hash("embedding"))).alias("embedding"))
    asked = asked.select("vec_id", F.array("vec_id").alias("ids"), "embedding")
    asked = asked.mapInArrow(_keyed(curves), shape)

    total = index.count()
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_ROWS))
    steps = [i / blocks for i in range(1, blocks)]
    cuts = index.agg(*[F.percentile_approx(F.col("keys")[c], steps, max(10_000, 20 * blocks)).alias(f"c{c}") for c in range(curves.curves)])
    cuts = cuts.select(F.array(*[f"c{c}" for c in range(curves.curves)]).alias("cuts")).first()["cuts"]
    limits = spark.sparkContext.broadcast(np.array(cuts, np.int64))
    reach = max(1, int(np.ceil(share * blocks / 2)))
    dealt = "curve int, block int, side int, ids array<long>, embedding array<double>"
    # a query's window runs over reach blocks on either side
    both = index.mapInArrow(_deal(limits, 0, 0), dealt).unionByName(asked.mapInArrow(_deal(limits, 1, reach), dealt))
    ordered = both.repartition(max(common.partitions(spark), 2 * curves.curves), "curve", "block").sortWithinPartitions("curve", "block", "side")
    near = ordered.mapInArrow(_meet(k, width), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _deal(limits, side: int, reach: int):
    def deal(batches):
        cuts = limits.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column("keys").to_pylist(), np.int64)
            rows, curve, block = [], [], []
            for c in range(keys.shape[1]):
                at = np.searchsorted(cuts[c], keys[:, c], side="left")
                last = len(cuts[c])
                for d in range(-reach, reach + 1):
                    # at an end the window turns inward, so that it keeps its width
                    b = (np.clip(at, reach, max(reach, last - reach)) if reach else at) + d
                    ok = np.flatnonzero((b >= 0) & (b <= last))
                    rows.append(ok)
                    curve.append(np.full(len(ok), c))
                    block.append(b[ok])
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(curve), pa.int32()), pa.array(np.concatenate(block), pa.int32()), pa.array(np.full(len(take), side), pa.int32()), batch.column("ids").take(take), batch.column("embedding").take(take)],
                ["curve", "block", "side", "ids", "embedding"],
            )

    return deal
