"""Language identification by nearest centroid.

A text is the L2-normalised TF-IDF vector of its hashed letter trigrams (FEATURES
of them); each language has CLUSTERS centroids found by spherical k-means; the
language of the centroid with the largest cosine wins.  A text is *rejected* if its
cosine is under REJECT of the least that training texts of its language had; the cosine
of a text shorter than those is expected to fall as the root of its length.

Training reads at most SAMPLE labelled texts of each language, those with
the smallest hash of doc_id; prediction reads the whole text and nothing else.

Edge cases: a null text, or one with no letter, is ``und`` with score 0 and rejected; equal cosines go to the
language that sorts first; with no labelled rows every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FEATURES = 4096
CLUSTERS = 3
SAMPLE = 400
LEAST_TEXTS = 5
CHOSEN_SENT = 200_000
REJECT = 0.7
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def counts(text: str | None) -> np.ndarray | None:
    """How often the text has each feature; None if it has no letter."""
    if not text:
        return None
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    letter = x != 32
    if not letter.any():
        return None
    blank = np.ones(len(x) + 2, bool)
    blank[1:-1] = ~letter
    x = np.concatenate([[32], x, [32]]).astype(np.uint32)
    x = x[~(blank & np.concatenate([[False], blank[:-1]]))]
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    return np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(20), minlength=FEATURES)


def _vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    v = np.log1p(np.array(rows, np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _bucket(grams: int) -> int:
    return int(grams).bit_length()


def _document_counts(batches):
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if (c := counts(text)) is not None:
                df += c > 0
                n += 1
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.tobytes()]})


_FITTED = "lang string, centroid binary, bucket long, least double"


def _centroids(idf):
    def centroids(key: tuple, table: pa.Table) -> pa.Table:
        lang, rows = key[0].as_py(), [c for c in map(counts, table.column("text").to_pylist()) if c is not None]
        out: list[tuple] = []
        if rows:
            v = _vectors(rows, idf)
            centre = [v.mean(0)]  # the farthest text from those chosen is next
            while len(centre) < min(CLUSTERS, len(v)):
                centre.append(v[np.argmin((v @ np.array(centre).T).max(1))])
            centre = np.array(centre)
            for _ in range(8):
                own = (v @ centre.T).argmax(1)
                for c in range(len(centre)):
                    if (own == c).any():
                        centre[c] = v[own == c].mean(0)
                centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
            near = (v @ centre.T).max(1)
            out = [(lang, c.astype(np.float32).tobytes(), None, None) for c in centre]
            size = np.array([_bucket(int(r.sum())) for r in rows])
            out += [(lang, None, int(b), float(near[size == b].min())) for b in np.unique(size) if (size == b).sum() >= LEAST_TEXTS]
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.float64()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "centroid", "bucket", "least"])

    return centroids


class Model:
    """Centroids (rows), their languages, IDF and the rejection limits by length; its size depends on the number of languages alone."""

    def __init__(self, langs: list[str], matrix: np.ndarray, idf: np.ndarray, limits: dict[tuple[str, int], float]):
        self.langs, self.matrix, self.idf, self.limits = langs, matrix, idf, limits

    def limit(self, lang: str, grams: int) -> float:
        """The least cosine of training texts of that language, less for a text shorter than those.

        Over all its lengths: those with few texts have too high a least.
        """
        known = {k: v for (x, k), v in self.limits.items() if x == lang}
        if not known:
            return 0.0
        return min(known.values()) * 2 ** (min(0, _bucket(grams) - min(known)) / 2)


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """lang, text of at most so many labelled rows of each language, those with the least hash of doc_id.

    Rows beyond a cut of the hash that leaves about four times as many are gone before any shuffle, so that a language
    of most rows sends a task no more than one of few.  The languages are as many as the model has.
    """
    narrow = docs.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    seen = {r["lang"]: r["n"] for r in narrow.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    cut = {lang: min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * (4 * sample + 40) / n)) for lang, n in seen.items()}
    if not cut:
        return docs.select("lang", "text").limit(0)
    cuts = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
    few = narrow.where(F.col("h") <= F.element_at(cuts, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = few.withColumn("place", place).where(F.col("place") <= sample).select("doc_id", F.col("lang").alias("its"), "place")
    if sample * len(cut) <= CHOSEN_SENT:
        chosen = F.broadcast(chosen)
    # ids may repeat: the first text of a chosen row
    met = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"]) & (docs["lang"] == chosen["its"]))
    return met.groupBy("its", "place").agg(F.min("text").alias("text")).select(F.col("its").alias("lang"), "text")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text, lang (rows that may be learnt from)."""
    common.ship_package(docs.sparkSession)
    docs = docs.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    texts = common.materialise(sampled(docs, sample), "labelled")
    n, df = 0, np.zeros(FEATURES, np.int64)
    for r in texts.select("text").mapInArrow(_document_counts, "n long, df binary").collect():
        n, df = n + r.n, df + np.frombuffer(r.df, np.int64)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    found = texts.groupBy("lang").applyInArrow(_centroids(idf), _FITTED).collect()
    common.discard(texts)
    rows = sorted((r.lang, bytes(r.centroid)) for r in found if r.centroid is not None)
    limits = {(r.lang, int(r.bucket)): float(r.least) for r in found if r.centroid is None}
    matrix = np.array([np.frombuffer(c, np.float32) for _, c in rows], np.float32).reshape(-1, FEATURES)
    return Model([lang for lang, _ in rows], matrix, idf, limits)


def _predict(model):
    def predict(batches):
        m = model.value
        common.claim("langid", _letters.cache_clear)
        for batch in batches:
            langs, scores, out = [], [], []
            for at in range(0, batch.num_rows, 128):
                rows = [counts(t) for t in batch.column(0).slice(at, 128).to_pylist()]
                there = [i for i, r in enumerate(rows) if r is not None]
                lang, score, reject = [UNKNOWN] * len(rows), [0.0] * len(rows), [True] * len(rows)
                if there and m.langs:
                    near = _vectors([rows[i] for i in there], m.idf) @ m.matrix.T
                    best = near.argmax(1)
                    for i, b, s in zip(there, best.tolist(), near.max(1).tolist(), strict=True):
                        lang[i], score[i] = m.langs[b], min(1.0, max(0.0, s))
                        reject[i] = s < REJECT * m.limit(m.langs[b], int(rows[i].sum()))
                langs += lang
                scores += score
                out += reject
            names = batch.schema.names[1:]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return predict


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of keep, and lang_pred, score and rejected, read from text alone."""
    common.ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score", "rejected")]  # columns of those names are replaced
    narrow = docs.select(F.col("text").cast("string").alias("_whole_text"), *keep)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[1:])
    return narrow.mapInArrow(_predict(sent), f"{kept}lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects; all columns as they were."""
    inner = docs.select(F.col("text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(docs.columns)])
    kept = predict(inner, model, [f"_k{i}" for i in range(len(docs.columns))]).where("not rejected")
    return kept.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])
