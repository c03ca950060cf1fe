"""Personal data: base patterns, and contextual extraction bootstrapped from them.

The base kinds (email, ip, card, phone) are matched in every text.  Their spans,
and long random-looking secrets, are *seeds*.  Every identifier-like string is an
*instance*; the three lexical tokens before it, with and without the one after it,
are its *patterns*.  Over the bipartite graph of distinct patterns and instances
Spark scores in turn

    pattern:  sum of its instances' scores / (their number + 1), 0 if it has under SUPPORT of them
    instance: 1 for seeds, else 1 - product of (1 - score) over its patterns of at least CONFIDENCE

for ROUNDS rounds.  Occurrences in a pattern that ends at CONFIDENCE or more
are spans of the kind most of that pattern's seeds have, be they seeds or not.  Base spans always stay.

Edge cases: null and empty texts have no spans; rows that repeat get the same
spans; an instance that overlaps a base span is left to it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# The base patterns and the order of kinds.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret")

SUPPORT = 5
CONFIDENCE = 0.8
ROUNDS = 3
SECRET = 24
_ANY = re.compile(r"[0-9@]")
_INSTANCE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+@/-]*[A-Za-z0-9])?")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_DIGIT = re.compile(r"[0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost, non-overlapping matches, in time linear in the text: each @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and EMAIL_LOCAL.match(text[begin - 1]):
            begin -= 1
        if begin < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    if not text or not _ANY.search(text):
        return []
    found = [(0, b, e) for b, e in emails(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _is_secret(s: str) -> bool:
    return len(s) >= SECRET and s.isalnum() and len(set(s)) >= 8 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def _context(text: str, begin: int, end: int) -> list[str]:
    """The patterns around a span."""
    before = text[max(0, begin - 256) : begin]
    left = [_DIGIT.sub("0", t.lower()) for t in _TOKEN.findall(before)[-3:]]
    after = _TOKEN.search(text[end : end + 256])
    right = _DIGIT.sub("0", after[0].lower()) if after else ""
    if len(left) < 3:
        left = ["^", *left]
    key = "\x1f".join(left)
    return [key, f"{key}\x1e{right}"]


def occurrences(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, seed's kind or None, is base, instance, patterns) of every identifier-like string and base span."""
    if not text or not _ANY.search(text):
        return []
    found = [(b, e, k, True) for k, b, e in base]
    taken = sorted((b, e) for _, b, e in base)
    i, reach = 0, -1  # base spans of different kinds may overlap
    for m in _INSTANCE.finditer(text):
        b, e = m.start(), m.end()
        if e - b < 6 or not any(c.isdigit() for c in m[0]):
            continue
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        if reach > b:
            continue
        found.append((b, e, 4 if _is_secret(m[0]) else None, False))
    return [(b, e, k, base_, xxhash.xxh3_64_intdigest(text[b:e].lower().encode()) - (1 << 63), [xxhash.xxh3_64_intdigest(p.encode()) - (1 << 63) for p in _context(text, b, e)]) for b, e, k, base_ in found]


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("base", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
_MARKED = (
    "doc_id long, text_hash long, base array<struct<kind int, start int, stop int>>, base_sha256 string, "
    "found array<struct<start int, stop int, kind int, base boolean, instance long, patterns array<long>>>"
)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for k, b, e in spans)


def _mark(batches):
    common.claim("pii", lambda: None)
    for batch in batches:
        base, sha, found = [], [], []
        for text in batch.column(2).to_pylist():
            spans = base_spans(text)
            base.append([{"kind": k, "start": b, "stop": e} for k, b, e in spans])
            sha.append(hashlib.sha256(joined(spans).encode()).hexdigest())
            found.append([dict(zip(("start", "stop", "kind", "base", "instance", "patterns"), o, strict=True)) for o in occurrences(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, _SPANS), pa.array(sha), pa.array(found, _FOUND)], ["doc_id", "text_hash", "base", "base_sha256", "found"])


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """edges: pattern, instance, kind (null: no seed), distinct.  Returns the accepted patterns: pattern, kind, score."""
    instances = edges.groupBy("instance").agg(F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).alias("seed"))
    scored = instances.select("instance", F.col("seed").alias("s"))
    for i in range(rounds):
        patterns = edges.join(scored, "instance").groupBy("pattern").agg((F.sum("s") / (F.count("*") + 1)).alias("score"), F.count("*").alias("n"))
        good = patterns.where((F.col("n") >= support) & (F.col("score") >= confidence)).select("pattern", "score")
        good = common.materialise(good, f"patterns-{i}")
        if i + 1 < rounds:
            reached = edges.join(good, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12)))))).alias("r"))
            scored = common.materialise(instances.join(reached, "instance", "left").select("instance", F.greatest("seed", F.coalesce("r", F.lit(0.0))).alias("s")), f"instances-{i}")
    votes = edges.where("kind is not null").join(good, "pattern").groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.first("score").alias("score"))
    return votes.groupBy("pattern").agg(F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"), F.first("score").alias("score"))


def extract(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text.  A row for each: doc_id, text_hash, base and spans (arrays of kind, start, stop; end exclusive, in code points), base_sha256."""
    common.ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    marked = common.materialise(rows.mapInArrow(_mark, _MARKED), "marked")
    each = marked.where(F.size("found") > 0).select("doc_id", "text_hash", F.explode("found").alias("o")).select("doc_id", "text_hash", "o.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    accepted = score_patterns(common.materialise(edges, "edges"))
    new = each.where("not base").select("doc_id", "text_hash", "start", "stop", F.explode("patterns").alias("pattern"))
    hits = new.join(accepted.select("pattern", "kind", "score"), "pattern")
    spans = hits.groupBy("doc_id", "text_hash", "start", "stop").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    more = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("more"))
    some = marked.where(F.size("found") > 0).alias("m").join(more.alias("x"), F.col("m.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("m.text_hash") == F.col("x.text_hash")), "left")
    full = some.select("m.doc_id", "m.text_hash", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind int, start int, stop int>>")))).alias("spans"), "base_sha256")
    return full.unionByName(marked.where(F.size("found") == 0).select("doc_id", "text_hash", "base", F.col("base").alias("spans"), "base_sha256"))


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def text_of(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _masked(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for b, e, k in sorted((s["start"], s["stop"], s["kind"]) for s in spans):
        if e <= at:
            continue
        if b >= at:
            parts += [text[at:b], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


def _mask(place: int):
    """Rows whose last column is the spans of the text at a place."""

    def mask(batches):
        for batch in batches:
            texts, spans = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out = [_masked(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            batch = batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))
            yield batch.drop_columns(["spans"])

    return mask


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; rows without spans pass as they are."""
    found = extract(docs).where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    found = found.toDF("found_id", "found_hash", "found_spans")
    met = docs["doc_id"].eqNullSafe(found["found_id"]) & (F.xxhash64(docs["text"]) == found["found_hash"])
    columns = [docs[c].alias(f"k{i}") for i, c in enumerate(docs.columns)]
    place = [c.lower() for c in docs.columns].index("text")
    kept = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    masked = docs.join(found, met, "left").select(*columns, found["found_spans"].alias("spans")).mapInArrow(_mask(place), kept)
    return masked.toDF(*docs.columns)
