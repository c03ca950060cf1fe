"""Benchmark decontamination by template windows, in DataFrame functions only.

A text's tokens are its words in lower case, with numbers, capitalised names within a
sentence and units after numbers replaced by typed placeholders.  In a second reading capitalised words anywhere else (at the
start of a sentence or line, after a quote or digit) are names too.  Windows of WINDOW tokens of all texts
are hash-joined with those of the benchmark: each window of an item is looked up by one pair of neighbouring tokens (gram) in it,
the one with the most letters, at every place where that stands in a text, and counts if the hash of all its tokens there is
the same.  A text holds an item if, along one
alignment, the matching windows cover at least SHARE of the item's tokens and the slots are
consistent: each value of the item stands for one value in the text and each of those
for one of the item.  So a question asked anew with other numbers or names is found, while
mere likeness of form isn't.  An alignment may shift where words were put in or left out: around each offset,
all windows that are as far from it as nothing, a window or the item's length are joined.

Items of up to WINDOW tokens are one window of their own length; those under twice as long have windows of
under half their length, so that one replaced word leaves some. Windows in which under half of the tokens are words, and
items under SHORTEST tokens, are matched by their tokens with the values, so that exact copies are found and
mere likeness of form isn't.  An item without letters and digits has no tokens and can't be found.

Edge cases: a null or empty text holds nothing; rows that repeat count once; equal items are found each; an empty
benchmark or table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
SHORTEST = 4
SHARE = 0.5
BROADCAST_ROWS = 500_000
_NUMBER, _NAME, _UNIT, _MAYBE = "\ue000", "\ue001", "\ue002", "\ue003"
#: Kinds of windows: matched by template, by their tokens as they stand, or by the template of the second reading.  An item is looked for by all its windows and by some.
PLAIN, LITERAL, RENAMED = 0, 1, 2
_VIEWS = ((PLAIN, LITERAL), (PLAIN,), (PLAIN, RENAMED))
# Units that may follow a number.
UNITS = "km kg cm mm m g mg lb lbs oz ft in mi mph kmh l ml s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mile miles meter meters metre metres dollar dollars euro euros percent degrees"


def tokens(text: Column) -> Column:
    """Words in lower case; a placeholder's token begins with its sign, its value follows."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}&&[^ ]][\s\p{Z}]*| [\s\p{Z}]+", " ")
    # a character that few texts have begins each pattern, what stands before it is looked at after that
    t = F.regexp_replace(t, r"[0-9](?<![\p{L}\p{N}_][0-9])[0-9]*(?:[.,][0-9]+)*", f" {_NUMBER}$0 ")
    t = F.regexp_replace(t, r"[.,](?<=[0-9][.,])(?=[0-9])", "_")
    t = F.regexp_replace(t, rf"({_NUMBER}[0-9_]+)\s+({'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])", f"$1 {_UNIT}$2")
    t = F.regexp_replace(t, rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}_{_NUMBER}-{_UNIT}]\p{{Lu}})\p{{Ll}}+", f"{_MAYBE}$0")
    t = F.regexp_replace(t, rf"{_MAYBE}(?<=[\p{{Ll}},;:] {_MAYBE})", _NAME)
    return F.filter(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}_{_NUMBER}-{_MAYBE}]+"), lambda x: x != "")


def _sign(token: Column) -> Column:
    return F.substring(token, 1, 1)


def _is_slot(token: Column) -> Column:
    return _sign(token).isin(_NUMBER, _NAME, _UNIT)


def _value(token: Column) -> Column:
    """The token without its sign.  Signs sort after nearly all letters, so that most tokens need one look."""
    return F.when(token < _NUMBER, token).when(_sign(token).isin(_NUMBER, _NAME, _UNIT, _MAYBE), F.substring(token, 2, 1 << 30)).otherwise(token)


def _form(token: Column, names: bool = False) -> Column:
    """What stands for the token in a template of the first reading, or with names in the second."""
    maybe = F.lit(_NAME) if names else F.substring(token, 2, 1 << 30)
    return F.when(token < _NUMBER, token).when(_is_slot(token), _sign(token)).when(_sign(token) == _MAYBE, maybe).otherwise(token)


def _is_literal(template: Column, length) -> Column:
    """Whether under half of a window's tokens are words."""
    return F.size(F.filter(template, lambda x: x.isin(_NUMBER, _NAME, _UNIT))) * 2 > length


#: How grams are read: in the first reading, as they stand, in the second reading, or as one token for windows of one.
FIRST, VALUES, SECOND, SINGLE = 0, 1, 2, 3


def _gram(a: Column, b: Column | None, reading: int) -> Column:
    if reading == SINGLE:
        return F.xxhash64(_value(a), F.lit(SINGLE))
    read = {FIRST: _form, VALUES: _value, SECOND: lambda x: _form(x, True)}[reading]
    return F.xxhash64(read(a), read(b), F.lit(reading))


def _hash(toks: str, kind: Column) -> Column:
    """Of a window's tokens, by which a text's and an item's are the same."""
    plain = lambda names: F.xxhash64(F.transform(toks, lambda x: _form(x, names)))
    return F.when(kind == LITERAL, F.xxhash64(F.transform(toks, _value), F.lit(LITERAL))).when(kind == RENAMED, plain(True)).otherwise(plain(False))


def _length(n: Column) -> Column:
    """Of the windows of an item of n tokens."""
    return F.when(n <= WINDOW, n).otherwise(F.least(F.lit(WINDOW), F.expr("(n - 1) div 2").cast("int")))


def _covered(which: Column | None = None) -> Column:
    """How many of the item's tokens the windows of a group cover."""
    span = F.struct("place", "length")
    spans = F.collect_set(span if which is None else F.when(which, span))
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["place"], s["place"] + s["length"] - 1)))))


def _items(benchmark: DataFrame) -> DataFrame:
    """A row for each window of each item: gram (hash), from (place of the gram in the window), reading, window (hash), kind, length, item_id, place, windows, slots (the window's tokens)."""
    base = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    own = base.select("item_id", "text", tokens(F.col("text")).alias("toks"), F.lit(False).alias("within"))
    # within a sentence of another text, an item's first word would be read as a name
    other = base.select("item_id", "text", F.slice(tokens(F.concat(F.lit("x "), F.regexp_replace("text", r"^[\s\p{Z}]+", ""))), 2, 1 << 30).alias("toks"), F.lit(True).alias("within"))
    # read again from a table, so that Spark doesn't put the reading of tokens into what follows, once for each use
    both = common.materialise(own.unionByName(other), "items").where(F.size("toks") > 0)
    both = both.withColumn("n", F.size("toks")).withColumn("length", _length(F.col("n")))
    both = both.withColumn("names", F.explode(F.when(F.col("within"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    at = F.sequence(F.lit(1), F.size("toks") - F.col("length") + 1)
    each = both.select("item_id", "text", "n", "length", "toks", "within", "names", F.explode(at).alias("place")).where("not within or place = 1")
    cut = each.select("item_id", F.xxhash64("text").alias("version"), "names", "n", "length", "place", F.slice("toks", F.col("place"), F.col("length")).alias("signed"))
    form = F.transform("signed", lambda x: F.when(F.col("names"), _form(x, True)).otherwise(_form(x)))
    cut = cut.withColumn("kind", F.when((F.col("n") < SHORTEST) | _is_literal(form, F.col("length")), LITERAL).when(F.col("names"), RENAMED).otherwise(PLAIN))
    cut = cut.where(~F.col("names") | (F.col("kind") == RENAMED))  # literal ones are there already
    maybe_name = lambda x: F.concat(F.lit(_NAME), F.substring(x, 2, 1 << 30))
    slots = F.transform("signed", lambda x: F.when(_sign(x) != _MAYBE, x).when(F.col("names"), maybe_name(x)).otherwise(F.substring(x, 2, 1 << 30)))
    windows = cut.select("signed", "kind", "n", "length", "item_id", "version", "place", slots.alias("slots"), _hash("signed", F.col("kind")).alias("window"))
    windows = windows.dropDuplicates(["item_id", "version", "place", "window", "kind"])
    # the gram of a window: without names in the second reading if it has such a one, then with the most letters of words
    literal, named = F.col("kind") == LITERAL, F.col("kind") == RENAMED
    letters = lambda x: F.when(literal, F.length(_value(x))).when(_is_slot(x) | (named & (_sign(x) == _MAYBE)), 0).otherwise(F.length(x))
    has_name = lambda x: named & _sign(x).isin(_NAME, _MAYBE)

    def gram(i):
        a, b = F.get("signed", i), F.get("signed", i + 1)
        second = has_name(a) | has_name(b)
        reading = F.when(literal, VALUES).when(second, SECOND).otherwise(FIRST)
        found = F.when(literal, _gram(a, b, VALUES)).when(second, _gram(a, b, SECOND)).otherwise(_gram(a, b, FIRST))
        return F.struct((~second).alias("first"), (letters(a) + letters(b)).alias("letters"), (-i).alias("i"), reading.alias("reading"), found.alias("gram"))

    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.col("length") - 2, F.lit(0))), gram)
    single = F.col("length") == 1
    best = F.array_max(pairs)
    windows = windows.withColumn("best", best).select(
        "*",
        F.when(single, _gram(F.get("signed", F.lit(0)), None, SINGLE)).otherwise(F.col("best.gram")).alias("gram"),
        F.when(single, 0).otherwise(-F.col("best.i")).alias("from"),
        F.when(single, SINGLE).otherwise(F.col("best.reading")).alias("reading"),
    )
    windows = common.materialise(windows.drop("best", "signed"), "windows")
    totals = F.array(*[_covered(F.col("kind").isin(*kinds)) for kinds in _VIEWS])
    whole = windows.groupBy("item_id", "version").agg(F.countDistinct("place").alias("windows"), totals.alias("totals"))
    # so many tokens one replaced word leaves at least
    return windows.join(whole, ["item_id", "version"]).withColumn("least", F.least(F.lit(WINDOW), F.col("n") - F.col("length"))).drop("n")


def find(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text.  A row for each text and item it holds:
    doc_id, text_hash, item_id, matched and windows (of the item), share (of its tokens), slots (placeholders compared), changed (those with another value)."""
    items = common.materialise(_items(benchmark), "looked-up")
    readings = sorted(r[0] for r in items.select("reading").distinct().collect()) or [FIRST]  # four at most
    rows = items.count()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), tokens(F.col("text").cast("string")).alias("signed"))
    after = F.slice("signed", 2, 1 << 30)  # the last token's gram is with nothing; no item has that
    read = lambda r: F.zip_with("signed", after, lambda a, b: _gram(a, b, r))
    grams = F.concat(*map(read, readings))
    # outer: else Spark would filter by the grams, written out, before it makes them
    each = docs.select("doc_id", "text_hash", "signed", grams.alias("grams")).select("doc_id", "text_hash", "signed", F.posexplode_outer("grams").alias("at", "gram"))
    each = each.withColumn("at", F.col("at") % F.size("signed"))
    if rows <= BROADCAST_ROWS:
        met = each.join(F.broadcast(items), "gram")
    else:
        # what moves is a token's neighbours, not the text; grams alone are small enough to drop most rows before
        known = items.select("gram").distinct()
        if rows <= 20 * BROADCAST_ROWS:
            each = each.join(F.broadcast(known), "gram", "left_semi")
        begin = F.greatest(F.col("at") - WINDOW, F.lit(0))
        narrow = each.select("doc_id", "text_hash", "gram", F.slice("signed", begin + 1, 2 * WINDOW + 1).alias("signed"), (F.col("at") - begin).alias("at"), begin.alias("begin"))
        met = narrow.join(items.hint("merge"), "gram")
    start = F.col("at") - F.col("from")
    # no lambdas in this step: what holds one would leave the generated code, and each row out of that would hold a whole text
    offset = start - F.col("place") + (F.lit(0) if rows <= BROADCAST_ROWS else F.col("begin"))
    some = ["doc_id", "text_hash", "item_id", "version", "place", "kind", "length", "windows", "totals", "least", "window", "slots"]
    met = met.where((start >= 0) & (start + F.col("length") <= F.size("signed"))).select(*some, offset.alias("offset"), F.slice("signed", start + 1, F.col("length")).alias("theirs"))
    hits = common.materialise(met, "candidates").where(_hash("theirs", F.col("kind")) == F.col("window")).drop("window")
    # each window of a text is hit once for each place of an item; what is collected is bounded by the item
    hits = common.materialise(hits.dropDuplicates(["doc_id", "text_hash", "item_id", "version", "place", "kind", "offset"]), "hits")
    pairs = F.filter(F.zip_with("slots", "theirs", lambda a, b: F.struct(a.alias("a"), F.concat(_sign(a), _value(b)).alias("b"))), lambda p: _is_slot(p["a"]))
    hits = hits.select("*", pairs.alias("pairs")).drop("slots", "theirs")
    key = ["doc_id", "text_hash", "item_id", "version"]
    far = F.greatest("windows", F.lit(WINDOW))
    bucket = F.floor(F.col("offset") / far)
    anchors = hits.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("offset").alias("anchor"), bucket.alias("_bucket")).distinct()
    near = hits.withColumn("far", far).withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for c in (*key[1:], "bucket"):
        same &= F.col(c) == F.col(f"_{c}")
    from_here = F.abs(F.col("offset") - F.col("anchor"))
    met = near.join(anchors.hint("merge"), same).where(from_here <= F.col("far"))
    views = F.array(*[F.when(F.col("kind").isin(*ks), F.struct(F.lit(v).alias("view"), F.get("totals", F.lit(v)).alias("total"))) for v, ks in enumerate(_VIEWS)])
    met = met.withColumn("v", F.explode(F.array_compact(views))).select("*", "v.view", "v.total").withColumn("least", F.least("least", "total"))
    # of a place's windows, the nearest to the anchor
    met = met.groupBy(*key, "view", "anchor", "place", "length", "windows", "total", "least", "far").agg(F.min_by(F.struct("pairs", from_here.alias("away")), F.struct(from_here, "offset", -F.col("kind"))).alias("x"))
    radius = F.explode(F.array(F.lit(0), F.lit(WINDOW), F.col("far").cast("int"))).alias("radius")
    met = met.select("*", radius).where(F.col("x.away") <= F.col("radius"))
    aligned = met.groupBy(*key, "view", "anchor", "radius", "windows", "total", "least").agg(F.countDistinct("place").alias("matched"), _covered().alias("covered"), F.array_distinct(F.flatten(F.collect_set("x.pairs"))).alias("pairs"))
    one_way = lambda k: F.size(F.array_distinct(F.transform("pairs", lambda p: p[k]))) == F.size("pairs")
    kept = aligned.where((F.col("covered") / F.col("total") >= share) & (F.col("covered") >= F.col("least")) & one_way("a") & one_way("b"))
    kept = kept.withColumn("slots", F.size("pairs")).withColumn("changed", F.size(F.filter("pairs", lambda p: p["a"] != p["b"])))
    best = kept.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("covered", "matched", (-F.col("changed")).alias("same"), "windows", "total", "slots", "changed")).alias("x"))
    return best.select("doc_id", "text_hash", "item_id", F.col("x.matched").cast("long").alias("matched"), F.col("x.windows").cast("long").alias("windows"), (F.col("x.covered") / F.col("x.total")).alias("share"), F.col("x.slots").cast("long").alias("slots"), F.col("x.changed").cast("long").alias("changed"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds an item."""
    found = find(docs, benchmark).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]) & (F.xxhash64(docs["text"]) == found["found_hash"]), "left_anti")
