import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import jaccard, queries
from tessera.llm.components import components


def sets_of(text, k):
    if not text:
        return frozenset()
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent):
    s = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, x in enumerate(s):
        for g in x:
            where.setdefault(g, []).append(i)
    for i, x in enumerate(s):
        for j in {j for g in x for j in where[g] if j < i}:
            inter = len(x & s[j])
            if 100 * inter >= percent * (len(x) + len(s[j]) - inter):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def check(spark, rows, k, percent):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, class string")
    got = jaccard.classify(df, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, percent)


def family(r, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, k, percent, monkeypatch):
    r = random.Random(k)
    texts = []
    for size in (9, 10, 11, 20, 60, 200, 400):
        texts += family(r, [f"w{r.randrange(500)}" for _ in range(size)], 12, max(1, size // 30))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(r.randint(0, 30))) for _ in range(60)]
    texts += ["", None, " \n", "one", "One", "one two", "two one", "one\ttwo", "É é", "é É", "x" * 50_000, "a " * 30_000, "a b " * 100, "a\x1cb c d", "a b c d"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (5, texts[80]), (None, texts[3]), (None, "lone null id here"), (None, None)]
    r.shuffle(rows)
    check(spark, rows, k, percent)
    monkeypatch.setattr(jaccard, "TREE_TOKENS", 3000)  # so that trees are split and paired
    check(spark, rows, k, percent)


def test_tree_prunes_nothing_that_links():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    rows = []
    for i in range(120):
        s = np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64)]))
        rows.append((i, s))
    rows += [(1000 + i, np.unique(rng.integers(0, 1 << 63, 250, dtype=np.uint64))) for i in range(100)]
    group = {c: c for c, _ in rows}
    for a, b in jaccard.links_of(rows, None, 90):
        group[b] = a
    arr = [(c, set(b.tolist())) for c, b in rows]
    for i, (c, x) in enumerate(arr):
        for d, y in arr[:i]:
            if 100 * len(x & y) >= 90 * len(x | y):
                assert group[c] == group[d]


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(r.randrange(5000, 5400), r.randrange(5000, 5400)) for _ in range(300)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root}


def test_empty_table(spark):
    assert jaccard.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    got = sorted(map(tuple, queries.op9_jaccard(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_bands_find_what_is_at_the_threshold():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        count, rows = jaccard.bands(percent)
        assert (1 - (percent / 100) ** rows) ** count <= jaccard.MISS
        found = []
        for _ in range(60):
            union = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))
            each = len(union) * (100 - percent) // 200
            with np.errstate(over="ignore"):
                x, y = (jaccard.band_keys(np.sort(s), count, rows) for s in (union[each:], union[: len(union) - each]))
            found.append(int((x == y).sum()))
        mean = count * (percent / 100) ** rows
        assert min(found) > 0 and 0.7 * mean < np.mean(found) < 1.4 * mean
