import pyarrow.parquet as pq
import regex

from tessera.llm import decontamination as d
from tessera.llm import queries


def tokens(text):
    """The same reading, token by token."""
    out, units = [], set(d.UNITS.split())
    for m in regex.finditer(r"(?<![\p{L}\p{N}_])[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{N}_]+", text or ""):
        w = m[0]
        if regex.match(r"[0-9]", w) and not regex.search(r"[\p{L}\p{N}_]", text[m.start() - 1 : m.start()] if m.start() else ""):
            head = regex.match(r"[0-9]+(?:[.,][0-9]+)*", w)[0]
            out.append(("N", regex.sub("[.,]", "_", head)))
            if head != w:
                out.append(("W", w[len(head) :]))
        elif out and out[-1][0] == "N" and w in units and not text[m.end() - len(w) - 1 : m.start()].strip() and text[: m.start()].rstrip()[-1:].isdigit():
            out.append(("U", w))
        elif regex.fullmatch(r"\p{Lu}\p{Ll}+.*", w) and m.start() >= 2 and text[m.start() - 1] == " " and regex.match(r"[\p{Ll},;:]", text[m.start() - 2]):
            out.append(("P", w.lower()))
        else:
            out.append(("W", w.lower()))
    return out


def brute(docs, items):
    found, by, size = set(), {}, {}
    shape = lambda w: tuple(x[1] if x[0] == "W" else x[0] for x in w)
    for item, t in items:
        versions = [tokens(t), tokens("x " + t.lstrip())[1:]]
        n = len(versions[0])
        if n < d.SHORTEST:
            continue
        k = min(n, d.WINDOW)
        eligible = set()
        for v, toks in enumerate(versions):
            for i in range(n - k + 1 if not v else 1):
                w = toks[i : i + k]
                if 2 * sum(x[0] == "W" for x in w) >= k:
                    by.setdefault(k, {}).setdefault(shape(w), []).append((item, i, w))
                    eligible.add(i)
        size[item] = len(eligible)
    for doc, text in docs:
        mine, aligned = tokens(text), {}
        for k, windows in by.items():
            for p in range(len(mine) - k + 1):
                for item, i, w in windows.get(shape(mine[p : p + k]), ()):
                    places, pairs = aligned.setdefault((item, p - i), (set(), set()))
                    places.add(i)
                    pairs |= {(a, b) for a, b in zip(w, mine[p : p + k], strict=True) if a[0] != "W"}
        for (item, _), (places, pairs) in aligned.items():
            if len(places) / size[item] >= d.SHARE and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                found.add((doc, item))
    return found


def test_query(spark):
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    items = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    verbatim = {(r["doc_id"], i["item_id"]) for r in docs for i in items if i["text"] in r["text"]}
    assert verbatim and verbatim <= got
    assert len(got) <= 1.2 * len(verbatim)


ITEM = "A train leaves Paris at 12 o clock and goes 300 km to Lyon, where Anna meets Bob after 3 hours of travel at 100 km per hour."
ITEMS = [(1, ITEM), (2, "Sum of five small words"), (3, "too short"), (4, None), (5, ITEM), (6, "ones 1 2 3 4 5 6 7 8 9 10 11 12")]
DOCS = [
    (1, "Some text. " + ITEM + " More text."),
    (2, "intro words " + ITEM.replace("300", "450").replace("12", "7").replace("Anna", "Carla").replace("Lyon", "Nice")),
    (3, "x " + ITEM.replace("100 km", "300 km")),  # two values of the item become one
    (4, "He wrote: sum of FIVE small words!"),
    (5, None),
    (6, ""),
    (7, "clean " * 40_000),
    (8, "ones 9 8 7 6 5 4 3 2 1 0 1 2 3 4"),
    (9, " ".join(ITEM.split()[:8])),
    (10, ITEM.upper()),
]


def test_reparameterised_items_and_edges(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in [*DOCS, DOCS[0], (None, DOCS[0][1])]], "doc_id long, text string, window int, slots string")
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in [*ITEMS, ITEMS[0]]], "item_id long, text string, share double")
    rows = d.find(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == brute([*DOCS, (None, DOCS[0][1])], [(i, t) for i, t in ITEMS if t])
    assert {(1, 1), (2, 1), (4, 2), (1, 5), (None, 1)} <= got and not [x for x in got if x[0] in (3, 5, 6, 7, 8, 9)]
    by = {(r.doc_id, r.item_id): r for r in rows}
    assert by[1, 1].changed == 0 and by[1, 1].share == 1.0 and by[2, 1].changed == 4, by[2, 1]
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _ in DOCS if i not in {x for x, _ in got}]
    none = bench.where("false")
    assert d.find(docs, none).count() == 0 and d.clean(docs, none).count() == docs.count() and d.find(docs.where("false"), bench).count() == 0


SHORT = "Which small river flows past the old mill before it meets the wide green lake"


def found(spark, docs, items):
    return {(r.doc_id, r.item_id) for r in d.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_inserted_dropped_and_replaced_words(spark):
    long = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    short = SHORT.split()
    docs = []
    for item, w in ((1, long), (2, short)):
        for i in range(1, len(w) - 1):
            edits = (w[:i] + ["really"] + w[i:], w[:i] + w[i + 1 :], w[:i] + ["really"] + w[i + 1 :])
            docs += [(1000 * len(docs) + item, "Before it. " + " ".join(e) + ". After it.") for e in edits]
    docs.append((1, "Half: " + " ".join(long[:30])))
    docs.append((2, " ".join(long[:20]) + " and " + " ".join(short[:6])))
    assert found(spark, docs, [(1, " ".join(long)), (2, SHORT)]) == {(i, i % 1000) for i, _ in docs} - {(2, 2)}


def test_numbers_and_short_items(spark):
    sums, more = "Compute 12 + 30 - 5 * 2 + 8", "ones 1 2 3 4 5 6 7 8 9 10 11 12"
    items = [(1, sums), (2, more), (3, "17 * 23"), (4, "Name it")]
    docs = [(1, f"Now: {sums} = ?"), (2, "So " + more + ", done"), (3, "say 17 * 23 is what"), (4, "They name it so."), (5, sums.replace("30", "31")), (6, more.replace("3 4", "4 3").replace("8 9", "9 8")), (7, "17 * 24"), (8, "name all of it")]
    assert found(spark, docs, items) == {(i, i) for i in range(1, 5)}


def test_renamed_names_wherever_they_stand(spark):
    ask = 'Tom has 5 apples. Sue has 3 apples. Tom gives Sue 2 of them. "Sue, how many are left?" asks Tom at the end of the day.'
    told = "In the morning the old baker called for Anna and Bob to carry 12 loaves of fresh bread to the market."
    other = ask.replace("Tom", "Ben").replace("Sue", "Lea")
    docs = [(1, other), (2, "Here is one.\n" + other.replace("5", "7")), (3, "It said:  " + other), (4, ask.replace(" Sue", "\n Sue").replace(" Tom", "  Tom")), (5, ask.replace("Sue", "Tom"))]
    docs += [(6, told.replace(" Anna", "\nAnna").replace(" Bob", "\u00a0Bob")), (7, told.replace(" Anna", "  Carla").replace(" Bob", "\t Dan"))]
    begins = "Tom counted every red apple in the old basket twice before the evening meal was ready"
    docs += [(8, "It is said that, Ben" + begins[3:])]
    assert found(spark, docs, [(1, ask), (2, told), (8, begins)]) == {(8, 8)} | {(1, 1), (2, 1), (3, 1), (4, 1), (6, 2), (7, 2)}
