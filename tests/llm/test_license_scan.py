import re

import pyarrow.parquet as pq

from tessera.llm import license_scan, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def base(text):
    w = WORD.findall(lower(text))
    hits = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return w, hits


def labelled(w):
    """Brute force without an index: every template at every place."""
    out, score, drift = set(), 0.0, license_scan.DRIFT
    for label, text, key in license_scan.TEMPLATES:
        t, k = license_scan.template_words(text), key.split()
        at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        bag = set(t)
        for i in range(len(w) - len(k) + 1):
            if w[i : i + len(k)] != k:
                continue
            for s in range(i - at - drift, i - at + drift + 1):
                share = len(bag & set(w[max(0, s - drift) : max(0, s + len(t) + drift)])) / len(bag)
                if share >= license_scan.COVER:
                    out.add(label)
                    score = max(score, share)
    return out, score


def check(got, texts):
    assert len(got) == len(texts)
    for r, text in zip(got, texts, strict=True):
        w, hits = base(text)
        starts = [i for i, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(starts, default=None), max(starts, default=None)), text
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        more, score = labelled(w)
        assert r.labels == ",".join(sorted({x for _, x in hits} | more)), text
        assert r.score <= score and (r.score > 0) == (score > 0)


def test_query(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id").to_pylist()
    got = sorted(queries.op7_license(spark, "/root/testdata/sf0.01").collect())
    check(got, [r["text"] for r in t])
    assert sum(r.n_base > 0 for r in got) > 10 and any("cc-by-nc-4.0" in r.labels for r in got)


def test_edges(spark):
    texts = [
        None, "", "!!", "MIT License", "mit\nLICENSE mit-license", "the MIT  License; Apache License", "general public license " * 500, "a mit license", "permit license", "licence mit licensee",
        "Licensed under the Apache License, Version 2.0. " * 3, "This work is licensed under the GNU General Public License, version 3.", "gnu lesser general public license", "éMIT License", "İ mit license K",
        "Licensed under CC BY-NC 4.0.", "x " * 30_000 + "mit license", "version 2 0 apache license", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ]
    df = spark.createDataFrame([(i, t, "w", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, w string, score double")
    check(sorted(license_scan.scan(df, ["doc_id"]).collect()), texts)
    assert license_scan.scan(df.where("false"), ["doc_id"]).count() == 0
    twice = license_scan.scan(df.union(df), ["doc_id"]).collect()
    assert len(twice) == 2 * len(texts)


def test_many_licences_in_one_text(spark):
    headers = [words for _, words, _ in license_scan.TEMPLATES]
    plain = [x for x in license_scan.TEMPLATES if len(x[1]) > 100]
    pairs = [f"{a[1]}\n\n{'other words stand here ' * 5}{b[1]}" for a in plain for b in plain]
    some = [w for label, w, _ in license_scan.TEMPLATES if label in ("apache-2.0", "mit", "bsd", "epl", "cc-by-sa-4.0")]
    texts = [". ".join(headers), "; ".join(reversed(headers)), "\n".join(some), "\n".join(["word " * 50 + h for h in headers]), " ".join(some * 3), *pairs]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(license_scan.scan(df, ["doc_id"]).collect())
    check(got, texts)
    assert set(got[0].labels.split(",")) == {label for label, _, _ in license_scan.TEMPLATES}
    for r, (a, b) in zip(got[5:], [(a, b) for a in plain for b in plain], strict=True):
        assert {a[0], b[0]} <= set(r.labels.split(","))


def test_edited_licence_texts(spark):
    mit = license_scan._MIT + " " + license_scan._WARRANTY
    words = mit.split()
    texts = [
        "Copyright (c) 2020 Someone\n" + mit,
        " ".join(words[:30] + ["really", "new", "words"] + words[30:90] + words[93:]),
        " ".join(words[:3] + words[9:]),  # the mandatory phrase is gone
        "granted permission charge hereby free merchantability noninfringement sublicense " * 50,
        license_scan._BSD.replace("copyright notice", "copyright\n * notice"),
    ]
    got = sorted(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect())
    check(got, texts)
    assert [r.labels for r in got] == ["mit", "mit", "", "", "bsd,bsd-2-clause"]
