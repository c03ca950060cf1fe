"""Licence scan with a positional index of rare words, in DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters, lower-cased.  For each text:

1. each template is looked up by its RARE words of highest IDF (over all texts), at every place where one stands;
2. each posting (template, place in it) says where that template would begin.  Begins of different rare words that lie within
   DRIFT words of each other intersect: these are the candidates, so words put in or left out do no harm;
3. a candidate counts if the template's mandatory phrase stands within DRIFT words of its place, and at least COVER of the
   template's distinct words stand between its begin and its end.

Templates are whole licence texts, the notices that licences ask for, and one-line notices; of those with under 2 rare words one is enough.
Base phrases are found wherever their words stand consecutively; their labels always stay.

Edge cases: a null or empty text has no words, no labels and score 0; rows that repeat get the
same result; a text with several licences has the labels of all; an empty table gives an empty result; other columns are kept if asked for.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVER = 0.7
RARE = 4
DRIFT = 8
OUTPUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_PYTHON_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Texts of licences and of the notices that they ask for.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

# Label, template, mandatory phrase within it.
TEMPLATES = (
    ("mit", "mit license", "mit license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", _MIT + " " + _WARRANTY, "permission is hereby granted free of charge"),
    ("apache", "apache license", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", _APACHE, "apache license version 2 0"),
    ("gpl", "general public license", "general public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-2.0", _GPL.format(2), "either version 2 of the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-3.0", _GPL.format(3), "either version 3 of the license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd-2-clause", _BSD, "redistributions in binary form must reproduce"),
    ("bsd-3-clause", _BSD + " " + _BSD_THIRD, "may be used to endorse or promote products"),
    ("isc", _ISC, "for any purpose with or without fee is hereby granted"),
    ("zlib", _ZLIB, "the origin of this software must not be misrepresented"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2.0", _MPL, "mozilla public license v 2 0"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", _UNLICENSE, "free and unencumbered software"),
)
# Base phrases and labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def template_words(text: str) -> list[str]:
    return _PYTHON_WORD.findall(text.lower())


_VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in template_words(text)})


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def _place(words: list[str], key: str) -> int:
    """The place in the template at which its phrase begins."""
    return len(f" {' '.join(words)} "[: f" {' '.join(words)} ".index(f" {key} ")].split())


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"{_NOT_WORD}+"), lambda w: w != "")


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """IDF of each template word over all texts; as many numbers as the templates have words."""
    there = docs.select(F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), f"{_NOT_WORD}+"), _strings(_VOCABULARY)).alias("w"))
    # a row for each word of the templates and one for the texts
    rows = there.select(F.explode_outer(F.array_append("w", F.lit(""))).alias("w")).groupBy("w").count().collect()
    seen = {r["w"]: r["count"] for r in rows}
    total = seen.get("", 0)
    return {w: math.log((1 + total) / (1 + seen.get(w, 0))) for w in _VOCABULARY}


def rare_places(words: list[str], idf: dict[str, float]) -> list[tuple[str, int]]:
    """A template's RARE words of highest IDF and their places; of a word that stands twice, all places."""
    chosen = sorted(set(words), key=lambda w: (-idf[w], words.index(w)))[:RARE]
    return [(w, i) for i, w in enumerate(words) if w in chosen]


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs: text and the columns of keep.  Adds n_words, n_base, first_word, last_word, base_labels, labels, score."""
    keep = [c for c in keep if c.lower() not in OUTPUT]  # columns of those names are replaced
    idf = inverse_frequencies(docs)
    postings: dict[str, list[tuple[int, int]]] = {}
    rows = []
    for t, (label, text, key) in enumerate(TEMPLATES):
        words = template_words(text)
        for w, p in rare_places(words, idf):
            postings.setdefault(w, []).append((t, p))
        rows.append((label, list(dict.fromkeys(words)), len(words), key.split(), _place(words, key), min(2, len(set(words)))))
    index = F.create_map(*[x for w, ps in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))])
    templates = F.array(
        *[F.struct(F.lit(label).alias("label"), _strings(bag).alias("bag"), F.lit(n).alias("n"), _strings(key).alias("key"), F.lit(at).alias("at"), F.lit(need).alias("need")) for label, bag, n, key, at, need in rows]
    )
    text = F.coalesce(F.col("_text"), F.lit(""))
    none = F.array().cast("array<string>")
    df = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_text"))
    df = df.withColumn("all", _words(text)).drop("_text")
    # most texts have no word of the index, and no base phrase without one of its last words: they need no places
    signs = _strings(sorted({*postings, *(p.split()[-1] for p, _ in BASE)}))
    df = df.withColumn("w", F.when(F.arrays_overlap("all", signs), F.col("all")).otherwise(none)).withColumn("n_words", F.size("all").cast("long")).drop("all")

    at = F.filter(F.transform("w", lambda w, i: F.when(w.isin(*sorted({*postings, "license"})), F.struct(w.alias("w"), i.alias("i")))), lambda o: o.isNotNull())
    df = df.withColumn("at", at)
    phrase = lambda i: F.when(F.get("w", i - 1).isin("mit", "apache"), F.struct((i - 1).alias("s"), F.get("w", i - 1).alias("label"))).when((F.get("w", i - 1) == "public") & (F.get("w", i - 2) == "general"), F.struct((i - 2).alias("s"), F.lit("gpl").alias("label")))
    df = df.withColumn("base", F.filter(F.transform(F.filter("at", lambda o: o["w"] == "license"), lambda o: phrase(o["i"])), lambda s: s.isNotNull()))

    begin = lambda o, p: F.struct(p["t"].alias("t"), (o["i"] - p["p"]).alias("s"), p["p"].alias("p"))
    begins = F.flatten(F.transform("at", lambda o: F.coalesce(F.transform(F.try_element_at(index, o["w"]), lambda p: begin(o, p)), F.array().cast("array<struct<t int, s int, p int>>"))))
    df = df.withColumn("begins", F.array_sort(begins))

    def meets(c, i):
        """A begin whose neighbour in the order of template and place is that of another posting, not far away."""
        near = lambda o: F.coalesce((o["t"] == c["t"]) & (F.abs(o["s"] - c["s"]) <= DRIFT) & (o["p"] != c["p"]), F.lit(False))
        return F.when((F.get(templates, c["t"])["need"] < 2) | near(F.get("begins", i + 1)) | near(F.get("begins", i - 1)), F.struct(c["t"].alias("t"), c["s"].alias("s")))

    df = df.withColumn("met", F.array_distinct(F.filter(F.transform("begins", meets), lambda c: c.isNotNull())))

    def phrase_stands(c):
        t = F.get(templates, c["t"])
        first = c["s"] + t["at"] - DRIFT
        tries = F.sequence(F.greatest(first, F.lit(0)), F.greatest(c["s"] + t["at"] + DRIFT, F.lit(0)))
        return F.exists(tries, lambda i: F.slice("w", i + 1, F.size(t["key"])) == t["key"])

    def share(c):
        t = F.get(templates, c["t"])
        first = F.greatest(c["s"] - DRIFT, F.lit(0))
        window = F.slice("w", first + 1, F.greatest(c["s"] + t["n"] + DRIFT - first, F.lit(0)))
        return F.size(F.array_intersect(t["bag"], window)) / F.size(t["bag"])

    found = F.transform(F.filter("met", phrase_stands), lambda c: F.struct(share(c).alias("share"), F.get(templates, c["t"])["label"].alias("label")))
    df = df.withColumn("found", F.filter(found, lambda c: c["share"] >= COVER))
    starts = F.transform("base", lambda s: s["s"])
    base_labels = F.array_distinct(F.transform("base", lambda s: s["label"]))
    labels = F.array_union(base_labels, F.transform("found", lambda c: c["label"]))
    return df.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda c: c["share"])), F.lit(0.0)).alias("score"),
    )
