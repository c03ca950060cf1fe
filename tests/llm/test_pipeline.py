import numpy as np
import re

import pyarrow.parquet as pq

import corpus_pipeline
from tessera.llm import common

from .test_decontamination import brute as leaks
from .test_jaccard import brute as components
from .test_pii import base

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == len(after)
        texts = [(d, r.text) for d, r in before.items()]
        if name == "language_id":
            assert len(after) >= 0.998 * len(before) and all(any(c.isalpha() for c in r.text) for r in after.values())
        elif name == "ngram_jaccard_join":
            assert set(after) == {c for _, n, c in components(texts, 5, 80)}
        elif name == "benchmark_decontamination":
            items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
            assert set(before) - set(after) == {d for d, _ in leaks(texts, [(i["item_id"], i["text"]) for i in items])}
        else:
            assert set(after) == set(before)
            for d, r in after.items():
                assert not base(r.text) and not re.search(r'token = "[0-9a-f]{40}"', r.text)
                assert (r.text == before[d].text) == (not base(before[d].text) and 'token = "' not in before[d].text)
        if name != "pii":
            assert all(r == before[d] for d, r in after.items())
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.text for r in last} == {d: r.text for d, r in before.items()} and all(r.lossless for r in last)


def test_edges(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, kept_id int, rejected boolean, spans int"
    long = "the and of this that with from " * 50
    rows = [(1, long, "en"), (1, long, "en"), (2, long, "en"), (None, long, None), (3, None, "en"), (4, "", "en"), (5, "12 34", "en"), (6, long + "me@example.com", "en"), (6, "le la les des une et", "fr"), (None, "le la un", "fr"), (7, "é " * 60_000, "fr")]
    df = spark.createDataFrame([(*r, "s", 1, "h", 1, True, 2) for r in rows], shape)
    for empty in (False, True):
        docs = df.where("false") if empty else df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialise(stage(spark, docs, SF), name)
            assert docs.columns == df.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        if empty:
            assert not out
        else:
            assert sorted((str(r.doc_id), r.text[:8]) for r in out) == [("1", "the and "), ("6", "le la le"), ("7", "é é é é "), ("None", "le la un")] and all(r.lossless for r in out)


def test_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()


def test_stages_pass_columns_of_any_name(spark):
    from tessera.llm import decontamination, html_extract, jaccard, langid, license_scan, pii

    text = "Write to ann.lee@example.org about the red apples in the old basket before the evening meal is ready"
    names = ["text_hash", "_id", "_h", "pii_spans", "spans", "found_id", "found_hash", "class", "root", "n", "k0", "lang_pred", "score", "rejected", "labels", "n_words", "n_chars"]
    shape = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, *names) for i, t in [(1, text), (2, text), (2, "another text of its own words stands here"), (None, text), (3, None), (4, "")]], shape)
    bench = spark.createDataFrame([(1, "no such thing is in any of these texts at all")], "item_id long, text string")
    for df in (pii.redact(docs), decontamination.clean(docs, bench), jaccard.keep_one(docs), langid.keep_known(docs, langid.Model([], np.zeros((0, langid.FEATURES)), np.ones(langid.FEATURES), {}))):
        assert df.columns == docs.columns and all(r[2:] == tuple(names) for r in df.collect())
    assert pii.redact(docs).where("text like '%[EMAIL]%'").count() == 3 and pii.redact(docs).count() == 6
    # copies of one text are one, another text under the same id stays
    assert sorted((r.doc_id, r.text or "") for r in jaccard.keep_one(docs).collect()) == [(1, text), (2, "another text of its own words stands here"), (3, ""), (4, "")]
    for df in (license_scan.scan(docs, ["doc_id", "labels", "score"]), langid.predict(docs, langid.Model([], np.zeros((0, langid.FEATURES)), np.ones(langid.FEATURES), {}), ["doc_id", "lang_pred"])):
        assert len(set(df.columns)) == len(df.columns) and df.count() == 6
