import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.llm import langid, queries


def test_held_out_accuracy(spark):
    t = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "lang", "text"]).to_pylist()
    lang = {r["doc_id"]: r["lang"] for r in t}
    got = queries.op8_langid(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == len(t)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in out)
    assert right / len(out) >= 0.98, right / len(out)
    assert sum(r.rejected for r in got) <= 0.001 * len(got)


def test_prediction_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    for r in docs.select("doc_id", "text").collect():
        s = "".join(c.lower() if c.isalpha() else " " for c in r.text)
        s = " " + " ".join(s.split()) + " "
        c = np.zeros(langid.FEATURES)
        for a, b, d in zip(s, s[1:], s[2:]):
            h = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(d) * 0xC2B2AE3D) & 0xFFFFFFFF
            c[((h ^ h >> 15) * 0x27D4EB2F & 0xFFFFFFFF) >> 20] += 1
        v = np.log1p(c) * model.idf
        near = model.matrix @ (v / np.linalg.norm(v))
        assert abs(near.max() - got[r.doc_id].score) < 1e-5 and got[r.doc_id].lang_pred == model.langs[int(near.argmax())]


def test_edges(spark):
    rows = [(1, "le la les une de et", "fr"), (1, "le la les une de et", "fr"), (2, "the and of this that", "en"), (3, None, "en"), (4, "", "en"), (5, "12 !?", "en"), (6, "the", None), (None, "the and", "en"), (7, "x" * 200_000, "en")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.predict(df, langid.fit(df.where("doc_id < 7")), ["doc_id"]).orderBy("doc_id").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["fr", "en", "und", "und", "und", "en"]
    assert by[3].rejected and by[3].score == 0 and not by[1].rejected
    none = langid.fit(df.where(F.lit(False)))
    assert {r.lang_pred for r in langid.predict(df, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(df.where(F.lit(False)), none, ["doc_id"]).count() == 0


def test_language_never_learnt_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    learnt = docs.where(~langid.held_out(F.col("doc_id")))
    for lang in ("es", "fr", "de"):
        model = langid.fit(learnt.where(F.col("lang") != lang))
        gone = langid.predict(docs, model, ["lang"]).where(F.col("lang") == lang).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
        print("GONE", lang, gone)
        assert gone >= 0.9, (lang, gone)
