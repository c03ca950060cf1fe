"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, html_extract, jaccard, langid, license_scan, pii, sampled_pieces, sharding, sstable
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", _tokenizer("piece_bpe_32k.model")).drop("text")


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digest(spark, table(spark, sf_dir, "documents", "doc_id", "text"), _tokenizer("word_bpe_49k.json"))


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    return sharding.place(docs, "doc_id", SHARDS, ["n_chars"]).select("doc_id", "slot", "shard", "hot")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [pii.count("base", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, "base_sha256", pii.text_of("spans").alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.drop("text_hash")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 50 = 0"), k=5)


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.classify(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"), ["page_id", "url"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_sstable": op2_sstable,
    "op3_sharding": op3_sharding,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_ann": op6_ann,
    "op7_license": op7_license,
    "op8_langid": op8_langid,
    "op9_jaccard": op9_jaccard,
    "op10_html": op10_html,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL: dict[str, str] = {
    # classes of equal sets, pairs of classes that share a shingle, and what their links reach
    "op9_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])))) END AS s FROM w),
 c AS (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS class FROM s),
 one AS (SELECT class, n, unnest(s) AS shingle FROM c WHERE n > 0 AND doc_id = class),
 link AS (SELECT a.class AS a, b.class AS b FROM one a JOIN one b ON a.shingle = b.shingle AND a.class <> b.class GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 reach AS (SELECT class AS node, class AS root FROM c WHERE doc_id = class UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node)
 SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE (SELECT min(root) FROM reach WHERE node = class) END AS component_id FROM c""",
}
