"""The corpus pipeline: language, near duplicates, decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a
DataFrame; ``run`` writes each as Parquet in the shared folder, reads it again for the next one and removes it after that.

Edge cases: a null or empty text has no letter and goes in the first stage; rows that repeat, or differ in id alone, are one group of
copies of which the row with the least doc_id stays (null ids last); columns besides doc_id, text and lang pass as they are, whatever
their names; an empty table gives an empty result; with no labelled rows no language is known and all rows go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, jaccard, langid, pii, sampled_pieces


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: no letter in them, or far from all it has learnt."""
    model = langid.fit(docs.where(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(True))))
    return langid.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id; texts without words all stay."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; all documents stay."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, and whether decoding gave its text back."""
    import public_tokenizers

    return sampled_pieces.encode(docs, "doc_id", str(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", personal_data),
    ("sentencepiece", token_ids),
]

#: SQL has no expression for the centroids, the patterns' scores or the sampling; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialise(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
