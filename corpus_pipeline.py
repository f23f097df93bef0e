"""A training corpus from ``documents``: five stages, each on what the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe_words, decontaminate, exact_dedup, ngram_join, toxicity
from lexloom.llm.queries import table, tokenizer_path
from lexloom.llm.store import work_dir, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; it is fitted on the labelled ones among ``docs``.

    Without labels of two grades, or without documents, none goes; null texts
    have the base rates.
    """
    scored = toxicity.toxicity(spark, docs, table(spark, sf_dir, "labels"))
    return scored.where("not rejected").select(docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, in one row; null is equal to empty, and a null id is the smallest."""
    return exact_dedup.without_copies(spark, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, the smallest doc_id stays; texts without words are in no group."""
    return ngram_join.one_of_each(spark, docs, words=5, threshold=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, told apart by id and text; without items none goes."""
    return decontaminate.without_contaminated(spark, docs, table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text; a null text has no ids."""
    found = bpe_words.round_trip(spark, docs, tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL can't express the fitted model or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
