"""A corpus pipeline: quality rules, language, near-duplicates, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as
Parquet and read again as the next one's docs, and the tables that a stage wrote on the way are deleted then.

Rows without id or text, repeated ids and rows, ties, an empty table and further columns of any name are
handled as the stage's operator states: each row is judged by itself, and all columns are handed on by all
stages but the last. Texts without words fail the quality rules; very long ones are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import decontaminate, language_id, near_duplicates, quality_rules, sentence_pieces
from tallyfold.llm.queries import piece_model_path
from tallyfold.plans.storage import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return quality_rules.keep_clean(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, by text, declared language and source."""
    return language_id.keep_known(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more."""
    return near_duplicates.keep_first(docs, size=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and the digests of ids and decoded text."""
    return sentence_pieces.digests(sentence_pieces.encode_decode(docs, piece_model_path()))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("sentence_pieces", encode_stage),
]

#: SQL expresses neither the language model nor the encoding; brute-force versions stand in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, name, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
