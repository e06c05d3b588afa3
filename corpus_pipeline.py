"""Cleaning a corpus in five stages, each by one of the corpus operators.

``run(spark, sf_dir)`` applies the stages to the documents; each result is written
as Parquet to the shared folder and read again as the next stage's documents.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provlake.llm.common import documents, saved
from provlake.llm.mixing import mix_documents
from provlake.llm.packing import packed_documents
from provlake.llm.pii import redact_documents
from provlake.llm.simhash_trie import keep_one
from provlake.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHashes (of five-word shingles) within 3 bits stays: copies and the nearest copies.

    Most pairs of Jaccard similarity between 0.8 and 1 differ in more bits and both stay (README gives the measured recall).
    """
    return keep_one(docs, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens: one row per piece."""
    return packed_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None  # trees and tokenizers have no SQL form; every stage is tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
