"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor
kept, and is written as Parquet before the next reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import exact_dedup, language, near as similar, packing
from barloom.llm.common import documents, ship_package, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text some language's model accepts."""
    return language.accepted(docs, language.fit_on_training_rows(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints (five-word shingles, similarity 0.8), the one with the smallest id."""
    return similar.deduplicate(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_units=150_000)   # workers share the executor with what earlier stages left


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("nnls_packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
