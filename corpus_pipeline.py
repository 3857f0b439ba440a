"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet and read again as the next one's docs. All but the last keep the
columns of documents; the last adds each row's shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilework.llm import decontaminate, jaccard_join, language, mixing, sharding
from tilework.llm.common import settle, small_batches, table

N_SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language explains go, and those without a letter."""
    small_batches(spark)
    return language.accept(docs, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more, the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target mixture takes it."""
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in the shard."""
    return sharding.place(docs, N_SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL cannot express the learned and randomised stages; tests compare them
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
