"""A stored index from title words to tokens.

Postings are written once, in buckets of the word's hash, sorted by word and
token inside a bucket. A search reads the buckets of its words only, and the
sorted files let the scan pass over row groups of other words and of tokens
before the cursor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.operators.catalog import build_postings

BUCKETS = 256
SCHEMA = "word string, token_id long, pos int, bucket int"


def _bucket(word: str | Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def write_index(models: DataFrame, path: str) -> None:
    """Add the titles of models (token_id, title) to the index under ``path``; a model is added once."""
    postings = build_postings(models).withColumn("token_id", F.col("token_id").cast("long")).withColumn("bucket", _bucket("word"))
    sorted_ = postings.repartition("bucket").sortWithinPartitions("bucket", "word", "token_id")
    sorted_.write.mode("append").partitionBy("bucket").parquet(path)


def search_index(spark: SparkSession, path: str, words: Sequence[str], after: int | None = None) -> DataFrame:
    """(token_id) of the titles that hold all words of two characters or more, in any case; those above the cursor ``after``.

    Without such a word there are no rows.
    """
    wanted = list(dict.fromkeys(w.lower() for w in words if len(w) >= 2))
    postings = spark.read.schema(SCHEMA).parquet(path)
    if not wanted:
        return postings.select("token_id").limit(0)
    named = spark.createDataFrame([(w,) for w in wanted], "word string")
    buckets = [r[0] for r in named.select(_bucket("word")).distinct().collect()]  # as many as words at most
    hits = postings.filter(F.col("bucket").isin(*buckets) & F.col("word").isin(*wanted))
    if after is not None:
        hits = hits.filter(F.col("token_id") > after)
    if len(wanted) == 1:
        return hits.select("token_id")
    return hits.groupBy("token_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("token_id")


def index_page(spark: SparkSession, path: str, words: Sequence[str], after: int | None, limit: int) -> DataFrame:
    """The next ``limit`` tokens behind the cursor, in order; the last one is the next cursor."""
    return search_index(spark, path, words, after).orderBy("token_id").limit(limit)
