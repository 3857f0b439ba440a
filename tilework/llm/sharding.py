"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row's fractional rank
is (rank - 1/2) / rows of its source. Sorted by fractional rank, the sources
are interleaved in proportion, so any cut into consecutive pieces gives every
shard the mixture of the whole. Cuts by row count make shards that differ by
one row at most (law ``rows``).

Both rankings are exact without a global sort in one task: rows are dealt to
fixed hash (then rank) buckets, only the counts of the buckets are summed up,
and rows are ranked inside their own bucket. A hot source spreads over all of
its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.llm.common import settle, table

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS


def interleave(rows: DataFrame, source: str, order: list[str], n_shards: int, seed: int = 42) -> DataFrame:
    """The rows with ``shard`` (0..n_shards-1) and ``slot`` (0.. in a shard).

    order: columns that tell rows apart; rows alike in all of them are
    interchangeable. A null source is a source of its own. Reruns agree. An
    empty table gives an empty table. Columns named like the working columns
    (they begin with ``_``) must not be among the input's.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in order])
    dealt = rows.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned("_h", 64 - BUCKET_BITS).cast("int"))
    dealt = dealt.withColumn("_none", F.col(source).isNull()).withColumn("_src", F.coalesce(F.col(source), F.lit("")))
    key = ["_none", "_src"]
    counts = dealt.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    in_source = W.partitionBy(*key)
    offsets = counts.select(
        *key, "_b",
        (F.sum("_n").over(in_source.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(in_source).alias("_of"),
    )
    in_bucket = W.partitionBy(*key, "_b").orderBy("_h", *order)
    ranked = dealt.withColumn("_r", F.row_number().over(in_bucket)).join(offsets, [*key, "_b"])
    rank = F.col("_before") + F.col("_r")
    ranked = ranked.withColumn("_frac", (rank - F.lit(0.5)) / F.col("_of"))
    ranked = settle(ranked.withColumn("_fb", F.floor(F.col("_frac") * BUCKETS).cast("int")).drop("_b", "_before", "_r", "_of"), "fractional_ranks")
    # One row for each of the BUCKETS rank buckets: a fixed bound.
    sums = ranked.groupBy("_fb").agg(F.count(F.lit(1)).alias("_n"))
    everything = W.orderBy("_fb")
    starts = sums.select(
        "_fb",
        (F.sum("_n").over(everything.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_start"),
        F.sum("_n").over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_total"),
    )
    place = F.row_number().over(W.partitionBy("_fb").orderBy("_frac", *key, "_h", *order))
    placed = ranked.withColumn("_p", place).join(F.broadcast(starts), "_fb")
    placed = placed.withColumn("_g", F.col("_start") + F.col("_p") - 1)
    placed = placed.withColumn("shard", F.expr(f"_g * {n_shards} div _total").cast("int"))
    first = F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}")
    placed = placed.withColumn("slot", F.col("_g") - first)
    return placed.drop("_fb", "_frac", "_h", "_none", "_src", "_p", "_start", "_total", "_g")


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (UTF-8 bytes plus 8) and crc32 of the text; null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 42) -> DataFrame:
    """One row per document with its shard and its slot in the shard.

    Null ids, texts and sources are rows like others; repeated rows each get a
    place. Extra columns of the input are not read.
    """
    narrow = settle(describe(docs), "sizes")
    return interleave(narrow, "source", ["doc_id", "text_crc32", "size"], n_shards, seed)


def place(docs: DataFrame, n_shards: int = 24, seed: int = 42) -> DataFrame:
    """The rows of docs, all columns, with ``shard`` and ``slot``; columns of these names in docs are replaced.

    Null ids, texts and sources are rows like others, an empty table gives no
    rows, and other columns, whatever their names, are carried along. Places are found on narrow rows; the texts are shuffled once, to meet
    them. Rows alike in id, source and text take their places in turn.
    """
    docs = docs.drop("shard", "slot")
    body = F.coalesce(F.col("text"), F.lit(""))
    key = ["no_id", "id", "none", "src", "crc", "len"]
    named = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.crc32(body).alias("crc"), F.octet_length(body).alias("len"),
    )
    narrow = settle(named.select(*key, F.when(~F.col("none"), F.col("src")).alias("source")), "sizes")
    placed = settle(interleave(narrow, "source", ["no_id", "id", "crc", "len"], n_shards, seed).drop("source"), "places")
    turn = W.partitionBy(*key)
    rows = named.withColumn("turn", F.row_number().over(turn.orderBy(F.xxhash64("row"))))
    places = placed.withColumn("turn", F.row_number().over(turn.orderBy("shard", "slot")))
    return rows.join(places, [*key, "turn"]).select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: int = 42) -> None:
    """Write whole rows as Parquet, one folder per shard, in slot order."""
    out = place(docs, n_shards, seed).repartition(n_shards, "shard").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and its slot there, under the law of rows.

    Counts are at most one apart and rows go by the fractional rank of their
    own hash inside their source, so equal texts are dealt as any other rows:
    they need not share a shard, and a group with more copies than a shard has
    rows could not. Null texts are empty, a null source is one of its own.
    """
    out = shard_documents(table(spark, sf_dir, "documents"), 24)
    none: Column = F.lit(None).cast("int")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), none.alias("grown_shard"))
