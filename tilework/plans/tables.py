"""The driver's tables as training rows and as a catalogue with its log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

#: SQL of lines(): the same rows and columns.
LINES_SQL = """lines AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
    l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
  FROM lineitem
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a unique row_id and the charge as target."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    row_id = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents)
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(row_id.alias("row_id"), "l_orderkey", "l_partkey", "l_linenumber", *FEATURES, "l_returnflag", charge.alias("charge"))


#: Text as it comes from files: SQL of dirty().
DIRTY_SQL = """dirty AS (
  SELECT row_id, l_returnflag,
    CASE CAST(l_orderkey % 9 AS INTEGER) WHEN 0 THEN '12abc' WHEN 1 THEN '' WHEN 2 THEN '1.0' WHEN 3 THEN 'TRUE' WHEN 4 THEN ' 7 '
      WHEN 5 THEN '-0.50' WHEN 6 THEN '1d' WHEN 7 THEN 'no' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS a,
    CASE CAST(l_partkey % 11 AS INTEGER) WHEN 0 THEN 'NaN' WHEN 1 THEN '1e3' WHEN 2 THEN 'inf' WHEN 3 THEN NULL WHEN 4 THEN '.5' ELSE CAST(l_linenumber AS VARCHAR) END AS b
  FROM lines
)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines' values as text with the faults of real files."""
    k = F.col("l_orderkey") % 9
    a = F.when(k == 0, "12abc").when(k == 1, "").when(k == 2, "1.0").when(k == 3, "TRUE").when(k == 4, " 7 ").when(k == 5, "-0.50").when(k == 6, "1d").when(k == 7, "no")
    j = F.col("l_partkey") % 11
    b = F.when(j == 0, "NaN").when(j == 1, "1e3").when(j == 2, "inf").when(j == 3, F.lit(None)).when(j == 4, ".5").otherwise(F.col("l_linenumber").cast("string"))
    return lines(spark, sf_dir).select("row_id", "l_returnflag", a.otherwise(F.col("l_quantity").cast("long").cast("string")).alias("a"), b.alias("b"))


#: SQL of log(): one catalogue event for each of the driver's events.
LOG_SQL = """log AS (
  SELECT event_id AS block, CAST(event_id % 7 AS INTEGER) AS log_index, event_type,
    CAST(json_extract(props, '$.k') AS BIGINT) AS token_id, concat('m', CAST(json_extract(props, '$.k') AS BIGINT) % 20) AS model_id,
    CAST(user_id AS VARCHAR) AS key, CAST(user_id AS VARCHAR) AS actor, CAST(round(value * 100) AS BIGINT) AS amount
  FROM events
)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (block, log_index, event_type, token_id, model_id, key, actor, amount)."""
    k = F.get_json_object("props", "$.k").cast("long")
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("block"), (F.col("event_id") % 7).cast("int").alias("log_index"), "event_type", k.alias("token_id"),
        F.concat(F.lit("m"), (k % 20).cast("string")).alias("model_id"), user.alias("key"), user.alias("actor"),
        F.round(F.col("value") * 100).cast("decimal(38,0)").alias("amount"),
    )


def renamed(log_: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The events of the given types under the catalogue's names."""
    kind = F.coalesce(*[F.when(F.col("event_type") == t, k) for t, k in kinds.items()])
    return log_.withColumn("kind", kind).filter(F.col("kind").isNotNull())
