"""Exact seeded splits and samples.

The order of rows is that of md5(seed:id), so it depends on no partitioning
and SQL can repeat it. An exact cut needs the row of one rank, not a global
sort: rows are counted by the first three hex digits of the hash, and only
the rows in the bucket that holds a cut are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.functions import to_number
from tilework.sources.shared import settle


def seeded_hash(seed: int, row_id: str | Column) -> Column:
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def split_sizes(n: int, train: float, val: float) -> tuple[int, int]:
    """Rows of train and of train and validation: floors, one of each part at least."""
    a = max(1, int(n * train))
    b = max(1, int(n * val))
    if n >= 3:
        while a + b >= n:
            if a >= b and a > 1:
                a -= 1
            elif b > 1:
                b -= 1
            else:
                break
    return a, a + b


def _cuts(buckets: DataFrame, group: Sequence[str], train: float, val: float) -> DataFrame:
    """For each bucket, rows before it and the ranks of both cuts of its group."""
    w = W.partitionBy(*group)
    n = F.sum("n").over(w)
    before = F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    a0, b0 = F.greatest(F.lit(1), F.floor(n * train)), F.greatest(F.lit(1), F.floor(n * val))
    # Without a row left for the test, the larger part gives one.
    short = F.greatest(a0 + b0 - n + 1, F.lit(0))
    off_a = F.when(a0 >= b0, F.least(short, a0 - 1)).otherwise(0)
    off_b = F.least(short - off_a, b0 - 1)
    a, b = F.when(n >= 3, a0 - off_a).otherwise(a0), F.when(n >= 3, b0 - off_b).otherwise(b0)
    return buckets.select(*group, "bucket", before.alias("before"), F.col("n").alias("bucket_n"), a.cast("long").alias("cut_a"), (a + b).cast("long").alias("cut_b"))


def _split(df: DataFrame, row_id: str, group: Sequence[str], seed: int, train: float, val: float) -> DataFrame:
    rows = df.withColumn("_h", seeded_hash(seed, row_id)).withColumn("bucket", F.substring("_h", 1, 3))
    buckets = rows.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n"))
    # 4096 rows for each group at most.
    rows = rows.join(F.broadcast(_cuts(buckets, group, train, val)) if not group else _cuts(buckets, group, train, val), [*group, "bucket"])
    end = F.col("before") + F.col("bucket_n")
    cut = ((F.col("before") < F.col("cut_a")) & (end > F.col("cut_a"))) | ((F.col("before") < F.col("cut_b")) & (end > F.col("cut_b")))
    whole = rows.filter(~cut).withColumn("_rank", F.col("before") + 1)
    near = rows.filter(cut).withColumn("_rank", F.col("before") + F.row_number().over(W.partitionBy(*group, "bucket").orderBy("_h", row_id)))
    out = whole.unionByName(near)
    split = F.when(F.col("_rank") <= F.col("cut_a"), "train").when(F.col("_rank") <= F.col("cut_b"), "val").otherwise("test")
    return out.withColumn("split", split).drop("_h", "bucket", "before", "bucket_n", "cut_a", "cut_b", "_rank")


def seeded_split(df: DataFrame, row_id: str, seed: int = 42, train: float = 0.7, val: float = 0.2) -> DataFrame:
    """df with ``split``: train, val or test, exact in size."""
    return _split(df, row_id, [], seed, train, val)


def stratified_split(df: DataFrame, row_id: str, cls: str, seed: int = 42, train: float = 0.7, val: float = 0.2) -> DataFrame:
    """The same inside each class; without rows in one of the parts, seeded_split()."""
    out = _split(df, row_id, [cls], seed, train, val)
    if out.select("split").distinct().count() < 3:
        return seeded_split(df, row_id, seed, train, val)
    return out


def train_plus_val(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split").isin("train", "val"))


def sample_rows(df: DataFrame, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of least hash; Spark keeps k rows a task."""
    return df.orderBy(seeded_hash(seed, row_id), row_id).limit(k)


def sample_valid(df: DataFrame, row_id: str, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """k rows of least hash among those whose columns are all finite numbers, with ``n_valid``, how many such rows there are.

    The count is observed in the pass that finds the sample; columns come as
    DOUBLE. Without a valid row there are no rows.
    """
    numbers = [to_number(F.col(f"`{c}`").cast("string")) for c in columns]
    valid = df.select(row_id, *[n.alias(c) for n, c in zip(numbers, columns)]).dropna(subset=list(columns))
    seen = Observation()
    rows = sample_rows(valid.observe(seen, F.count(F.lit(1)).alias("n")), row_id, k, seed)
    return settle(rows, "sample").withColumn("n_valid", F.lit(int(seen.get["n"])).cast("long"))
