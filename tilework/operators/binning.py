"""Bins of features and the histogram side of split search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.operators.sketch import quantile_sketch
from tilework.operators.split import sample_rows


def quantile_thresholds(df: DataFrame, features: Sequence[str], bins: int = 32, row_id: str | None = None, sample: int = 50_000, seed: int = 42) -> DataFrame:
    """(feature, thresholds): bins - 1 interpolated quantiles each.

    With row_id they are exact on a seeded sample of rows (256 at least);
    without, those of a sketch of all rows (see sketch.quantile_sketch).
    """
    if row_id is None:
        return quantile_sketch(df, features, bins).drop("error")
    at = [j / bins for j in range(1, bins)]
    rows = sample_rows(df.select(row_id, *features), row_id, max(256, sample), seed)
    one = rows.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(q) for q in at])).alias(f"q{i}") for i, c in enumerate(features)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"q{i}").alias("thresholds")) for i, c in enumerate(features)]))
    return one.select(pairs.alias("r")).select("r.*")


def cumulative_bins(hist: DataFrame, key: Sequence[str]) -> DataFrame:
    """hist (key, bin, n, g, h) with sums left of and at each bin (nl, gl, hl) and of all (nt, gt, ht)."""
    w = W.partitionBy(*key)
    upto = w.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = hist
    for c in ("n", "g", "h"):
        out = out.withColumn(f"{c}l", F.sum(c).over(upto)).withColumn(f"{c}t", F.sum(c).over(w))
    return out


def split_score(classify: bool, grid: float = 1.0) -> Column:
    """What a boundary is worth: for regression the part of the squared error
    that depends on it, for classification the gain of the second-order loss."""
    gl, gt = F.col("gl") / grid, F.col("gt") / grid
    gr = gt - gl
    if not classify:
        return gl * gl / F.col("nl") + gr * gr / (F.col("nt") - F.col("nl"))
    hl, ht = F.col("hl") / grid, F.col("ht") / grid
    return gl * gl / (hl + 1) + gr * gr / (ht - hl + 1) - gt * gt / (ht + 1)


def ranked_splits(hist: DataFrame, key: Sequence[str], min_leaf: int, classify: bool = False, grid: float = 1.0, bins: int | None = None, counts: Column | None = None) -> DataFrame:
    """hist with its cumulative sums, the ``score`` of each boundary (null: not allowed) and whether it is its node's ``best``.

    Both sides need min_leaf rows; a classification gain must be positive.
    Ties go to the earlier drawn feature, then to the lowest bin. Rows outside
    ``counts`` pass through without a score.
    """
    cum = cumulative_bins(hist, [*key, "feature"])
    allowed = (F.col("nl") >= min_leaf) & (F.col("nt") - F.col("nl") >= min_leaf)
    for more in (counts, F.col("bin") < bins - 1 if bins is not None else None):
        allowed = allowed if more is None else allowed & more
    cum = cum.withColumn("score", F.when(allowed, split_score(classify, grid)))
    if classify:
        cum = cum.withColumn("score", F.when(F.col("score") > 0, F.col("score")))
    order = W.partitionBy(*key).orderBy(F.col("score").desc_nulls_last(), "draw", "bin")
    return cum.withColumn("best", F.col("score").isNotNull() & (F.row_number().over(order) == 1))


def best_split(hist: DataFrame, key: Sequence[str], min_leaf: int, classify: bool = False, grid: float = 1.0, bins: int | None = None) -> DataFrame:
    """For each node (key) the best (feature, bin) with its sums, by ranked_splits().

    hist has key, feature, draw, bin, n, g, h; empty bins may be missing.
    """
    return ranked_splits(hist, key, min_leaf, classify, grid, bins).filter("best").drop("best")
