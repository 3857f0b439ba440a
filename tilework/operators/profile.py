"""Class balance, weights, ranges, scale and starting scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.functions import canon_label, clamp_i32, is_strict_number, js_round, log_odds, parse_binary01

MAX_SCALE, HEADROOM = 1_000_000, 2147480000.0


def label_values(df: DataFrame, label: str) -> DataFrame:
    """(label, n, all_numeric) for each distinct label, blanks left out.

    Sort by ``place``: by number if all are numbers, else by code point. One
    row per label, ranked in one task.
    """
    text = canon_label(F.col(label).cast("string"))
    counts = df.select(text.alias("label")).filter("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.coalesce(F.min(is_strict_number("label")), F.lit(True)).alias("all_numeric"))
    return counts.crossJoin(F.broadcast(every)).orderBy(F.when(F.col("all_numeric"), F.col("label").try_cast("double")), "label")  # every is one row


def class_balance(df: DataFrame, y: str = "y") -> DataFrame:
    return df.groupBy(F.col(y).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def label_balance(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, pos, neg) over the rows whose labels all parse; one pass."""
    parsed = [parse_binary01(F.col(c).cast("string")).alias(c) for c in labels]
    whole = df.select(*parsed).dropna()
    sums = whole.agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in labels])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("long").alias("pos"), (F.col("_n") - F.col(c)).alias("neg")) for c in labels]))
    return sums.select(rows.alias("r")).select("r.*")


def binary_weights(df: DataFrame, y: str = "y", mode: str = "auto", w0: float = 1.0, w1: float = 1.0, cap: float = 20.0, normalize: bool = False) -> DataFrame:
    """One row: c0, c1, w0, w1. Auto weights are N / (2 count)."""
    one = df.agg(F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("c0"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("c1"))
    n = F.col("c0") + F.col("c1")
    if mode == "auto":
        ws = [F.when(F.col(c) > 0, n / (2.0 * F.col(c))).otherwise(1.0) for c in ("c0", "c1")]
    else:
        ws = [F.lit(float(w) if w > 0 else 1.0) for w in (w0, w1)]
    limit = F.lit(float(cap) if cap > 0 else 20.0)
    one = one.withColumn("w0", F.least(ws[0], limit)).withColumn("w1", F.least(ws[1], limit))
    if normalize:
        mean = (F.col("w0") * F.col("c0") + F.col("w1") * F.col("c1")) / n
        one = one.withColumn("m", F.when(mean > 0, mean).otherwise(1.0)).withColumn("w0", F.col("w0") / F.col("m")).withColumn("w1", F.col("w1") / F.col("m")).drop("m")
    return one


def class_weights(df: DataFrame, n_classes: int, y: str = "y", manual: Sequence[float] | None = None, cap: float = 20.0, normalize: bool = False) -> DataFrame:
    """(cls, n, w) for all classes 0..n_classes-1; auto weights are N / (K count), 1 without rows."""
    if manual is not None and len(manual) < n_classes:
        raise ValueError("a weight for each class is needed")
    spark = df.sparkSession
    classes = spark.range(n_classes).select(F.col("id").cast("int").alias("cls"))
    counts = df.groupBy(F.col(y).cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    all_ = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))  # one row
    out = classes.join(counts, "cls", "left").withColumn("n", F.coalesce("n", F.lit(0))).crossJoin(all_)
    if manual is None:
        w = F.when(F.col("n") > 0, F.col("total") / (F.lit(float(n_classes)) * F.col("n"))).otherwise(1.0)
    else:
        w = F.element_at(F.array(*[F.lit(float(x) if x > 0 else 1.0) for x in manual]), F.col("cls") + 1)
    out = out.withColumn("w", F.least(w, F.lit(float(cap) if cap > 0 else 20.0)))
    if normalize:
        mean = F.broadcast(out.agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("mean")))
        out = out.crossJoin(mean).withColumn("w", F.when(F.col("mean") > 0, F.col("w") / F.col("mean")).otherwise(F.col("w")))
    return out.select("cls", "n", "w")


def label_pos_weights(df: DataFrame, n_labels: int, labels: str = "labels", cap: float = 20.0, normalize: bool = False) -> DataFrame:
    """(label, pos, neg, w, scale): weights neg / pos, capped, never below 1e-6; one scale for all."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(labels)[k]), F.lit(0)).alias(f"p{k}") for k in range(n_labels)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"p{k}").cast("long").alias("pos"), (F.col("n") - F.col(f"p{k}")).alias("neg")) for k in range(n_labels)]))
    out = sums.select(rows.alias("r")).select("r.*")
    w = F.when(F.col("pos") > 0, F.col("neg") / F.col("pos")).otherwise(1.0)
    out = out.withColumn("w", F.least(F.greatest(w, F.lit(1e-6)), F.lit(float(cap) if cap > 0 else 20.0)))
    if not normalize:
        return out.withColumn("scale", F.lit(1.0))
    mean = F.broadcast(out.agg((F.sum(F.col("neg") + F.col("w") * F.col("pos")) / F.sum(F.col("neg") + F.col("pos"))).alias("mean")))
    return out.crossJoin(mean).withColumn("scale", F.when(F.col("mean") > 0, 1 / F.col("mean")).otherwise(1.0)).drop("mean")


def feature_ranges(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, low, high, width): one aggregation over all columns; width 0 where nothing spreads."""
    one = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"lo{i}").cast("double").alias("low"), F.col(f"hi{i}").cast("double").alias("high")) for i, c in enumerate(features)]))
    out = one.select(rows.alias("r")).select("r.*")
    return out.withColumn("width", F.greatest(F.col("high") - F.col("low"), F.lit(0.0)))


def auto_scale(df: DataFrame, features: Sequence[str], y: str | None = None) -> DataFrame:
    """One row ``scale_q``: as fine as 32 bits allow for all features (and y), 1,000,000 at most."""
    def top(c):
        return F.coalesce(F.max(F.abs(F.col(c).cast("double"))), F.lit(0.0))

    room = lambda m: F.when(m > 0, F.floor(F.lit(HEADROOM) / m)).otherwise(F.lit(MAX_SCALE))
    tops = [top(c) for c in features]
    scale = room(F.greatest(*tops) if len(tops) > 1 else tops[0])
    if y:
        scale = F.least(scale, room(top(y)))
    return df.agg(F.greatest(F.lit(1), F.least(F.lit(MAX_SCALE), scale)).cast("long").alias("scale_q"))


def scale_of(tops: Sequence[float], more: Sequence[float] = ()) -> int:
    """auto_scale() from the largest magnitudes that were found already."""
    room = [math.floor(HEADROOM / m) if m > 0 else MAX_SCALE for m in (max(tops, default=0.0), *more)]
    return max(1, min(MAX_SCALE, *room))


def base_score_regression(df: DataFrame, scale_q: int, y: str = "y") -> DataFrame:
    return df.agg(clamp_i32(js_round(F.avg(F.col(y).cast("double")) * scale_q)).alias("base_q"))


def base_score_binary(df: DataFrame, scale_q: int, y: str = "y", w0: float = 1.0, w1: float = 1.0) -> DataFrame:
    """Log-odds of the weighted share of ones, from counts."""
    ones, zeros = F.sum(F.when(F.col(y) == 1, 1).otherwise(0)), F.sum(F.when(F.col(y) == 1, 0).otherwise(1))
    p = ones * w1 / F.greatest(ones * w1 + zeros * w0, F.lit(1e-12))
    return df.agg(clamp_i32(js_round(log_odds(p) * scale_q)).alias("base_q"))


def base_score_multiclass(weights: DataFrame, scale_q: int, smooth: float = 1e-3) -> DataFrame:
    """(cls, base_q): log of the smoothed weighted share of each class, from class_weights()."""
    k = F.broadcast(weights.agg(F.sum(F.col("w") * F.col("n")).alias("all_w"), F.count(F.lit(1)).alias("k")))
    p = (F.col("w") * F.col("n") + smooth) / F.greatest(F.col("all_w") + smooth * F.col("k"), F.lit(1e-9))
    return weights.crossJoin(k).select("cls", clamp_i32(js_round(F.log(F.greatest(p, F.lit(1e-9))) * scale_q)).alias("base_q"))


def base_score_multilabel(weights: DataFrame, scale_q: int) -> DataFrame:
    """(label, base_q): log-odds per label, from label_pos_weights()."""
    up = F.col("w") * F.col("pos")
    p = F.when(F.col("neg") + F.col("pos") > 0, up / F.greatest(F.col("neg") + up, F.lit(1e-12))).otherwise(0.5)
    return weights.select("label", clamp_i32(js_round(log_odds(p) * scale_q)).alias("base_q"))


def dataset_summary(df: DataFrame, reason: str, n_features: int, n_classes: int) -> DataFrame:
    """One row: raw, usable and dropped rows, columns, features, classes."""
    kept = F.sum(F.when(F.col(reason) == "kept", 1).otherwise(0))
    n = F.count(F.lit(1))
    return df.agg(n.alias("raw_rows"), kept.alias("usable_rows"), (n - kept).alias("dropped_rows")).select("*", F.lit(len(df.columns) - 1).alias("columns"), F.lit(n_features).alias("features"), F.lit(n_classes).alias("classes"))
