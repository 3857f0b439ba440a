"""Losses and accuracies of predictions, and row-level comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.operators.model import Ensemble
from tilework.operators.predict import predict


def _w(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1.0)


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))


def mse(df: DataFrame, value: str = "value", y: str = "y", by: str = "split") -> DataFrame:
    d = F.col(value) - F.col(y)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("mse"))


def binary_logloss_acc(df: DataFrame, probability: str = "probability", y: str = "y", weight: str | None = None, by: str = "split") -> DataFrame:
    p = _clip(F.col(probability))
    loss = -F.when(F.col(y) == 1, F.log(p)).otherwise(F.log(1 - p))
    right = ((F.col(probability) >= 0.5).cast("int") == F.col(y)).cast("double")
    w = _w(weight)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.sum(loss * w) / F.sum(w)).alias("logloss"), F.avg(right).alias("accuracy"))


def multiclass_logloss_acc(df: DataFrame, probabilities: str = "probabilities", cls: str = "cls", y: str = "y", weight: str | None = None, by: str = "split") -> DataFrame:
    loss = -F.log(F.greatest(F.element_at(probabilities, F.col(y).cast("int") + 1), F.lit(1e-12)))
    w = _w(weight)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.sum(loss * w) / F.sum(w)).alias("logloss"), F.avg((F.col(cls) == F.col(y)).cast("double")).alias("accuracy"))


def multilabel_logloss_acc(df: DataFrame, probabilities: str = "probabilities", labels: str = "labels", weights: list[float] | None = None, by: str = "split") -> DataFrame:
    """Over all (row, label) pairs; a positive label weighs its weight."""
    pairs = df.select(by, F.posexplode(F.arrays_zip(F.col(probabilities).alias("p"), F.col(labels).alias("y"))).alias("k", "v"))
    p, y = F.col("v.p"), F.col("v.y")
    w = F.when(y == 1, F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("k") + 1)).otherwise(1.0) if weights else F.lit(1.0)
    loss = -F.when(y == 1, F.log(_clip(p))).otherwise(F.log(1 - _clip(p)))
    right = ((p >= 0.5).cast("int") == y).cast("double")
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.sum(loss * w) / F.sum(w)).alias("logloss"), F.avg(right).alias("accuracy"))


def evaluate(df: DataFrame, ensemble: Ensemble, y: str | None = None, by: str = "split") -> DataFrame:
    """Unweighted loss (and accuracy) of a stored model by part of a table."""
    out = predict(df, ensemble)
    if ensemble.task == "regression":
        return mse(out, y=y or "y", by=by)
    if ensemble.task == "binary_classification":
        return binary_logloss_acc(out, y=y or "y", by=by)
    if ensemble.task == "multiclass_classification":
        return multiclass_logloss_acc(out, y=y or "y", by=by)
    return multilabel_logloss_acc(out, labels=y or "labels", by=by)


def error_band(value: Column, y: Column) -> Column:
    """good to 5 % of the true value, warn to 15 % or where it is 0, else bad."""
    error = F.abs(value - y)
    share = F.when(y != 0, error / F.abs(y))
    return F.when(share.isNull() & (error == 0), "good").when(share.isNull(), "warn").when(share <= 0.05, "good").when(share <= 0.15, "warn").otherwise("bad")


def regression_error_bands(df: DataFrame, value: str = "value", y: str = "y") -> DataFrame:
    return df.groupBy(error_band(F.col(value), F.col(y)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def compare_predictions(pred: DataFrame, actual: DataFrame, task: str, row_id: str = "row_id") -> DataFrame:
    """Row by row: errors for regression, hits for classes, share of right labels for label arrays."""
    both = pred.join(actual, row_id)
    if task == "regression":
        error = F.abs(F.col("value") - F.col("y"))
        return both.select(row_id, "value", "y", error.alias("abs_error"), F.when(F.col("y") != 0, error / F.abs("y")).alias("rel_error"), error_band(F.col("value"), F.col("y")).alias("band"))
    if task == "multilabel_classification":
        hits = F.zip_with("predicted", "labels", lambda a, b: (a == b).cast("int"))
        return both.select(row_id, "predicted", "labels", (F.aggregate(hits, F.lit(0), lambda s, v: s + v) / F.size("labels")).alias("label_accuracy"))
    return both.select(row_id, "cls", "y", (F.col("cls") == F.col("y")).alias("correct"))
