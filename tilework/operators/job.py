"""From a delimited file to a stored model in one job.

Read, account for every row, clean, split, write the cleaned table, train,
evaluate each part, and store the model with its package. Every step is one of
the library's operators; what the job adds is their order and one table that
all later steps read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.operators import boost, clean, evaluate, profile, split
from tilework.sources import delimited, models
from tilework.sources.shared import discard, settle

#: Distinct labels up to which a binary mapping or a class list is taken from the file.
MOST_LABELS = 1000
_ROW = "_row"


@dataclasses.dataclass
class Outcome:
    """What a job leaves: the run, the names of its outputs, tables of counts and of losses."""

    run: boost.Run
    features: list[str]
    labels: list[str]
    report: DataFrame  # (reason, n) of all rows of the file
    parts: DataFrame  # (split, n)
    losses: DataFrame  # by split
    path: str


def label_names(raw: DataFrame, task: str, labels: Sequence[str], classes: Sequence[str] | None, infer_mapping: bool = False) -> list[str]:
    """The names of the outputs: the given ones, else those of the file in the order of profile.label_values()."""
    if task == "regression":
        return []
    if task == "multilabel_classification":
        return list(labels)
    if classes:
        return list(classes)
    found = profile.label_values(raw, f"`{labels[0]}`").limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} distinct labels")
    values = [r["label"] for r in found]
    if task == "binary_classification":
        return list(clean.default_binary_mapping(values, bool(found and found[0]["all_numeric"]), infer_mapping))
    return values


def usable(raw: DataFrame, task: str, labels: Sequence[str], names: Sequence[str], features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The rows of raw that the task can use, as numbers."""
    if task == "regression":
        return clean.regression_rows(raw, labels[0], features, keep)
    if task == "binary_classification":
        return clean.binary_rows(raw, labels[0], *names, features, keep)
    if task == "multiclass_classification":
        return clean.multiclass_rows(raw, labels[0], names, features, keep)
    return clean.multilabel_rows(raw, labels, features, keep)


def train_file(
    spark: SparkSession, path: str, out: str, task: str, labels: Sequence[str | int], features: Sequence[str | int] | None = None, classes: Sequence[str] | None = None,
    params: boost.Params | None = None, row_id: str | None = None, limit: int | None = None, delimiter: str = "auto", title: str = "", model_id: str = "model", stratify: bool = False, infer_mapping: bool = False,
) -> Outcome:
    """Train on a file and leave under ``out``: rows/ (cleaned, by split), store/ (the model as tables), files/ (the model's bytes with its package).

    Without a ``row_id`` column rows are numbered once, as they are read. With
    a ``limit`` the first rows of the file (or of the id) are taken before
    anything is judged. Fewer than three usable rows are an error.
    """
    raw = delimited.read_delimited(spark, path, delimiter)
    if limit is not None:
        raw = delimited.limit_raw_rows(raw, limit, row_id)
    named, chosen = clean.select_features(raw, labels, features)
    chosen = [c for c in chosen if c != row_id]
    raw = settle(raw.withColumn(_ROW, F.monotonically_increasing_id() if row_id is None else F.col(row_id)), "raw")
    names = label_names(raw, task, named, classes, infer_mapping)
    rows = settle(usable(raw, task, named, names, chosen, [_ROW]), "usable")  # the split reads it three times, texts are parsed once
    clean.check_usable(rows)
    y = "labels" if task == "multilabel_classification" else "y"
    parted = split.stratified_split(rows, _ROW, y) if stratify and task != "multilabel_classification" else split.seeded_split(rows, _ROW)
    delimited.write_dataset(parted, f"{out}/rows")
    discard(rows)
    stored = spark.read.parquet(f"{out}/rows")
    params = params or boost.Params()
    outputs = max(1, len(names)) if task in ("multiclass_classification", "multilabel_classification") else 1
    run = boost.train(stored, chosen, task, params, y=y, row_id=_ROW if params.binning == "quantile" else None, n_out=outputs)
    run.ensemble.model_id = model_id
    losses = evaluate.evaluate(stored, run.ensemble)
    store_run(spark, run, out, title, names, params)
    report = settle(clean.drop_report(raw, task, named, chosen, names), "report")
    parts = settle(stored.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "parts")
    losses = settle(losses, "losses")
    discard(raw)
    return Outcome(run, chosen, names, report, parts, losses, out)


def store_run(spark: SparkSession, run: boost.Run, out: str, title: str, names: Sequence[str], params: boost.Params) -> None:
    """A run as the tables of a store and as a file with its package."""
    told = {k: list(v) if isinstance(v, tuple) else v for k, v in dataclasses.asdict(params).items() if k != "extra"}
    models.write_model_tables(run, spark, f"{out}/store", title, names, told)
    package = models.package_of(run.ensemble.task, title, run.ensemble.features, names, told, run.curve, {"bestIter": run.best_iter, "bestValMetric": run.best_val})
    data = models.encode_models(*run.ensemble.tables(spark)).withColumn("package", F.lit(package))
    models.write_model_files(models.attach_package(data), f"{out}/files")
