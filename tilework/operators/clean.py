"""Columns by name, usable rows by task, and an account of what is dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.functions import NEGATIVE_WORDS, POSITIVE_WORDS, canon_label, parse_binary01, to_number


def resolve_columns(df: DataFrame, specs: Sequence[str | int]) -> list[str]:
    """Column names from names (exact, else in any case) or places."""
    out = []
    for spec in specs:
        text = str(spec).strip()
        lower = [c for c in df.columns if c.lower() == text.lower()]
        if text in df.columns:
            out.append(text)
        elif lower:
            out.append(lower[0])
        elif text.lstrip("-").isdigit() and 0 <= int(text) < len(df.columns):
            out.append(df.columns[int(text)])
        else:
            raise ValueError(f"no column {spec!r} among {df.columns}")
    return out


def select_features(df: DataFrame, labels: Sequence[str | int], features: Sequence[str | int] | None = None) -> tuple[list[str], list[str]]:
    """Label and feature columns: each once, features without labels, one at least."""
    labels = list(dict.fromkeys(resolve_columns(df, labels)))
    wanted = resolve_columns(df, features) if features else df.columns
    kept = [c for c in dict.fromkeys(wanted) if c not in labels]
    if not kept:
        raise ValueError("no feature column is left")
    return labels, kept


def _numbers(features: Sequence[str]) -> list[Column]:
    return [to_number(F.col(f"`{c}`").cast("string")).alias(c) for c in features]


def _all_numbers(features: Sequence[str]) -> Column:
    good = F.lit(True)
    for c in features:
        good = good & to_number(F.col(f"`{c}`").cast("string")).isNotNull()
    return good


def numeric_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows whose features are all finite numbers, features as DOUBLE."""
    return df.filter(_all_numbers(features)).select(*keep, *_numbers(features))


def regression_rows(df: DataFrame, label: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    y = to_number(F.col(f"`{label}`").cast("string"))
    return df.filter(y.isNotNull() & _all_numbers(features)).select(*keep, *_numbers(features), y.alias("y"))


def binary_rows(df: DataFrame, label: str, neg: str, pos: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """y is 0 for neg and 1 for pos; rows with other labels go."""
    if not str(neg).strip() or not str(pos).strip() or str(neg) == str(pos):
        raise ValueError("the two labels must differ and not be empty")
    text = canon_label(F.col(f"`{label}`").cast("string"))
    y = F.transform(F.array(text), lambda t: F.when(t == str(neg), 0).when(t == str(pos), 1))[0]  # the text is worked out once
    return df.filter(y.isNotNull() & _all_numbers(features)).select(*keep, *_numbers(features), y.alias("y"))


def class_map(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(label_text, y): numbers by place in the list, the first of repeated names counts."""
    names = list(dict.fromkeys(str(c).strip() for c in classes))
    return df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "label_text string, y int")


def map_labels(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Rows with a listed label, with y; the list is small and broadcast."""
    text = canon_label(F.col(f"`{label}`").cast("string"))
    return df.withColumn("label_text", text).join(F.broadcast(class_map(df, classes)), "label_text").drop("label_text")


def multiclass_rows(df: DataFrame, label: str, classes: Sequence[str], features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return map_labels(df.filter(_all_numbers(features)), label, classes).select(*keep, *_numbers(features), "y")


def multilabel_rows(df: DataFrame, labels: Sequence[str], features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """labels as an array of 0 and 1; rows with a label that is neither go."""
    if len(set(labels)) < 2:
        raise ValueError("at least two label columns")
    ys = F.array(*[parse_binary01(F.col(f"`{c}`").cast("string")) for c in labels])
    whole = ~F.exists(ys, lambda v: v.isNull())
    return df.filter(whole & _all_numbers(features)).select(*keep, *_numbers(features), ys.alias("labels"))


def drop_reason(task: str, labels: Sequence[str], features: Sequence[str], classes: Sequence[str] = ()) -> Column:
    """The first check that a row fails, or 'kept'; labels come before features."""
    bad_features = ~_all_numbers(features)
    texts = [F.col(f"`{c}`").cast("string") for c in labels]
    if task == "multilabel_classification":
        missing, invalid = F.lit(False), F.lit(False)
        for t in texts:
            missing = missing | (F.trim(F.coalesce(t, F.lit(""))) == "")
            invalid = invalid | parse_binary01(t).isNull()
        return F.when(missing, "missing_label").when(invalid, "invalid_label").when(bad_features, "bad_feature").otherwise("kept")
    label = to_number(texts[0]).isNull() if task == "regression" else ~canon_label(texts[0]).isin(*[str(c) for c in classes])
    return F.when(label, "bad_label").when(bad_features, "bad_feature").otherwise("kept")


def drop_report(df: DataFrame, task: str, labels: Sequence[str], features: Sequence[str], classes: Sequence[str] = ()) -> DataFrame:
    """(reason, n): rows by the first failing check, and the kept."""
    return df.groupBy(drop_reason(task, labels, features, classes).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def default_binary_mapping(values: Sequence[str], all_numeric: bool, infer_mapping: bool = False) -> tuple[str, str]:
    """(negative, positive) from the ordered label values.

    More than two values are an error unless ``infer_mapping`` lets two of
    them be picked: of numbers the least and the greatest, else the first with
    a word for its side, else the first that the other side leaves.
    """
    if len(values) < 2 or (len(values) > 2 and not infer_mapping):
        raise ValueError(f"two labels are needed, not {len(values)}; name them or infer the mapping")
    if all_numeric:
        return values[0], values[-1]
    said = {words: [v for v in values if v.strip().lower() in words] for words in (NEGATIVE_WORDS, POSITIVE_WORDS)}
    yes = said[POSITIVE_WORDS][:1]
    neg = [*said[NEGATIVE_WORDS], *[v for v in values if v not in yes]][0]
    return neg, [*yes, *[v for v in values if v != neg]][0]


def check_usable(df: DataFrame, least: int = 3) -> None:
    """Fail with fewer usable rows than that."""
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} usable rows, at least {least} are needed")


def route_right(xq, threshold) -> Column:
    """A row goes right if its quantised value is above the threshold."""
    return F.col(xq) > F.col(threshold) if isinstance(xq, str) else xq > threshold
