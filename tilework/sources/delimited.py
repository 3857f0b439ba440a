"""Delimited text: every column a trimmed string."""

from __future__ import annotations

import csv
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The delimiters that are tried and the names they go by.
CANDIDATES = (",", ";", "\t", "|")
NAMES = {"comma": ",", "semicolon": ";", "tab": "\t", "tsv": "\t", "\\t": "\t", "pipe": "|"}


def normalize_delimiter(text: str | None) -> str:
    d = (text or "").lower()
    d = d if d in CANDIDATES else d.strip()
    if not d or d == "auto":
        return "auto"
    return NAMES.get(d, d[0])


def score_delimiter(lines: list[str], delimiter: str) -> tuple[int, int, int]:
    """How many lines have the usual number of cells, that number, and minus the foreign delimiters left in cells."""
    rows = [next(csv.reader([line], delimiter=delimiter), []) for line in lines if line]
    counts = Counter(len(r) for r in rows)
    if not counts:
        return 0, 1, 0
    cells, often = max(counts.items(), key=lambda c: (c[1], c[0]))
    foreign = sum(cell.count(d) for r in rows for cell in r for d in CANDIDATES if d != delimiter)
    return often, cells, -foreign


def detect_delimiter(spark: SparkSession, path: str, n: int = 20, fallback: str = ",") -> str:
    """The candidate that cuts the first n non-blank lines most evenly."""
    lines = [r["value"] for r in spark.read.text(path).filter(F.trim("value") != "").limit(n).collect()]
    scores = {d: score_delimiter(lines, d) for d in CANDIDATES}
    fit = {d: s for d, s in scores.items() if s[1] >= 2}
    return max(fit, key=lambda d: fit[d]) if fit else fallback


def normalize_headers(df: DataFrame, header: bool) -> DataFrame:
    """Trimmed names without a byte-order mark, or c0, c1, ... without a header."""
    names = [c.lstrip("﻿").strip() for c in df.columns] if header else [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Cells trimmed, missing ones empty; rows with blank cells only go."""
    trimmed = df.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])
    return trimmed.filter(F.concat(*[F.col(f"`{c}`") for c in df.columns]) != "")


def read_delimited(spark: SparkSession, path: str, delimiter: str = "auto", header: bool = True, multiline: bool = False) -> DataFrame:
    """All columns as strings; doubled quotes inside quoted cells, long rows cut, short ones padded."""
    sep = normalize_delimiter(delimiter)
    if sep == "auto":
        sep = detect_delimiter(spark, path)
    df = spark.read.csv(path, sep=sep, header=header, quote='"', escape='"', mode="PERMISSIVE", inferSchema=False, multiLine=multiline, enforceSchema=False)
    return drop_blank_rows(normalize_headers(df, header))


def limit_raw_rows(df: DataFrame, n: int, row_id: str | None = None) -> DataFrame:
    """The first n raw rows, by id where there is one."""
    return (df.orderBy(row_id) if row_id else df).limit(n)


def vector_source(df: DataFrame, column: str, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """An array column as f0, f1, ... of DOUBLE."""
    return df.select(*keep, *[F.col(column)[i].cast("double").alias(f"f{i}") for i in range(width)])


def write_dataset(df: DataFrame, path: str) -> None:
    """A cleaned, split table for many runs, one folder per split."""
    df.write.partitionBy("split").parquet(path)
