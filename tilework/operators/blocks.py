"""Training rows as packed blocks: a few thousand rows in one row of binary cells.

Values of a block lie row after row, so the cells of an Arrow batch are one
matrix without a copy. The number of features is a width, not a number of
columns or expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.functions import INT32_MAX, INT32_MIN

#: Rows of a block; blocks that a task works on at once, however large its Arrow batches are.
ROWS = 4096
PIECE = 16
#: Bytes of a column in one file of blocks.
FILE_BYTES = 32 << 20
RAW_SCHEMA = "n int, split binary, x binary, y binary"
BLOCK_SCHEMA = "n int, split binary, xq binary, bins binary, y binary, score binary"
#: Bin of a feature that does not spread.
NO_BIN = 0xFFFF


def packed(batch: pa.RecordBatch, name: str, dtype, width: int) -> np.ndarray:
    """The cells of a binary column as one matrix of ``width`` columns."""
    column = batch.column(name)
    if not len(column):
        return np.zeros((0, width), dtype)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    found = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return found.view(dtype).reshape(-1, width)


def pieces(batches: Iterator[pa.RecordBatch], blocks: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few blocks: what a task computes beside its batch stays small."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), blocks):
            yield batch.slice(at, blocks)


def blocks_a_file(width: int) -> int:
    """Blocks that a file may hold: a reader has a column of all of them in memory, in each task."""
    return max(PIECE, FILE_BYTES // (ROWS * 8 * max(width, 1)))


def _cut(n: int) -> list[tuple[int, int]]:
    return [(i, min(i + ROWS, n)) for i in range(0, n, ROWS)]


def pack_rows(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Blocks (n, split, x, y) of rows with ``_part`` (0 train, 1 val, 2 other).

    A feature or target that is null or NaN is an error: rows are cleaned
    before they are trained on.
    """
    many = df.schema[y].dataType.typeName() == "array"
    target = F.col(y).cast("array<double>") if many else F.col(y).cast("double")
    plain = df.select(F.col("_part").cast("int").alias("part"), target.alias("y"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], 1) if batch.num_columns > 2 else np.zeros((batch.num_rows, 0))
            told = batch.column(1)
            truth = (told.flatten() if many else told).to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            if np.isnan(x).any() or np.isnan(truth).any():
                raise ValueError("features and targets must be numbers; clean the rows first")
            part, cuts = batch.column(0).to_numpy().astype(np.uint8), _cut(len(x))
            cells = [pa.array([v[a:b].tobytes() for a, b in cuts], pa.binary()) for v in (part, x, truth)]
            yield pa.RecordBatch.from_arrays([pa.array([b - a for a, b in cuts], pa.int32()), *cells], ["n", "split", "x", "y"])

    return plain.mapInArrow(run, RAW_SCHEMA)


def ranges_of(raw: DataFrame, width: int) -> list[tuple[float, float, float]]:
    """(lowest, highest of the training rows, largest magnitude of all rows) of each feature, and last of the target.

    One map and one small aggregation; the driver gets a row for each feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, top = np.full(width + 1, np.inf), np.full(width + 1, -np.inf), np.zeros(width + 1)
        for batch in pieces(batches):
            split = packed(batch, "split", np.uint8, 1)[:, 0]
            x, y = packed(batch, "x", np.float64, width), packed(batch, "y", np.float64, 1)
            if not len(split):
                continue
            top = np.maximum(top, np.append(np.abs(x).max(0), np.abs(y).max()))
            mine = x[split == 0]
            if len(mine):
                low[:-1], high[:-1] = np.minimum(low[:-1], mine.min(0)), np.maximum(high[:-1], mine.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(low), pa.array(high), pa.array(top)], ["i", "low", "high", "top"])

    told = raw.mapInArrow(run, "i long, low double, high double, top double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("top").alias("top"))
    out = [(0.0, 0.0, 0.0)] * (width + 1)
    for r in told.collect():
        spread = r["low"] <= r["high"]
        out[r["i"]] = (r["low"] if spread else 0.0, r["high"] if spread else 0.0, r["top"])
    return out


def targets(raw: DataFrame, n_y: int) -> DataFrame:
    """(part, y) row by row; y is an array where a row has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            y = packed(batch, "y", np.float64, n_y)
            told = pa.array(y[:, 0]) if n_y == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * n_y, pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(packed(batch, "split", np.uint8, 1)[:, 0].astype(np.int32)), told], ["part", "y"])

    return raw.select("split", "y").mapInArrow(run, f"part int, y {'double' if n_y == 1 else 'array<double>'}")


def quantized(x: np.ndarray, scale: float) -> np.ndarray:
    """x * scale, rounded half up and held to 32 bits."""
    return np.minimum(np.floor(np.clip(x * scale, INT32_MIN, INT32_MAX) + 0.5), INT32_MAX)


def bins_of(x: np.ndarray, ranges: Sequence[tuple[float, float]], bins: int, thresholds: Sequence[Sequence[float]] | None) -> np.ndarray:
    """The bin of each value: among equal ones from the lowest on, or the number of thresholds below it."""
    out = np.full(x.shape, NO_BIN, np.uint16)
    if thresholds is not None:
        for i, cuts in enumerate(thresholds):
            if ranges[i][1] > 0:
                out[:, i] = np.searchsorted(np.asarray(cuts, np.float64), x[:, i], "left")
        return out
    low, width = (np.array([r[i] for r in ranges], np.float64) for i in (0, 1))
    spread = np.flatnonzero(width > 0)
    out[:, spread] = np.clip(np.floor((x[:, spread] - low[spread]) / width[spread] * bins), 0, bins - 1)
    return out


def with_bins(raw: DataFrame, scale: int, ranges: Sequence[tuple[float, float]], bins: int, thresholds: Sequence[Sequence[float]] | None, base: Sequence[int], n_y: int, quantize_y: bool) -> DataFrame:
    """Blocks with quantised and binned features and starting scores."""
    width = len(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x, y = packed(batch, "x", np.float64, width), packed(batch, "y", np.float64, n_y)
            sizes = batch.column("n").to_numpy()
            ends = np.cumsum(sizes)[:-1]
            xq, yq = quantized(x, scale).astype(np.int32), (quantized(y, scale) if quantize_y else y).astype(np.int64)
            score = np.tile(np.array(base, np.float64), (len(x), 1))
            cells = [pa.array([part.tobytes() for part in np.split(v, ends)] if len(sizes) else [], pa.binary()) for v in (xq, bins_of(x, ranges, bins, thresholds), yq, score)]
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("split"), *cells], ["n", "split", "xq", "bins", "y", "score"])

    return raw.mapInArrow(run, BLOCK_SCHEMA)
