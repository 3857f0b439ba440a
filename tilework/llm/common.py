"""What the text operators share: tables, written stages, word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.sources import shared
from tilework.sources.shared import discard  # noqa: F401  for the operators

#: Rows of texts in one Arrow batch; Spark's default of 10,000 is for narrow rows.
BATCH_ROWS = 2000
#: Bytes of such a batch; a batch is held by Spark and by the Python worker.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Keep the batches of Arrow maps small in this session, unless they were set to be smaller."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if spark.conf.get(_BYTES) == "67108864b":  # Spark's own
        spark.conf.set(_BYTES, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str, rows_a_file: int = 0) -> DataFrame:
    """shared.settle() with the small batches that texts need."""
    small_batches(df.sparkSession)
    return shared.settle(df, label, rows_a_file)


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the column as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))) % n


def id_order(df: DataFrame) -> Column:
    """doc_id as BIGINT by size; a null id is larger than all. Ids are whole numbers."""
    kind = df.schema["doc_id"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"doc_id must be a whole number of 64 bits at most, not {kind}")
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def portions(rows: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts in lists of about ``most`` bytes, with where each begins."""
    first, total = 0, 0
    for i, row in enumerate(rows):
        total += len(row) + 1
        if total >= most:
            yield first, rows[first : i + 1]
            first, total = i + 1, 0
    if first < len(rows):
        yield first, rows[first:]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches cut anew so that no group is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy()
        if not len(values):
            continue
        last = int(np.flatnonzero(values != values[-1])[-1]) + 1 if values[0] != values[-1] else 0
        if held and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(buf: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are not gaps."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~gap[buf]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def scramble(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mixing of 64-bit values (shift-multiply finaliser)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, n: int, step: int, salt: int = 0) -> np.ndarray:
    """A hash of each n consecutive values (they may cross texts).

    Polynomials of doubled length are put together, so it takes log n passes.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    out, done, part, width = None, 0, h, 1
    while True:
        if n & width:
            piece = part[done : done + size]
            out = piece if out is None else out * np.uint64(pow(step, width, 1 << 64)) + piece
            done += width
        width *= 2
        if width > n:
            return scramble(out, salt)
        half = width // 2
        part = part[:-half] * np.uint64(pow(step, half, 1 << 64)) + part[half:]


_LETTER = scramble(np.arange(256, dtype=np.uint64), 7)
_POWERS = powers(0x5851F42D4C957F2D, 1 << 12)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes [start, end), all at once."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    longest = int(length.max())
    table = _POWERS if longest <= len(_POWERS) else powers(0x5851F42D4C957F2D, longest)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    within = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
    part = table[within]
    part *= _LETTER[buf[np.repeat(start.astype(np.int32), length) + within]]
    return scramble(np.add.reduceat(part, first) + length.astype(np.uint64), salt)
