"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is the value of its bytes as a polynomial at a fixed
point, modulo two primes. Chunks are hashed on their own, and neighbours
combine as ``left * base**len(right) + right``, so the pieces of a huge text
are hashed side by side and in any grouping. Texts with equal fingerprints and
lengths are then compared byte by byte, chunk against chunk: for each chunk
position the smallest and the largest chunk of the group must be the same.
Spark folds both on the map side, so a group of any size sends one chunk per
task. Should a group hold different texts, it is split by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import UPPER_TO_LOWER, settle, table, texts

PRIMES = (2147483629, 2147483587)
BASES = (1103515245, 69069069)
CHUNK = 1 << 15
FP = ["fp1", "fp2", "n_bytes"]
#: Groups of equal fingerprints up to which their keys (24 bytes each) are broadcast.
BROADCAST_GROUPS = 200_000


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**(n-1) .. base**0 modulo prime."""
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], np.uint64)


def chunk_hashes(data: bytes, primes=PRIMES, chunk: int = CHUNK) -> list[tuple[tuple[int, ...], int]]:
    """(hash under each prime, length) of each chunk, all chunks at once."""
    buf = np.frombuffer(data, np.uint8)
    full = len(buf) // chunk
    out: list[tuple[tuple[int, ...], int]] = []
    tables = [_table(b, p, chunk) for b, p in zip(BASES, primes)]
    if full:
        grid = buf[: full * chunk].reshape(full, chunk).astype(np.uint64) + np.uint64(1)
        sums = [(grid * t).sum(axis=1) % np.uint64(p) for t, p in zip(tables, primes)]
        out = [(tuple(int(s[i]) for s in sums), chunk) for i in range(full)]
    if len(buf) % chunk:
        tail = buf[full * chunk :].astype(np.uint64) + np.uint64(1)
        out.append((tuple(int((tail * t[-len(tail) :]).sum() % np.uint64(p)) for t, p in zip(tables, primes)), len(tail)))
    return out


_TABLES: dict[tuple[int, int, int], np.ndarray] = {}


def _table(base: int, prime: int, chunk: int) -> np.ndarray:
    if (base, prime, chunk) not in _TABLES:
        _TABLES[base, prime, chunk] = _powers(base, prime, chunk)
    return _TABLES[base, prime, chunk]


def combine(left, right, primes=PRIMES):
    """The fingerprint of two neighbouring pieces from theirs."""
    (a, n), (b, m) = left, right
    return tuple((x * pow(base, m, p) + y) % p for x, y, base, p in zip(a, b, BASES, primes)), n + m


def fingerprint(data: bytes, primes=PRIMES, chunk: int = CHUNK):
    whole = ((0,) * len(primes), 0)
    for piece in chunk_hashes(data, primes, chunk):
        whole = combine(whole, piece, primes)
    return whole


def fingerprints(docs: DataFrame, primes=PRIMES) -> DataFrame:
    """doc_id, fingerprint, length and SHA-256 of each text in lower case (A-Z only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [t.translate(UPPER_TO_LOWER) for t in texts(batch, "text")]
            prints = [fingerprint(t, primes) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([p[0][0] for p in prints], pa.int64()),
                    pa.array([p[0][1] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in rows], pa.string()),
                ],
                ["doc_id", *FP, "text_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp1 long, fp2 long, n_bytes long, text_sha256 string")


def chunks(docs: DataFrame, primes=PRIMES, chunk: int = CHUNK) -> DataFrame:
    """The fingerprint of each text with its chunks: FP, part, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, part, data = [], [], [], [], []
            for t in (t.translate(UPPER_TO_LOWER) for t in texts(batch, "text")):
                (x, y), length = fingerprint(t, primes)
                for at in range(0, max(length, 1), chunk):
                    a.append(x), b.append(y), n.append(length), part.append(at // chunk), data.append(t[at : at + chunk])
            longs = [pa.array(v, pa.int64()) for v in (a, b, n, part)]
            yield pa.RecordBatch.from_arrays([*longs, pa.array(data, pa.binary())], [*FP, "part", "bytes"])

    return docs.select("text").mapInArrow(run, "fp1 long, fp2 long, n_bytes long, part long, bytes binary")


def collided(docs: DataFrame, groups: DataFrame, primes=PRIMES) -> DataFrame:
    """Fingerprints of groups whose texts are not all the same."""
    several = groups.filter("group_size > 1").select(*FP)
    if several.count() <= BROADCAST_GROUPS:
        several = F.broadcast(several)
    parts = chunks(docs, primes).join(several, FP, "left_semi")
    compared = parts.groupBy(*FP, "part").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    return compared.filter("low <> high").select(*FP).distinct()


def exact_groups(docs: DataFrame, primes=PRIMES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. The row with the largest doc_id of a group stays. Of rows repeated
    with that same id one stays. A null id is smaller than any other; a group
    that has only null ids keeps one of its rows and has a null keep_id.
    Extra columns are not read; an empty table gives no rows.
    """
    prints = settle(fingerprints(docs, primes).groupBy("doc_id", *FP, "text_sha256").agg(F.count(F.lit(1)).alias("alike")), "fingerprints")
    by_print = settle(prints.groupBy(*FP).agg(F.sum("alike").alias("group_size")), "groups")
    mixed = settle(collided(docs, by_print, primes), "collided")
    prints = prints.join(mixed.withColumn("mixed", F.lit(True)), FP, "left")
    prints = prints.withColumn("split", F.when(F.col("mixed"), F.col("text_sha256")).otherwise(F.lit(""))).drop("mixed")
    groups = settle(prints.groupBy(*FP, "split").agg(F.max("doc_id").alias("keep_id"), F.sum("alike").alias("group_size")), "classes")
    joined = prints.join(groups, [*FP, "split"])
    out = joined.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))).alias("turn"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts and the row that stays."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), g AS (
  SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY low
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.low) AS text_sha256
FROM t JOIN g ON t.low = g.low
"""
