"""Benchmark decontamination by winnowing.

Of every WINDOW - GRAM + 1 consecutive word k-grams the one with the smallest
hash is a fingerprint (all of them on a tie), on both sides. Any WINDOW words
that a document shares with a benchmark item hold a fingerprint of both, so
meeting fingerprints miss no shared span. Each meeting is then extended: the
windows around it are compared with the item's windows, and words inside a
shared window are hit. Items shorter than a window are looked for whole.

The benchmark is the small side. It is dealt into blocks of at most
BLOCK_BYTES of text (by measured size); each block is broadcast and joined to
the documents' fingerprints inside one scan of them. A benchmark of one block
(the usual case) needs no shuffle at all; with more blocks, the hits of each
document are gathered by the document's id and text hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.llm.common import UPPER_TO_LOWER, portions, rolling, settle, table, texts, word_bounds, word_hashes

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 32 << 20

_GAP = np.zeros(256, bool)
_GAP[list(range(0x30)) + list(range(0x3A, 0x61)) + list(range(0x7B, 0x80))] = True
_STEP = 0x2545F4914F6CDD1D
_FLAG_BITS = 22


def words(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts in a row, and where each text's begin."""
    data = b"\0".join(rows).translate(UPPER_TO_LOWER)
    buf = np.frombuffer(data, np.uint8)
    start, end = word_bounds(buf, _GAP)
    first = np.cumsum([0] + [len(r) + 1 for r in rows])
    return word_hashes(buf, start, end, 11), np.searchsorted(start, first)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (they may cross texts)."""
    return rolling(h, n, _STEP, n)


def inside(first: np.ndarray, total: int, n: int) -> np.ndarray:
    """Whether the n words from each place lie in one text."""
    if total < n:
        return np.zeros(0, bool)
    good = np.ones(total - n + 1, bool)
    for b in first[1:-1][(first[1:-1] > 0) & (first[1:-1] < total)]:
        good[max(0, b - n + 1) : b] = False
    return good


def winnow(grams: np.ndarray, good: np.ndarray, span: int) -> np.ndarray:
    """Places of fingerprints: grams that are the least of some span of them.

    Grams across texts count as largest; a text with fewer grams than the
    span keeps none here (it holds no whole window).
    """
    if len(grams) < span:
        return np.zeros(0, np.int64)
    g = np.where(good, grams, np.uint64(0xFFFFFFFFFFFFFFFF))
    least = g[: len(g) - span + 1].copy()
    for j in range(1, span):
        np.minimum(least, g[j : len(g) - span + 1 + j], out=least)
    chosen = np.zeros(len(g), bool)
    for j in range(span):
        chosen[j : len(g) - span + 1 + j] |= g[j : len(g) - span + 1 + j] == least
    return np.flatnonzero(chosen & good)


class Keys:
    """Sorted 64-bit keys with a bit table in front of the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.flags = np.zeros(1 << _FLAG_BITS, bool)
        self.flags[(self.keys >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are keys, and which keys."""
        at = np.flatnonzero(self.flags[(h >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, h[at]), max(len(self.keys) - 1, 0))
        good = self.keys[k] == h[at] if len(self.keys) else np.zeros(0, bool)
        return at[good], k[good]


class Benchmark:
    """Fingerprints and windows of a block of items."""

    def __init__(self, items: list[tuple[object, bytes]]):
        h, first = words([t for _, t in items])
        self.ids = [None if i is None else str(i) for i, _ in items]
        size = np.diff(first)
        owner = np.repeat(np.arange(len(items)), size)
        grams = gram_hashes(h, GRAM)
        self.prints = Keys(grams[winnow(grams, inside(first, len(h), GRAM), WINDOW - GRAM + 1)])
        #: window length -> keys and (key, item) pairs sorted by key
        self.windows: dict[int, tuple[Keys, np.ndarray, np.ndarray]] = {}
        for n in sorted({WINDOW if s >= WINDOW else int(s) for s in size if s}):
            hn, ok = gram_hashes(h, n), inside(first, len(h), n)
            ok &= size[owner[: len(ok)]] >= WINDOW if n == WINDOW else size[owner[: len(ok)]] == n
            keys = Keys(hn[ok])
            pairs = np.unique(np.stack([np.searchsorted(keys.keys, hn[ok]), owner[: len(ok)][ok]], 1), axis=0)
            self.windows[n] = keys, np.searchsorted(pairs[:, 0], np.arange(len(keys.keys) + 1)), pairs[:, 1]

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[str | None]]]:
        """Which words are hit, and the items met by each text."""
        mark = np.zeros(len(h) + 1, np.int64)
        met: dict[int, set] = {}
        for n, (keys, where, items) in self.windows.items():
            if len(h) < n:
                continue
            ok, hn = inside(first, len(h), n), gram_hashes(h, n)
            if n == WINDOW:
                grams = gram_hashes(h, GRAM)
                prints = winnow(grams, inside(first, len(h), GRAM), WINDOW - GRAM + 1)
                meets, _ = self.prints.find(grams[prints])
                around = np.zeros(len(hn), bool)
                for back in range(WINDOW - GRAM + 1):
                    at = prints[meets] - back
                    around[at[(at >= 0) & (at < len(hn))]] = True
                candidates = np.flatnonzero(around & ok)
            else:
                candidates = np.flatnonzero(ok)
            at, key = keys.find(hn[candidates])
            at = candidates[at]
            mark += np.bincount(at, minlength=len(mark))[: len(mark)] - np.bincount(at + n, minlength=len(mark))[: len(mark)]
            text = np.searchsorted(first, at, side="right") - 1
            for t, k in np.unique(np.stack([text, key], 1), axis=0) if len(at) else ():
                met.setdefault(int(t), set()).update(self.ids[i] for i in items[where[k] : where[k + 1]])
        return np.cumsum(mark[:-1]) > 0, met


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in blocks of about ``most`` bytes of text."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    n = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-n // most) if n else 0
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i) for i in range(count)]


def scan(docs: DataFrame, block: Benchmark | None, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_key, n_words, hit word runs (start, end) and items met, a row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_BYTES of text at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch, "text")
            n_words, starts, ends, items = [], [], [], []
            for _, part in portions(rows):
                h, first = words(part)
                hit, met = shared.value.hits(h, first) if shared.value else (np.zeros(len(h), bool), {})
                for t in range(len(first) - 1):
                    turn = np.diff(np.concatenate(([0], hit[first[t] : first[t + 1]].view(np.int8), [0]))) if t in met else np.zeros(0)
                    n_words.append(int(first[t + 1] - first[t]))
                    starts.append(np.flatnonzero(turn == 1)), ends.append(np.flatnonzero(turn == -1))
                    items.append(sorted(x for x in met.get(t, ()) if x is not None))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n_words, pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "text_key", "n_words", "starts", "ends", "items"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return narrow.mapInArrow(run, f"doc_id {kind}, text_key long, n_words long, starts array<long>, ends array<long>, items array<string>")


def hit_runs(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: n_words, n_hit, starts, ends, items.

    starts and ends are runs of hit words (ends exclusive), items the ids met,
    sorted as strings. Null and empty texts have no words; null items and
    items without words meet nothing; an item with a null id hits words but is
    not listed; equal ids count once. An empty benchmark hits nothing. Extra
    columns are not read.
    """
    parts = [scan(docs, Benchmark([(r["item_id"], r["text"].encode()) for r in b.toLocalIterator()])) for b in blocks(benchmark, most)] or [scan(docs, None)]
    if len(parts) == 1:
        return parts[0].withColumn("n_hit", F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)).drop("text_key")
    # Rows alike in id and text meet the same; each block's scan numbers them.
    turn = F.row_number().over(W.partitionBy("doc_id", "text_key").orderBy("n_words"))
    gathered = None
    for part in parts:
        part = settle(part, "hits").withColumn("turn", turn)
        gathered = part if gathered is None else gathered.unionByName(part)
    merged = gathered.groupBy("doc_id", "text_key", "turn").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.aggregate(
        "runs",
        F.array().cast("array<struct<starts:long,ends:long>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= r["starts"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["starts"].alias("starts"), F.greatest(F.element_at(done, -1)["ends"], r["ends"]).alias("ends")))),
        ).otherwise(F.concat(done, F.array(r))),
    )
    merged = merged.withColumn("runs", joined)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["ends"] - r["starts"])
    return merged.select("doc_id", "n_words", F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"), "items", n_hit.alias("n_hit"))


def clean(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that share no window with the benchmark.

    One scan for each block of the benchmark, and no shuffle; between blocks
    the rows that are left are written, so that a task has one block in memory.
    Null and empty texts stay; an empty table gives no rows, an empty benchmark
    leaves all; columns other than text, whatever their names, are carried
    along.
    """
    parts = blocks(benchmark, most)
    for i, part in enumerate(parts):
        docs = _clean_of(docs, Benchmark([(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()]))
        if i + 1 < len(parts):
            docs = settle(docs, f"clean_{i}")
    return docs


def _clean_of(docs: DataFrame, block: Benchmark) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_BYTES of text at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, part in portions(texts(batch, "text")):
                h, first = words(part)
                hit, _ = shared.value.hits(h, first)
                sums = np.concatenate(([0], np.cumsum(hit)))[first]
                keep[i : i + len(part)] = np.diff(sums) == 0
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that it shares with the benchmark."""
    found = hit_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bl AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)
), lens AS (
  SELECT DISTINCT n FROM win
), occ AS (
  SELECT d.doc_id, d.i, d.n, win.item_id
  FROM (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
  ) d JOIN win ON win.n = d.n AND win.s = d.s
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
  coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
