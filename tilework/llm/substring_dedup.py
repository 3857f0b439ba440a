"""Substring deduplication with a count-min prefilter.

Every word covered by a window of WINDOW words is removed if the window's
words also start in a document with a smaller id.

1. One scan hashes each text's words. Each window is filed under the least
   hash of the GRAM-word runs inside it: equal windows are filed alike, and a
   run of neighbouring windows shares one file key, about one per 18 words.
2. Count-min rows: the keys of each document are counted in hashed cells, one
   row after the other. Cells only overestimate, so a window that occurs in
   two documents always has a key whose cells say two or more. Spark sums the
   cells of each task before the shuffle and the sums after it, so the sketch
   is spread over the executors and grows with the input instead of filling
   up; each row counts only what the rows before it let through.
3. A second scan of the documents with such keys takes their windows filed
   under them, and these are grouped exactly by two independent 64-bit hashes
   to find the smallest id.
4. Runs of removed windows go back to their texts.

Copies of a whole text are settled first: all of a copy's windows start in
the smallest of the copies, so the others take no part in steps 2 to 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import discard, id_order, portions, rolling, settle, table, texts, word_bounds, word_hashes

WINDOW, GRAM = 50, 16
#: Rows of the sketch, and cells of a row for each key counted in it.
DEPTH, CELLS = 2, 8
#: Ids up to which a set of documents is broadcast (24 bytes each).
BROADCAST_IDS = 1_000_000
#: Rows from which a key is hot; there are at most rows / HOT such keys, and they are broadcast.
HOT = 100_000
KEY = ["o", "tk"]
_STEPS = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)


def window_keys(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of words the least gram hash inside it."""
    g = rolling(h, gram, _STEPS[0], 21)
    span = window - gram + 1
    width = 1
    while width * 2 <= span:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    rest = span - width
    return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


def _hashed(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\n".join(part), np.uint8)
    start, end = word_bounds(buf)
    first = np.cumsum([0] + [len(r) + 1 for r in part])
    return word_hashes(buf, start, end, 31), np.searchsorted(start, first)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def survey(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """o, tk, s1, s2 (hashes of the word sequence), n_words, whole_sha256, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, n_words, sha, keys = [], [], [], [], []
            for _, part in portions(texts(batch, "text")):
                h, first = _hashed(part)
                k = window_keys(h, window, gram) if len(h) >= window else h[:0]
                for t, text in enumerate(part):
                    a, b = first[t], first[t + 1]
                    digest = hashlib.sha256(b" ".join(text.split()))
                    sha.append(digest.hexdigest())
                    s1.append(int.from_bytes(digest.digest()[:8], "little", signed=True))
                    s2.append(int.from_bytes(digest.digest()[8:16], "little", signed=True))
                    n_words.append(int(b - a))
                    keys.append(np.unique(k[a : b - window + 1]).view(np.int64) if b - a >= window else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("o"), batch.column("tk"), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", *KEY, "s1", "s2", "n_words", "whole_sha256", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, o long, tk long, s1 long, s2 long, n_words long, whole_sha256 string, keys array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", id_order(docs).alias("o"), F.xxhash64("text").alias("tk"), "text")


def met(rows: DataFrame, keys: DataFrame, on: list[str], hot: int = HOT) -> DataFrame:
    """rows joined with keys (whose n counts the rows of each), without n.

    A boilerplate passage may be the key of a large share of the rows: keys of
    more than ``hot`` rows are met by broadcast, the others in a shuffle.
    """
    large = keys.filter(F.col("n") > hot).drop("n")
    out = rows.join(keys.filter(F.col("n") <= hot).drop("n"), on)
    return out if large.isEmpty() else out.unionByName(rows.join(F.broadcast(large), on))


def sketch_filter(keys: DataFrame, depth: int = DEPTH, cells: int = CELLS) -> DataFrame:
    """The (o, tk, key) rows whose key no row of the count-min sketch rules out.

    A task counts its keys by cell, which is its partition's sketch; the
    sketches are merged by adding up their cells.
    """
    for row in range(depth):
        width = max(1024, cells * keys.count())
        dealt = keys.withColumn("cell", F.pmod(F.xxhash64(F.lit(row), "key"), F.lit(width)))
        several = settle(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"), f"sketch_{row}")
        kept = settle(met(dealt, several, ["cell"]).drop("cell"), f"keys_{row}")
        discard(several, *([keys] if row else []))
        keys = kept
    return keys


def _with(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted (o, tk), with what wanted says of them."""
    ids = wanted.select(*KEY)
    few = ids.count() <= BROADCAST_IDS
    rows = _keyed(docs).drop("doc_id")
    # Few enough: the others are left out before the texts are shuffled.
    return (rows.join(F.broadcast(ids), KEY, "left_semi") if few else rows).join(wanted, KEY)


def windows(docs: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """h1, h2, o, tk, start of each window filed under a wanted key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, tk = batch.column("o").to_numpy(), batch.column("tk").to_numpy()
            wanted = batch.column("wanted").to_pylist()
            for i, part in portions(texts(batch, "text")):
                h, first = _hashed(part)
                if len(h) < window:
                    continue
                k = window_keys(h, window, gram).view(np.int64)
                h1, h2 = rolling(h, window, _STEPS[1], 41), rolling(h, window, _STEPS[2], 42)
                at, text = [], []
                for t in range(len(part)):
                    a, b = int(first[t]), int(first[t + 1]) - window + 1
                    if b > a:
                        at.append(a + np.flatnonzero(np.isin(k[a:b], np.array(wanted[i + t], np.int64))))
                        text.append(np.full(len(at[-1]), t))
                if at:
                    at, text = np.concatenate(at), np.concatenate(text)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(h1[at]), _signed(h2[at]), pa.array(o[i + text]), pa.array(tk[i + text]), pa.array((at - first[text]).astype(np.int32))],
                        ["h1", "h2", *KEY, "start"],
                    )

    return _with(docs, wanted).select(*KEY, "text", "wanted").mapInArrow(run, "h1 long, h2 long, o long, tk long, start int")


def removals(docs: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    """o, tk, n_removed, kept_sha256, kept for texts with removed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, sha, kept = [], [], []
            for text, begins in zip(texts(batch, "text"), batch.column("starts").to_pylist()):
                all_words = text.split()
                mark = np.zeros(len(all_words) + 1, np.int64)
                begins = np.unique(np.array(begins, np.int64))
                mark[begins] += 1
                mark[begins + window] -= 1
                gone = np.cumsum(mark)[:-1] > 0
                left = b" ".join(w for w, g in zip(all_words, gone.tolist()) if not g)
                n_removed.append(int(gone.sum())), sha.append(hashlib.sha256(left).hexdigest()), kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("o"), batch.column("tk"), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                [*KEY, "n_removed", "kept_sha256", "kept"],
            )

    return _with(docs, starts).select(*KEY, "text", "starts").mapInArrow(run, "o long, tk long, n_removed long, kept_sha256 string, kept string")


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, depth: int = DEPTH, keep_texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    With keep_texts also ``kept``, the words left, joined by one space (null
    where nothing was removed: the text is left as it is). Null and empty
    texts have no words. A null id counts as larger than any other. Rows with
    one id are not smaller than each other, so of equal ids none loses words
    to the other; repeated rows get the same result. An empty table gives no
    rows; extra columns are not read. Ids that are no whole numbers raise
    ValueError.
    """
    rows = settle(survey(docs, window, gram), "survey")
    firsts = rows.groupBy("s1", "s2").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = settle(firsts.drop("n"), "firsts")
    narrow = rows.filter(F.col("n_words") >= window).select(*KEY, "s1", "s2")
    copies = settle(narrow.join(firsts, ["s1", "s2"]).filter("o > first").select(*KEY).distinct(), "copies")
    few = copies.count() <= BROADCAST_IDS
    alone = rows.join(F.broadcast(copies) if few else copies, KEY, "left_anti")
    keys = settle(alone.select(*KEY, F.explode("keys").alias("key")), "keys")
    passed = sketch_filter(keys, depth)
    wanted = settle(passed.groupBy(*KEY).agg(F.collect_set("key").alias("wanted")), "wanted")
    discard(keys, passed)
    found = settle(windows(docs, wanted, window, gram), "windows")
    smallest = found.groupBy("h1", "h2").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last")
    smallest = settle(smallest.drop("last"), "smallest")
    later = met(found, smallest, ["h1", "h2"]).filter("o > first")
    starts = settle(later.groupBy(*KEY).agg(F.collect_set("start").alias("starts")), "starts")
    discard(wanted, found, smallest)
    cut = removals(docs, starts, window).dropDuplicates(KEY)
    if not keep_texts:
        cut = cut.drop("kept")
    copy = copies.withColumn("copy", F.lit(True))
    out = rows.drop("keys").join(F.broadcast(copy) if few else copy, KEY, "left").join(cut, KEY, "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce(F.col("n_removed"), F.lit(0)))
    sha = F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce(F.col("kept_sha256"), F.col("whole_sha256")))
    out = out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), sha.alias("kept_sha256"), *([F.when(F.col("copy"), "").otherwise(F.col("kept")).alias("kept")] if keep_texts else []))
    return out


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows that start in an earlier one."""
    return deduplicate(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)
), smallest AS (
  SELECT s, min(doc_id) AS first FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN smallest USING (s) WHERE first < win.doc_id
  )
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
