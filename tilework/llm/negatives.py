"""Hard-negative mining by a secondary-sort shuffle.

Rows and anchors meet in blocks of bounded size, as the cells of a grid over
tasks; a cell scores its pairs by one matrix product and hands on only what
can be among the first of its anchor: first the positives, then, inside the
windows that these open, the negatives. The pair scores that are left are
packed into (anchor, descending score, kind, id) keys and sorted by
``repartitionAndSortWithinPartitions``; an iterator over a sorted partition
opens a window at each positive and emits the negatives that follow. It holds
the open windows of one anchor, a handful of numbers, and never its rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.llm.common import discard, settle, table

#: Rows and anchors of a cell of the grid.
ROWS, ANCHORS = 8192, 2048
#: Scores beyond 64 bits are held at these.
LEAST, MOST = -(2**63) + 1, 2**63 - 1
LEAST_ID = -(2**63)
POSITIVE, NEGATIVE = 0, 1
KEY = struct.Struct(">QQBQ")
PAIRS = "key binary, anchor long, anchor_id long, score long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(rows: DataFrame) -> DataFrame:
    """(row, id, label, q): rows that take part, components as whole numbers, labels as they are."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    whole = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(finite)
    return whole.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * 256)).alias("q")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows; missing components at the end are 0."""
    flat, sizes = pc.list_flatten(column).to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both; floating point where it is exact, as it is faster."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a], object)
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def pack(anchor: int, score: int, kind: int, other: int) -> bytes:
    """A key whose bytes sort by anchor, score from the highest, positives before negatives, id."""
    return KEY.pack(anchor, MOST - score, kind, other - LEAST_ID)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, other = KEY.unpack(key)
    return anchor, MOST - score, kind, other + LEAST_ID


def positives_of(most: int):
    """For a cell: the first rows of the anchor's own label, without the anchor's own row."""

    def choose(anchor: dict, line: np.ndarray, labels: np.ndarray, own: np.ndarray) -> np.ndarray:
        return _first(line, np.flatnonzero((labels == anchor["label"]) & (own != anchor["row"])), most)

    return choose


def negatives_of(most: int, share: tuple[int, int]):
    """For a cell: the first rows of other labels inside each of the anchor's windows."""

    def choose(anchor: dict, line: np.ndarray, labels: np.ndarray, own: np.ndarray) -> np.ndarray:
        other, found = labels != anchor["label"], []
        for score in set(anchor["windows"]):
            least = -(-share[0] * score // share[1])  # as whole numbers, rounded up
            found.append(_first(line, np.flatnonzero(other & (line <= score) & (line >= max(least, LEAST))), most) if least <= score else [])
        return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)

    return choose


def _first(line: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The n places of the highest scores; of equal ones the earlier, which have the smaller ids."""
    if len(places) > n:
        places = places[line[places] >= np.partition(line[places], len(places) - n)[len(places) - n]]
    return places[np.argsort(-line[places], kind="stable")][:n]


def _cell(anchors: pa.Table, rows: pa.Table, kind: int, choose, step: int = 256) -> pa.Table:
    """The pairs of a cell that ``choose`` keeps of each anchor, under their keys."""
    rows = rows.take(pa.array(np.argsort(rows.column("id").to_numpy(), kind="stable")))
    ids, labels, own = (rows.column(c).to_numpy() for c in ("id", "label", "row"))
    width = max([pc.max(pc.list_value_length(t.column("q"))).as_py() or 0 for t in (rows, anchors)])
    q, told = _matrix(rows.column("q"), width), anchors.drop_columns("q").to_pylist()
    keys, of, of_id, scores = [], [], [], []
    for at in range(0, len(told) if len(rows) else 0, step):
        for anchor, line in zip(told[at : at + step], products(_matrix(anchors.column("q").slice(at, step), width), q)):
            for i in choose(anchor, line, labels, own).tolist():
                keys.append(pack(anchor["row"], int(line[i]), kind, int(ids[i])))
                of.append(anchor["row"]), of_id.append(anchor["id"]), scores.append(int(line[i]))
    return pa.table([pa.array(keys, pa.binary()), *[pa.array(c, pa.int64()) for c in (of, of_id, scores)]], ["key", "anchor", "anchor_id", "score"])


def meet(rows: DataFrame, anchors: DataFrame, kind: int, choose, size: tuple[int, int]) -> DataFrame:
    """All rows against all anchors in cells; a row is copied once for each block of anchors."""
    n_rows, n_anchors = max(1, -(-size[0] // ROWS)), max(1, -(-size[1] // ANCHORS))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select(*[F.col(c).alias(c) for c in df.columns], F.pmod(F.xxhash64("row"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    left = dealt(anchors, "a", n_anchors, "r", n_rows).groupBy("a", "r")
    right = dealt(rows, "r", n_rows, "a", n_anchors).select("a", "r", "row", "id", "label", "q").groupBy("a", "r")
    drop = lambda t: t.drop_columns(["a", "r"])
    return left.cogroup(right).applyInArrow(lambda x, y: _cell(drop(x), drop(y), kind, choose), PAIRS)


def windows(sorted_pairs: Iterator[tuple[bytes, int]], most: int, share: tuple[int, int]) -> Iterator[tuple]:
    """Walk keys in their order: a positive opens a window, each negative goes to the open windows that it is in."""
    current, open_windows = None, []
    for key, anchor_id in sorted_pairs:
        anchor, score, kind, other = unpack(key)
        if anchor != current:
            current, open_windows = anchor, []
        if kind == POSITIVE:
            open_windows.append([other, score, 0])
            continue
        for window in open_windows:
            if window[2] < most and share[0] * window[1] <= share[1] * score:
                window[2] += 1
                yield anchor_id, window[0], window[2], other, window[1], score


def mine(rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding; ``anchors`` is a condition on ``id``, the
    vec_id. Rows with a null id, label or vector or with a component that is
    null or not finite take no part. Components are floor(256 x); a shorter
    vector counts as 0 where it ends, and scores are held inside 64 bits.
    Repeated rows each take part: they are anchors, positives and negatives of
    their own, and only an anchor's own row is not its positive. Equal scores
    go by the smaller id, and a negative may have its positive's score. An
    empty table, or one with a single label, gives no rows. Other columns are
    not read.
    """
    spark = rows.sparkSession
    ready = settle(prepared(rows), "vectors")  # row numbers stay as drawn
    asking = ready.filter(anchors)
    size = ready.count(), asking.count()
    order = W.partitionBy("anchor").orderBy("key")
    found = meet(ready, asking, POSITIVE, positives_of(positives), size)
    first = settle(found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= positives).drop("_r"), "positives")
    opened = first.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("windows"))  # a few numbers each
    hard = meet(ready, asking.join(opened, "row"), NEGATIVE, negatives_of(negatives, share), size)
    pairs = settle(first.unionByName(hard).select("key", "anchor_id"), "pairs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = pairs.rdd.map(lambda r: (bytes(r[0]), r[1]))
    sorted_pairs = keyed.repartitionAndSortWithinPartitions(parts, lambda key: int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 % (1 << 64) >> 20)
    told = sorted_pairs.mapPartitions(lambda part: windows(part, negatives, share))
    out = settle(spark.createDataFrame(told, OUT), "negatives")
    discard(ready, first, pairs)
    return out


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hard negatives for each of the first five positives of every hundredth vector.

    Nulls and components that are not finite take a row out; labels of every
    seventh vector are moved on by one.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), "id % 100 = 0")


OP11_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""
