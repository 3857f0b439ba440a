"""Which features an ensemble uses, and what their values are worth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.operators.blocks import quantized
from tilework.operators.model import Ensemble, add_trees, real_splits
from tilework.operators.split import sample_rows

NODE_VISITS = 12_000_000
#: Losses are added up in units of this part.
WHOLE = 1 << 30


def split_usage(nodes: DataFrame) -> DataFrame:
    """(feature, splits, share) of the nodes that really split."""
    counts = real_splits(nodes).groupBy("feature").agg(F.count(F.lit(1)).alias("splits"))
    total = F.broadcast(counts.agg(F.sum("splits").alias("total")))  # one row
    return counts.crossJoin(total).select("feature", "splits", (F.col("splits") / F.col("total")).alias("share"))


def importance_rows(ensemble: Ensemble, most: int = 1024, budget: int = NODE_VISITS) -> int:
    visits = max(1, ensemble.n_features) * max(1, ensemble.n_out * len(ensemble.trees[0]) * ensemble.depth)
    return max(16, min(most, budget // visits))


def donors(ids: Sequence[str], feature: str, seed: int) -> np.ndarray:
    """Whose value each row gets when a feature is shuffled: the rows in the order of a hash of their own."""
    return np.array(sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"{seed + 1}:{feature}:{ids[i]}".encode()).hexdigest(), ids[i])), np.int64)


def row_losses(task: str, score: np.ndarray, y: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss and hits of each row (for labels, the sum over its labels)."""
    if task == "regression":
        return (score[:, 0] / scale - y[:, 0]) ** 2, np.zeros(len(y), np.int64)
    z = score / scale
    if task == "multiclass_classification":
        top = z.max(1)
        truth = z[np.arange(len(z)), y[:, 0].astype(int)]
        return np.minimum(top + np.log(np.exp(z - top[:, None]).sum(1)) - truth, -np.log(1e-12)), (score.argmax(1) == y[:, 0]).astype(np.int64)
    p = np.clip(1 / (1 + np.exp(-np.clip(z, -700, 700))), 1e-12, 1 - 1e-12)
    return -np.where(y == 1, np.log(p), np.log(1 - p)).sum(1), ((z >= 0) == (y == 1)).sum(1).astype(np.int64)


def permutation_importance(df: DataFrame, ensemble: Ensemble, row_id: str, seed: int = 42, max_rows: int = 1024, y: str | None = None, block: int = 256) -> DataFrame:
    """(feature, delta_loss, delta_accuracy) when one feature's values are shuffled among sampled rows.

    The sample is read once and sent to all executors (max_rows rows at most).
    A task's work is a feature and a block of rows, so many features or trees
    spread over all cores and no row is copied for a feature. Losses are added
    up as whole numbers: the result does not depend on how work is dealt.
    """
    spark, task, names = df.sparkSession, ensemble.task, list(ensemble.features)
    target = y or ("labels" if task == "multilabel_classification" else "y")
    told = sample_rows(df.select(row_id, target, *names), row_id, importance_rows(ensemble, max_rows), seed).collect()  # max_rows at most
    ids = [str(r[row_id]) for r in told]
    x = np.array([[r[c] for c in names] for r in told], np.float64).reshape(len(told), len(names))
    truth = np.array([r[target] if isinstance(r[target], list) else [r[target]] for r in told], np.float64).reshape(len(told), -1)
    shared = spark.sparkContext.broadcast((ids, quantized(x, ensemble.scale_q).astype(np.int64), truth, ensemble))
    blocks = max(1, -(-len(told) // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xq, truth, model = shared.value
        for batch in batches:
            out = []
            for unit in batch.column("id").to_pylist():
                feature, at = unit // blocks - 1, unit % blocks * block  # -1: nothing shuffled
                mine = xq[at : at + block].copy()
                if feature >= 0:
                    mine[:, feature] = xq[donors(ids, names[feature], seed)[at : at + block], feature]
                score = add_trees(np.tile(np.array(model.base_q, np.float64), (len(mine), 1)), model.trees, mine, model.depth)
                loss, hits = row_losses(task, score, truth[at : at + block], float(model.scale_q))
                out.append((feature, sum(int(v) for v in np.floor(loss * WHOLE + 0.5)), int(hits.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.int64(), pa.int64()))], ["feature", "loss", "hits"])

    units = (len(names) + 1) * blocks
    each = spark.range(0, units, 1, min(units, spark.sparkContext.defaultParallelism)).mapInArrow(run, "feature int, loss long, hits long")
    sums = each.groupBy("feature").agg(F.sum(F.col("loss").cast("decimal(38,0)")).alias("loss"), F.sum("hits").alias("hits"))
    one = W.partitionBy()  # a row for each feature
    base = lambda c: F.max(F.when(F.col("feature") == -1, F.col(c))).over(one)
    n = max(1, len(told) * (ensemble.n_out if task == "multilabel_classification" else 1))
    loss = ((F.col("loss") - base("loss")) / (WHOLE * n)).cast("double")
    accuracy = F.lit(None).cast("double") if task == "regression" else (F.col("hits") - base("hits")) / n
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("feature") + 1)
    rated = sums.select("feature", loss.alias("delta_loss"), accuracy.alias("delta_accuracy")).filter("feature >= 0")
    return rated.select(named.alias("feature"), "delta_loss", "delta_accuracy")


def rank_features(importance: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """importance (feature, delta_loss, splits) with its place and whether it is useful, harmful or neutral."""
    order = W.orderBy(F.col("delta_loss").desc_nulls_last(), F.col("splits").desc(), "feature")  # one row for each feature
    tag = F.when(F.col("delta_loss") > epsilon, "useful").when(F.col("delta_loss") < -epsilon, "harm").otherwise("neutral")
    return importance.withColumn("place", F.row_number().over(order)).withColumn("tag", tag)


class Moments:
    """Count, means and products about the means of several columns; two of them add up to that of both parts."""

    def __init__(self, width: int):
        self.n, self.mean, self.products = 0, np.zeros(width), np.zeros((width, width))

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        if not n:
            return
        both, gap = self.n + n, mean - self.mean
        self.products = self.products + products + np.outer(gap, gap) * (self.n * n / both)
        self.mean = self.mean + gap * (n / both)
        self.n = both

    def add(self, x: np.ndarray) -> None:
        if len(x):
            mean = x.mean(0)
            self.merge(len(x), mean, (x - mean).T @ (x - mean))

    def pack(self) -> bytes:
        """The means and the upper triangle of the products."""
        return np.concatenate([self.mean, self.products[np.triu_indices(len(self.mean))]]).tobytes()

    def merge_packed(self, n: int, data: bytes) -> None:
        width, values = len(self.mean), np.frombuffer(data, np.float64)
        products = np.zeros((width, width))
        products[np.triu_indices(width)] = values[width:]
        self.merge(n, values[:width], products + np.triu(products, 1).T)

    def correlation(self) -> np.ndarray:
        """Zero where a column does not spread."""
        spread = np.sqrt(np.diag(self.products))
        rate = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
        return self.products * np.outer(rate, rate)


def moments(df: DataFrame, features: Sequence[str], groups: int = 64) -> Moments:
    """The moments of all rows whose features are finite numbers; other rows are left out.

    One Arrow map, whatever the number of features; tasks' results are merged
    in groups, and the driver gets ``groups`` of them at most.
    """
    width = len(features)
    plain = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])

    def told(part: int, m: Moments) -> pa.Table:
        return pa.table([pa.array([part], pa.int32()), pa.array([m.n], pa.int64()), pa.array([m.pack()], pa.binary())], ["part", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(width)
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            own.add(x[np.isfinite(x).all(1)])
        yield from told(TaskContext.get().partitionId() % groups, own).to_batches()

    def merge(key, table):
        own = Moments(width)
        for n, data in zip(table.column("n").to_pylist(), table.column("data").to_pylist()):
            own.merge_packed(n, data)
        return told(key[0].as_py(), own)

    schema = "part int, n long, data binary"
    whole = Moments(width)
    for r in sorted(plain.mapInArrow(run, schema).groupBy("part").applyInArrow(merge, schema).collect(), key=lambda r: r["part"]):
        whole.merge_packed(r["n"], bytes(r["data"]))
    return whole


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(left, right, r) of all pairs of features over the rows where all are finite numbers."""
    r = moments(df, features).correlation()
    pairs = [(a, b, float(r[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if i < j]
    return df.sparkSession.createDataFrame(pairs, "left string, right string, r double")


def pca3(df: DataFrame, features: Sequence[str], row_id: str, sample: int = 2000, seed: int = 42) -> DataFrame:
    """(row_id, pc1, pc2, pc3) of a sample, features standardised (those without spread stay 0).

    Means, spreads and components are those of all rows without a missing
    value; only the rows that are returned are sampled, and one with a missing
    value has null components. The sign of a component is such that its
    largest loading is positive.
    """
    told = moments(df, features)
    _, vectors = np.linalg.eigh(told.correlation())
    load = vectors[:, ::-1][:, :3]
    load = load * np.where(load[np.abs(load).argmax(0), np.arange(load.shape[1])] < 0, -1.0, 1.0)
    spread = np.sqrt(np.diag(told.products) / max(told.n - 1, 1))
    rate, mean = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0), told.mean
    rows = sample_rows(df.select(row_id, *features), row_id, sample, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(len(features))], 1)
            c = np.zeros((len(x), 3))
            c[:, : load.shape[1]] = ((x - mean) * rate) @ load
            c[~np.isfinite(x).all(1)] = np.nan
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c[:, i], from_pandas=True) for i in range(3)]], [row_id, "pc1", "pc2", "pc3"])

    kind = df.schema[row_id].dataType.simpleString()
    return rows.mapInArrow(run, f"`{row_id}` {kind}, pc1 double, pc2 double, pc3 double")


def scatter3(df: DataFrame, row_id: str, cols: Sequence[str], target: str, k: int = 2000, seed: int = 42) -> DataFrame:
    """A sample of three features with the target and the row's id."""
    return sample_rows(df, row_id, max(500, min(10_000, k)), seed).select(row_id, *[F.col(c).cast("double").alias(a) for c, a in zip(cols, ("x", "y", "z"))], F.col(target).alias("target"))
