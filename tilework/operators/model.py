"""Ensembles: trees in arrays, tables of them, traversal of a block of rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.functions import INT32_MAX

TREE_SCHEMA = "model_id string, out int, tree int, feat array<int>, thr array<int>, leaf array<int>"
HEAD_SCHEMA = "model_id string, version int, n_features int, depth int, n_trees long, n_out int, scale_q long, base_q array<int>, task string"


@dataclass
class Tree:
    """A complete binary tree in heap order; a node that is not split sends all rows left."""

    feat: np.ndarray
    thr: np.ndarray
    leaf: np.ndarray

    @classmethod
    def blank(cls, depth: int) -> Tree:
        n = (1 << depth) - 1
        return cls(np.zeros(n, np.int32), np.full(n, INT32_MAX, np.int32), np.zeros(n + 1, np.int32))


@dataclass
class Ensemble:
    """Trees of one model by output, its starting scores and scale."""

    task: str
    n_features: int
    depth: int
    scale_q: int
    base_q: list[int]
    trees: list[list[Tree]]  # by output
    model_id: str = "model"
    labels: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)

    @property
    def n_out(self) -> int:
        return len(self.base_q)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """One header row, and a row for each tree."""
        head = [(self.model_id, 1 if self.n_out == 1 else 2, self.n_features, self.depth, len(self.trees[0]), self.n_out, self.scale_q, [int(b) for b in self.base_q], self.task)]
        rows = [(self.model_id, k, t, tree.feat.tolist(), tree.thr.tolist(), tree.leaf.tolist()) for k, trees in enumerate(self.trees) for t, tree in enumerate(trees)]
        return spark.createDataFrame(head, HEAD_SCHEMA), spark.createDataFrame(rows, TREE_SCHEMA)


def leaf_of(tree: Tree, x: np.ndarray, depth: int) -> np.ndarray:
    """Place among the leaves of each row of quantised features."""
    if not depth:
        return np.zeros(len(x), np.int64)
    at = 1 + (x[:, tree.feat[0]] > tree.thr[0]).astype(np.int64)
    rows = np.arange(len(x))
    for _ in range(depth - 1):
        at = 2 * at + 1 + (x[rows, tree.feat[at]] > tree.thr[at])
    return at - ((1 << depth) - 1)


def add_trees(score: np.ndarray, trees: list[list[Tree]], x: np.ndarray, depth: int) -> np.ndarray:
    """score (rows, outputs) with the trees' leaves added."""
    for k, own in enumerate(trees):
        for tree in own:
            score[:, k] += tree.leaf[leaf_of(tree, x, depth)]
    return score


def nodes_table(trees: DataFrame) -> DataFrame:
    """(model_id, out, tree, node, feature, thr), a row per inner node."""
    pairs = F.posexplode(F.arrays_zip("feat", "thr"))
    return trees.select("model_id", "out", "tree", pairs.alias("node", "p")).select("model_id", "out", "tree", "node", F.col("p.feat").alias("feature"), F.col("p.thr").alias("thr"))


def leaves_table(trees: DataFrame) -> DataFrame:
    return trees.select("model_id", "out", "tree", F.posexplode("leaf").alias("leaf", "value"))


def real_splits(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("thr") != INT32_MAX)


def from_tables(head: DataFrame, trees: DataFrame) -> dict[str, Ensemble]:
    """Ensembles by model id; models are small (15 MB at most each)."""
    out = {}
    for r in head.collect():
        out[r["model_id"]] = Ensemble(r["task"], r["n_features"], r["depth"], r["scale_q"], list(r["base_q"]), [[] for _ in range(r["n_out"])], r["model_id"])
    for r in trees.orderBy("model_id", "out", "tree").toLocalIterator():
        out[r["model_id"]].trees[r["out"]].append(Tree(np.array(r["feat"], np.int32), np.array(r["thr"], np.int32), np.array(r["leaf"], np.int32)))
    return out
