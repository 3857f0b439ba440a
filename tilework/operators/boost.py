"""Histogram boosting of fixed-depth ensembles, level by level.

Rows never move: they are quantised and binned once, in one Arrow map whatever
the number of features, and kept as a table of packed blocks of a few thousand
rows each. Every level is one map over the blocks that sums counts, gradients
and hessians by (output, node, feature, bin) inside the partition; only these
sums are shuffled, and Spark picks each node's split with window functions.
All outputs of a round grow in the same passes. Sums are whole numbers, so
trees do not depend on the partitioning.

Scores are carried forward as a written table every few rounds; in between
they are recomputed from the trees since. The node of a row is walked to anew
at each level: that is a few array look-ups a row, while writing nodes back
would write the packed features again. Sibling histograms are not taken by
subtraction, as each node draws features of its own and the parent's
histograms are mostly of others.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import re
from collections.abc import Callable, Generator, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.functions import INT32_MAX, INT32_MIN
from tilework.operators import profile
from tilework.operators.binning import quantile_thresholds, ranked_splits
from tilework.operators.blocks import BLOCK_SCHEMA, blocks_a_file, pack_rows, packed, pieces, ranges_of, targets, with_bins
from tilework.operators.model import Ensemble, Tree, add_trees
from tilework.operators.sketch import sketched_thresholds
from tilework.sources.shared import discard, settle

GRID = float(1 << 26)
PASS_SCHEMA = "kind int, out int, node int, feature int, draw int, bin int, n long, g long, h long, loss double, weight double, hits long"
HIST, TOTAL, METRIC = 0, 1, 2
SPLITS = ("train", "val", "test")


@dataclass
class Params:
    trees: int = 200
    depth: int = 4
    lr: float = 0.05
    min_leaf: int = 5
    bins: int = 32
    binning: str = "linear"
    seed: int = 42
    early_stop: bool = True
    patience: int = 20
    schedule: str = "none"  # plateau, piecewise
    segments: Sequence[tuple[int, int, float]] = ()
    plateau_patience: int = 10
    plateau_factor: float = 0.9
    lr_min: float = 0.0
    weights: Sequence[float] | str | None = None  # by class or label, or "auto": from the training rows
    weight_cap: float = 20.0
    normalize_weights: bool = False
    keep_every: int = 8
    extra: dict = field(default_factory=dict)


@dataclass
class Run:
    """What training leaves: the ensemble, its learning curve and the best round."""

    ensemble: Ensemble
    curve: list[tuple[int, str, str, float]]
    best_iter: int
    best_val: float | None
    stopped: bool = False  # by the one who watched

    def curve_table(self, spark, run_id: str = "run") -> DataFrame:
        rows = [(run_id, *r) for r in self.curve]
        return spark.createDataFrame(rows, "run_id string, step int, split string, metric string, value double")


def drawn_features(seed: int, round_: int, out: int, node: int, usable: Sequence[int]) -> list[int]:
    """The node's sample of features: those of least hash, in that order."""
    k = max(1, int(math.floor(math.sqrt(len(usable)) + 0.5)))
    return sorted(usable, key=lambda f: hashlib.md5(f"{seed}:{round_}:{out}:{node}:{f}".encode()).hexdigest())[:k]


SEGMENT = re.compile(r"(\d+)\s*(?::\s*(\d+)\s*:|-\s*(\d+)\s)\s*([0-9.eE+-]+)")


def check_segments(segments: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Segments by start; each round may belong to one at most."""
    free = 1  # first round that no segment has taken
    out = sorted(segments)
    for segment in out:
        start, end, lr = segment
        if start < free or not (start <= end and lr > 0):
            raise ValueError(f"segment {segment} is empty, has no rate or meets another")
        free = end + 1
    return out


def parse_segments(text: str) -> list[tuple[int, int, float]]:
    """'start:end:lr' or 'start-end lr', comma-separated."""
    found = [SEGMENT.fullmatch(part.strip()) for part in text.split(",") if part.strip()]
    if not all(found):
        raise ValueError(f"segments are start:end:lr, not {text!r}")
    return check_segments([(int(m[1]), int(m[2] or m[3]), float(m[4])) for m in found])


class Schedule:
    """The learning rate of each round."""

    def __init__(self, p: Params):
        self.p, self.lr, self.bad = p, p.lr, 0
        self.segments = check_segments(p.segments) if p.schedule == "piecewise" else []

    def at(self, t: int) -> float:
        if self.p.schedule == "piecewise":
            return next((lr for start, end, lr in self.segments if start <= t <= end), self.p.lr)
        return self.lr

    def after(self, improved: bool) -> None:
        if self.p.schedule != "plateau":
            return
        self.bad = 0 if improved else self.bad + 1
        if self.bad >= self.p.plateau_patience:
            self.lr, self.bad = max(self.lr * self.p.plateau_factor, self.p.lr_min, 1e-12), 0


def _targets(task: str, y: np.ndarray, score: np.ndarray, scale: float, w: np.ndarray | None):
    """Whole-number gradients and hessians (rows, outputs), loss, weight and hits of each row."""
    n, k = score.shape
    if task == "regression":
        g = y - score
        r = g[:, 0] / scale
        return g.astype(np.int64), np.zeros((n, 1), np.int64), r * r, np.ones(n), np.zeros(n, np.int64)
    z = score / scale
    if task == "multiclass_classification":
        e = np.exp(z - z.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        truth = np.zeros((n, k))
        truth[np.arange(n), y[:, 0]] = 1
        row_w = (w[y[:, 0]] if w is not None else np.ones(n))[:, None] * np.ones((1, k))
        loss = -np.log(np.maximum(p[np.arange(n), y[:, 0]], 1e-12)) * row_w[:, 0]
        weight, hits = row_w[:, 0], (score.argmax(1) == y[:, 0]).astype(np.int64)
    else:
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        truth = y.astype(float)
        if w is None:
            row_w = np.ones((n, k))
        elif task == "binary_classification":
            row_w = w[y]
        else:  # label weights and their common scale
            row_w = np.where(y == 1, w[:k] * w[k], w[k])
        q = np.clip(p, 1e-12, 1 - 1e-12)
        loss = (-(truth * np.log(q) + (1 - truth) * np.log(1 - q)) * row_w).sum(1)
        weight, hits = row_w.sum(1), ((p >= 0.5) == (truth == 1)).sum(1).astype(np.int64)
    g = np.floor((truth - p) * row_w * GRID + 0.5).astype(np.int64)
    h = np.floor(np.maximum(p * (1 - p), 1e-12) * row_w * GRID + 0.5).astype(np.int64)
    return g, h, loss, weight, hits


@dataclass
class Ask:
    """What a run wants to know of the rows next: a level of a round, or with nothing growing only its metrics."""

    rows: DataFrame
    ensemble: Ensemble
    since: list[list[Tree]]
    growing: list[Tree] | None
    level: int
    drawn: dict[tuple[int, int], list[int]]
    measure: bool
    min_leaf: int = 1

    @property
    def walks(self) -> bool:
        """Whether rows are sent through trees."""
        return self.level > 0 or any(self.since)


class _Tally:
    """The sums of one ask over the pieces of a task."""

    def __init__(self, ask: Ask, bins: int):
        self.ask, self.bins, n_out = ask, bins, ask.ensemble.n_out
        self.first, self.width = (1 << ask.level) - 1, 1 << ask.level
        self.total = np.zeros((3, n_out, self.width), np.int64)
        self.hist = {key: np.zeros((3, len(fs), bins), np.int64) for key, fs in ask.drawn.items()}
        self.met = np.zeros((3, 4))

    def add(self, every: dict, train: dict, w: np.ndarray | None) -> None:
        """Cells of all rows of a piece, and of its training rows with their places (``at``)."""
        ask, ensemble = self.ask, self.ask.ensemble
        rows = every if ask.measure else train  # else other rows count for nothing
        score = add_trees(rows["score"].copy(), ask.since, rows.get("xq"), ensemble.depth)
        g, h, loss, weight, hits = _targets(ensemble.task, rows["y"], score, float(ensemble.scale_q), w)
        if ask.measure:
            for i, v in enumerate((np.ones(len(score)), loss, weight, hits)):
                self.met[:, i] += np.bincount(every["split"], v, 3)[:3]
        if ask.growing is None:
            return
        if ask.measure:
            g, h = g[train["at"]], h[train["at"]]
        x, b, hessians = train.get("xq"), train.get("bins"), ensemble.task != "regression"
        for k, tree in enumerate(ask.growing):
            at = np.zeros(len(g), np.int64)
            for _ in range(ask.level):
                at = 2 * at + 1 + (x[np.arange(len(x)), tree.feat[at]] > tree.thr[at])
            at -= self.first
            sums = (None, g[:, k], h[:, k] if hessians else None)  # counts; regression has no hessians
            for i, v in enumerate(sums):
                if i == 0 or v is not None:
                    self.total[i, k] += _summed(at, v, self.width)
            for node in np.flatnonzero(np.bincount(at, minlength=self.width)):
                fs = ask.drawn.get((k, int(node) + self.first))
                if not fs:
                    continue
                mine = slice(None) if ask.level == 0 else np.flatnonzero(at == node)
                own, values = b[mine], [v if v is None else v[mine] for v in sums]
                for d, f in enumerate(fs):
                    for i, v in enumerate(values):
                        if i == 0 or v is not None:
                            self.hist[k, int(node) + self.first][i, d] += _summed(own[:, f], v, self.bins)

    def rows(self, out0: int) -> Iterator[tuple]:
        """Rows of PASS_SCHEMA, outputs numbered from out0."""
        for (k, node), sums in self.hist.items():
            for d, b in zip(*np.nonzero(sums[0])):
                yield HIST, out0 + k, node, self.ask.drawn[k, node][d], int(d), int(b), *(int(s[d, b]) for s in sums), 0.0, 0.0, 0
        for k, node in zip(*np.nonzero(self.total[0])):
            yield TOTAL, out0 + int(k), int(node) + self.first, -1, 0, 0, *(int(t[k, node]) for t in self.total), 0.0, 0.0, 0
        for s in range(3):
            if self.met[s, 0]:
                yield METRIC, out0, s, -1, 0, 0, int(self.met[s, 0]), 0, 0, float(self.met[s, 1]), float(self.met[s, 2]), int(self.met[s, 3])


def shared_pass(asks: Sequence[Ask], bins: int, w: np.ndarray | None) -> DataFrame:
    """Sums of one map over the rows that all asks name: histograms of the drawn features, totals of all nodes, metrics.

    Outputs of the i-th ask are numbered from i * n_out on. Reading the blocks
    costs more than adding them up, so several runs on the same rows read them
    once; cells that no ask looks at are not read.
    """
    rows, asks = asks[0].rows, [dataclasses.replace(a, rows=None) for a in asks]
    ensemble = asks[0].ensemble
    n_out, n_features = ensemble.n_out, ensemble.n_features
    kinds = {"y": (np.int64, n_out if ensemble.task == "multilabel_classification" else 1), "score": (np.float64, n_out)}
    if any(a.walks for a in asks):
        kinds["xq"] = (np.int32, n_features)
    if any(a.drawn for a in asks):
        kinds["bins"] = (np.uint16, n_features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [_Tally(a, bins) for a in asks]
        for batch in pieces(batches):
            every = {c: packed(batch, c, *kind) for c, kind in kinds.items()}
            every["split"] = packed(batch, "split", np.uint8, 1)[:, 0]
            at = np.flatnonzero(every["split"] == 0)
            train = {c: every[c][at] for c in kinds} | {"at": at}
            for t in tallies:
                t.add(every, train, w)
        out = [r for i, t in enumerate(tallies) for r in t.rows(i * n_out)]
        cols = list(zip(*out)) if out else [[] for _ in range(12)]
        types = [pa.int32()] * 6 + [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64()]
        names = [c.split()[0] for c in PASS_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    # Sums come as one row for each key and task; one exchange serves them and the windows over bins.
    told = rows.select("split", *kinds).mapInArrow(run, PASS_SCHEMA).repartition("kind", "out", "node", "feature")
    sums = told.groupBy("kind", "out", "node", "feature", "draw", "bin")
    return sums.agg(*[F.sum(c).alias(c) for c in ("n", "g", "h", "loss", "weight", "hits")])


def level_pass(rows: DataFrame, ensemble: Ensemble, since: list[list[Tree]], growing: list[Tree] | None, level: int, drawn: dict[tuple[int, int], list[int]], bins: int, w: np.ndarray | None, measure: bool) -> DataFrame:
    """shared_pass() for one run."""
    return shared_pass([Ask(rows, ensemble, since, growing, level, drawn, measure)], bins, w)


def _summed(at: np.ndarray, value: np.ndarray | None, n: int) -> np.ndarray:
    """Exact whole-number sums by place, or counts without values; where a double would not hold a sum, low and high halves are added apart."""
    if value is None:
        return np.bincount(at, minlength=n)[:n]
    if not len(value) or max(int(value.max()), -int(value.min())) * len(value) < 1 << 53:
        return np.bincount(at, value, n).astype(np.int64)[:n]
    low = np.bincount(at, (value & 0xFFFFF).astype(np.float64), n)
    high = np.bincount(at, (value >> 20).astype(np.float64), n)
    return low.astype(np.int64)[:n] + (high.astype(np.int64)[:n] << 20)


def _winners(sums: DataFrame, asks: Sequence[Ask], bins: int) -> DataFrame:
    """Totals and metrics as they are, and each node's best split.

    All kinds of rows go through the same windows: filtered apart, the map
    over the rows would run once for each.
    """
    classify, n_out = asks[0].ensemble.task != "regression", asks[0].ensemble.n_out
    least = F.element_at(F.array(*[F.lit(a.min_leaf) for a in asks]), (F.floor(F.col("out") / n_out) + 1).cast("int"))  # of the row's run
    ranked = ranked_splits(sums, ["kind", "out", "node"], least, classify, GRID if classify else 1.0, bins, F.col("kind") == HIST)
    cols = ["kind", "out", "node", "feature", "bin", "n", "g", "h", "loss", "weight", "hits"]
    return ranked.filter((F.col("kind") != HIST) | F.col("best")).select(*cols)


def _answers(asks: Sequence[Ask], bins: int, w: np.ndarray | None) -> list[list[dict]]:
    """What one pass tells each ask: a row for each node, split and part."""
    sums, n_out = shared_pass(asks, bins, w), asks[0].ensemble.n_out
    if any(a.growing is not None for a in asks):
        sums = _winners(sums, asks, bins)
    told: list[list[dict]] = [[] for _ in asks]
    for r in sums.collect():
        told[r["out"] // n_out].append(r.asDict() | {"out": r["out"] % n_out})
    return told


def leaf_value(task: str, total: tuple[int, int, int], lr: float, scale_q: int) -> int:
    n, g, h = total
    if task == "regression":
        value = lr * (g / n) if n else 0.0
    else:
        value = lr * (g / GRID) / (h / GRID + 1.0) * scale_q
    return max(INT32_MIN, min(INT32_MAX, math.floor(value + 0.5)))


def prepare(df: DataFrame, features: Sequence[str], task: str, p: Params, y: str = "y", row_id: str | None = None, n_out: int = 1, refit: bool = False):
    """Quantised, binned rows with starting scores, as a written table; the blank ensemble; thresholds; weights."""
    # What the table was made from (splits, joins) runs once.
    part = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 0 if refit else 1).otherwise(2)
    quantile = p.binning == "quantile"
    exact = quantile and row_id is not None  # else by a sketch of all rows
    if exact:
        df = settle(df.select(*dict.fromkeys(["split", *features, y, *([row_id] if row_id else [])])), "training_rows")
    most = blocks_a_file(max(len(features), n_out))
    raw = settle(pack_rows(df.withColumn("_part", part), features, y), "raw_blocks", most)
    regression = task == "regression"
    told = ranges_of(raw, len(features))
    scale_q = profile.scale_of([t[2] for t in told], [told[-1][2]] if regression else [])
    ranges = [(low, max(high - low, 0.0)) for low, high, _ in told[:-1]]
    thresholds = None
    if quantile and not exact:
        thresholds, _ = sketched_thresholds(raw, len(features), p.bins)
    elif exact:
        rows = df.filter(F.col("split").isin("train", "val") if refit else F.col("split") == "train")
        found = {r["feature"]: list(np.maximum.accumulate(r["thresholds"])) for r in quantile_thresholds(rows, features, p.bins, row_id).collect()}
        thresholds = [found[c] for c in features]
        discard(df)
    n_y = n_out if task == "multilabel_classification" else 1
    train = targets(raw, n_y).filter("part = 0")
    y, auto = "y", isinstance(p.weights, str)
    if auto and p.weights != "auto":
        raise ValueError(f"weights are numbers or 'auto', not {p.weights!r}")
    w = None
    if regression:
        base = [profile.base_score_regression(train, scale_q, y).first()[0]]
    elif task == "binary_classification":
        w = None if p.weights is None else np.array(p.weights if not auto else profile.binary_weights(train, y, cap=p.weight_cap, normalize=p.normalize_weights).first()[2:4], float)
        base = [profile.base_score_binary(train, scale_q, y, *(w if w is not None else (1.0, 1.0))).first()[0]]
    elif task == "multiclass_classification":
        manual = None if auto else p.weights if p.weights is not None else [1.0] * n_out
        table = profile.class_weights(train, n_out, y, manual, p.weight_cap, p.normalize_weights and p.weights is not None)
        w = None if p.weights is None else np.array([r["w"] for r in table.orderBy("cls").collect()], float)
        base = [r["base_q"] for r in profile.base_score_multiclass(table, scale_q).orderBy("cls").collect()]
    else:
        table = profile.label_pos_weights(train, n_out, y, p.weight_cap, p.normalize_weights and auto)
        if auto:
            told = table.orderBy("label").collect()
            w = np.array([*[r["w"] for r in told], told[0]["scale"]], float)
        elif p.weights is not None:
            w = np.array([*p.weights, 1.0], float)
            table = table.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in p.weights]), F.col("label") + 1))
        else:
            table = table.withColumn("w", F.lit(1.0))
        base = [r["base_q"] for r in profile.base_score_multilabel(table, scale_q).orderBy("label").collect()]
    base = [int(b) if b is not None else 0 for b in base]
    ensemble = Ensemble(task, len(features), p.depth, scale_q, base, [[] for _ in base], features=list(features))

    def threshold(f: int, b: int) -> int:
        low, width = ranges[f]
        real = thresholds[f][b] if thresholds else low + width * (b + 1) / p.bins
        return max(INT32_MIN, min(INT32_MAX, math.floor(real * scale_q + 0.5)))

    usable = [i for i, (_, width) in enumerate(ranges) if width > 0]
    # A small table is dealt to all cores; a large one has more parts than cores already.
    cores = raw.sparkSession.sparkContext.defaultParallelism
    dealt = raw.repartition(cores) if raw.rdd.getNumPartitions() < cores else raw
    binned_rows = settle(with_bins(dealt, scale_q, ranges, p.bins, thresholds, base, n_y, regression), "binned", most)
    discard(raw)
    return binned_rows, ensemble, threshold, usable, w


def grow_round(rows: DataFrame, ensemble: Ensemble, since: list[list[Tree]], p: Params, t: int, lr: float, threshold, usable: Sequence[int]) -> Generator[Ask, list[dict], tuple[list[Tree], dict[int, tuple]]]:
    """One tree per output in depth + 1 passes, and the metrics before it; asks for its passes and is sent their rows."""
    trees = [Tree.blank(p.depth) for _ in range(ensemble.n_out)]
    totals: dict[tuple[int, int], tuple[int, int, int]] = {}
    split: set[tuple[int, int]] = set()
    live = [(k, 0) for k in range(ensemble.n_out)]
    metrics: dict[int, tuple] = {}
    for level in range(p.depth + 1):
        drawn = {(k, node): drawn_features(p.seed, t, k, node, usable) for k, node in live} if level < p.depth and usable else {}
        if level and not live:
            break
        got = yield Ask(rows, ensemble, since, trees, level, drawn, level == 0, p.min_leaf)
        for r in got:
            if r["kind"] == TOTAL:
                totals[r["out"], r["node"]] = (r["n"], r["g"], r["h"])
            elif r["kind"] == METRIC:
                metrics[r["node"]] = (r["n"], r["loss"], r["weight"], r["hits"])
        # Rows on a bin's edge may be routed to the other side than counted: a
        # split that leaves a child too small is taken back.
        for k, node in sorted({((k, (node - 1) // 2)) for k, node in live if level}):
            if any(totals.get((k, c), (0,))[0] < p.min_leaf for c in (2 * node + 1, 2 * node + 2)):
                trees[k].feat[node], trees[k].thr[node] = 0, INT32_MAX
                split.discard((k, node))
        chosen = [r for r in got if r["kind"] == HIST]
        following = []
        for r in chosen:
            k, node = r["out"], r["node"]
            if (node and (k, (node - 1) // 2) not in split) or totals[k, node][0] < 2 * p.min_leaf:
                continue
            trees[k].feat[node], trees[k].thr[node] = r["feature"], threshold(r["feature"], r["bin"])
            split.add((k, node))
            following += [(k, 2 * node + 1), (k, 2 * node + 2)]
        live = following
    for k in range(ensemble.n_out):
        inner = (1 << p.depth) - 1
        values = {0: totals.get((k, 0), (0, 0, 0))}
        for node in range(inner):
            own = values[node]
            for child in (2 * node + 1, 2 * node + 2):
                values[child] = totals.get((k, child), (0, 0, 0)) if (k, node) in split else own
        for i in range(inner + 1):
            trees[k].leaf[i] = leaf_value(ensemble.task, values[inner + i], lr, ensemble.scale_q)
    return trees, metrics


def _curve(t: int, metrics: dict[int, tuple], ensemble: Ensemble) -> list[tuple[int, str, str, float]]:
    out = []
    for s, (n, loss, weight, hits) in sorted(metrics.items()):
        if ensemble.task == "regression":
            out.append((t, SPLITS[s], "mse", loss / n))
        else:
            per = ensemble.n_out if ensemble.task == "multilabel_classification" else 1
            out += [(t, SPLITS[s], "logloss", loss / weight if weight else 0.0), (t, SPLITS[s], "accuracy", hits / (n * per))]
    return out


def train(df: DataFrame, features: Sequence[str], task: str, p: Params | None = None, y: str = "y", row_id: str | None = None, n_out: int = 1, refit: bool = False) -> Run:
    """Boost an ensemble on rows with ``split``; see Params. y is an array for multilabel.

    With binning="quantile" the cuts are exact on a sample where there is a
    row_id, else those of a sketch of all training rows.
    """
    p = p or Params()
    p.bins = max(8, min(512, p.bins))
    prepared = prepare(df, features, task, p, y, row_id, n_out, refit)
    try:
        return fit(prepared, p, refit=refit)
    finally:
        discard(prepared[0])


def fit(prepared: tuple, p: Params, refit: bool = False, watch: Callable[[int, float], bool] | None = None) -> Run:
    """Boost on what prepare() gave, which stays as it was and may serve several runs at once.

    ``watch`` is told each round's number and loss and ends the run by giving True.
    """
    (ended,) = fit_together(prepared, [p], refit, watch)
    if isinstance(ended, Exception):
        raise ended
    return ended


def fit_together(prepared: tuple, runs: Sequence[Params], refit: bool = False, watch: Callable[[int, float], bool] | None = None) -> list[Run | Exception]:
    """Runs in step on what prepare() gave: what they ask of the same rows is one pass over them.

    A run ends as fit() would end it alone; one that its own parameters make
    fail leaves its error. Runs share their passes until the first of them
    writes scores of its own; from then on each has passes of its own, at the same time as others.
    """
    spark, w = prepared[0].sparkSession, prepared[4]
    steps = [_steps(prepared, p, refit, watch) for p in runs]
    ended: list[Run | Exception | None] = [None] * len(runs)
    asks: dict[int, Ask] = {}

    def go_on(i: int, told: list[dict] | None) -> None:
        try:
            asks[i] = steps[i].send(told)
        except StopIteration as done:
            ended[i] = done.value
        except (ValueError, ArithmeticError) as error:  # what the run's own parameters cause; a lost cluster ends all
            ended[i] = error

    def turn(group: list[int]) -> None:
        told = _answers([asks.pop(i) for i in group], runs[group[0]].bins, w)
        for i, rows in zip(group, told):
            go_on(i, rows)

    for i in range(len(runs)):
        go_on(i, None)
    while asks:
        same: dict[tuple[int, int], list[int]] = {}
        for i, ask in sorted(asks.items()):
            same.setdefault((id(ask.rows), runs[i].bins), []).append(i)
        if len(same) == 1:
            turn(*same.values())
            continue
        with ThreadPoolExecutor(len(same)) as pool:
            for f in [pool.submit(inheritable_thread_target(spark)(turn), group) for group in same.values()]:
                f.result()
    return ended


def _steps(prepared: tuple, p: Params, refit: bool, watch: Callable[[int, float], bool] | None) -> Generator[Ask, list[dict], Run]:
    """A run as the passes it asks for, one after another."""
    binned_rows, blank, threshold, usable, _ = prepared
    ensemble = dataclasses.replace(blank, depth=p.depth, trees=[[] for _ in blank.base_q])
    rows, task = binned_rows, ensemble.task
    schedule, curve, stopped = Schedule(p), [], False
    best, best_iter, since_best = math.inf, 0, 0
    kept = 0
    stop = False
    for t in range(1, p.trees + 2):
        since = [trees[kept:] for trees in ensemble.trees]
        if t <= p.trees:
            grown, metrics = yield from grow_round(rows, ensemble, since, p, t, schedule.at(t), threshold, usable)
        else:
            grown = None
            sums = yield Ask(rows, ensemble, since, None, 0, {}, True)
            metrics = {r["node"]: (r["n"], r["loss"], r["weight"], r["hits"]) for r in sums if r["kind"] == METRIC}
        if t > 1:
            step = t - 1
            curve += _curve(step, metrics, ensemble)
            n, loss, weight, _ = metrics.get(1, metrics.get(0, (1, 0.0, 1.0, 0)))
            value = loss / (n if task == "regression" else weight or 1)
            improved = value + 1e-12 < best
            best, best_iter, since_best = (value, step, 0) if improved else (best, best_iter, since_best + 1)
            schedule.after(improved)
            stop = p.early_stop and not refit and since_best >= p.patience
            stopped = watch is not None and watch(step, value)
            stop = stop or stopped
        if stop or grown is None:
            break
        for k, tree in enumerate(grown):
            ensemble.trees[k].append(tree)
        if len(ensemble.trees[0]) - kept >= p.keep_every:
            last, rows = rows, settle(_with_scores(rows, [trees[kept:] for trees in ensemble.trees], ensemble.depth, ensemble.n_features), "scores", blocks_a_file(max(ensemble.n_features, ensemble.n_out)))
            if last is not binned_rows:
                discard(last)
            kept = len(ensemble.trees[0])
    if rows is not binned_rows:
        discard(rows)
    if p.early_stop and not refit:
        ensemble.trees = [trees[:best_iter] for trees in ensemble.trees]
    return Run(ensemble, curve, best_iter, None if math.isinf(best) else best, stopped)


def _with_scores(rows: DataFrame, since: list[list[Tree]], depth: int, n_features: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score = add_trees(packed(batch, "score", np.float64, len(since)).copy(), since, packed(batch, "xq", np.int32, n_features), depth)
            ends = np.cumsum(batch.column("n").to_numpy())
            blobs = pa.array([part.tobytes() for part in np.split(score, ends[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([blobs if c == "score" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def train_regression(df: DataFrame, features: Sequence[str], p: Params | None = None, **more) -> Run:
    return train(df, features, "regression", p, **more)


def train_binary(df: DataFrame, features: Sequence[str], p: Params | None = None, **more) -> Run:
    return train(df, features, "binary_classification", p, **more)


def train_multiclass(df: DataFrame, features: Sequence[str], n_classes: int, p: Params | None = None, **more) -> Run:
    return train(df, features, "multiclass_classification", p, n_out=n_classes, **more)


def train_multilabel(df: DataFrame, features: Sequence[str], n_labels: int, p: Params | None = None, y: str = "labels", **more) -> Run:
    return train(df, features, "multilabel_classification", p, y=y, n_out=n_labels, **more)


def best_iteration(curve: DataFrame, patience: int) -> DataFrame:
    """curve (run_id, step, val) with best so far, improvement, rounds since it, and where to stop."""
    by_run = W.partitionBy("run_id").orderBy("step")
    before = by_run.rowsBetween(W.unboundedPreceding, -1)
    out = curve.withColumn("best_before", F.min("val").over(before))
    out = out.withColumn("improved", F.coalesce(F.col("val") + 1e-12 < F.col("best_before"), F.lit(True)))
    best_step = F.last(F.when(F.col("improved"), F.col("step")), ignorenulls=True).over(by_run)
    out = out.withColumn("best_iter", best_step)
    since = F.row_number().over(by_run) - F.last(F.when(F.col("improved"), F.row_number().over(by_run)), ignorenulls=True).over(by_run)
    return out.withColumn("since_best", since).withColumn("stop", F.col("since_best") >= patience).drop("best_before")


def plateau_lr(rounds: DataFrame, base: float, patience: int, factor: float, least: float = 0.0) -> DataFrame:
    """rounds (run_id, step, improved) with ``lr`` in force after each round."""
    by_run = W.partitionBy("run_id").orderBy("step")
    stretch = F.sum(F.col("improved").cast("int")).over(by_run)
    out = rounds.withColumn("_s", stretch)
    place = F.row_number().over(W.partitionBy("run_id", "_s").orderBy("step")) - F.when(F.col("_s") > 0, 1).otherwise(0)
    out = out.withColumn("_drop", F.when(~F.col("improved") & (place % patience == 0), 1).otherwise(0))
    drops = F.sum("_drop").over(by_run)
    return out.withColumn("lr", F.greatest(F.lit(least), F.lit(1e-12), base * F.pow(F.lit(float(factor)), drops))).drop("_s", "_drop")


def piecewise_lr(rounds: DataFrame, segments: DataFrame, base: float) -> DataFrame:
    """rounds (step) with the rate of the segment (start, end, lr) that holds it, else base."""
    overlap = segments.withColumn("_e", F.lag("end").over(W.orderBy("start", "end"))).filter(F.col("start") <= F.col("_e"))
    if not overlap.isEmpty():
        raise ValueError("segments overlap")
    within = (F.col("step") >= F.col("start")) & (F.col("step") <= F.col("end"))
    return rounds.join(F.broadcast(segments), within, "left").select(*rounds.columns, F.coalesce("lr", F.lit(base)).alias("lr"))
