"""Trees do not depend on the partitioning and equal a plain trainer's."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.operators import boost, evaluate, predict, split
from tilework.operators.model import add_trees, from_tables
from tilework.sources import models as files

MAX = 2147483647


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 400
    data = [(i, float(rng.integers(0, 33)), float(rng.normal()), 1.0, float(rng.integers(0, 5))) for i in range(n)]
    df = spark.createDataFrame(data, "id int, a double, b double, still double, c double")
    df = df.withColumn("y", F.col("a") * 2 + F.when(F.col("b") > 0, 10).otherwise(0) + F.col("c"))
    return split.seeded_split(df, "id").cache()


FS = ["a", "b", "still", "c"]


def shape(ensemble):
    return [[(t.feat.tolist(), t.thr.tolist(), t.leaf.tolist()) for t in trees] for trees in ensemble.trees]


def plain_regression(pdf, p):
    """The rules in plain numpy: residuals, drawn features, best boundary, routing, leaves."""
    x = pdf[FS].to_numpy(float)
    y = pdf["y"].to_numpy(float)
    train = (pdf["split"] == "train").to_numpy()
    scale = int(max(1, min(1_000_000, math.floor(2147480000 / np.abs(x).max()), math.floor(2147480000 / np.abs(y).max()))))
    q = lambda v: np.floor(v * scale + 0.5).astype(np.int64)
    xq, yq = q(x), q(y)
    lo, w = x[train].min(0), x[train].max(0) - x[train].min(0)
    usable = [f for f in range(len(FS)) if w[f] > 0]
    k = max(1, int(math.floor(math.sqrt(len(usable)) + 0.5)))
    base = math.floor(y[train].mean() * scale + 0.5)
    pred, out = np.full(len(y), base, np.int64), []
    for t in range(1, p.trees + 1):
        n_in = (1 << p.depth) - 1
        feat, thr, leaf = [0] * n_in, [MAX] * n_in, [0] * (n_in + 1)
        r = yq - pred

        def fill(node, total):
            if node >= n_in:
                leaf[node - n_in] = math.floor(p.lr * (total.sum() / len(total)) + 0.5) if len(total) else 0
                return
            fill(2 * node + 1, total), fill(2 * node + 2, total)

        def grow(node, idx):
            if node >= n_in:
                return fill(node, r[idx])
            best = None
            if len(idx) >= 2 * p.min_leaf:
                drawn = sorted(usable, key=lambda f: hashlib.md5(f"{p.seed}:{t}:0:{node}:{f}".encode()).hexdigest())[:k]
                for d, f in enumerate(drawn):
                    b = np.clip(np.floor((x[idx, f] - lo[f]) / w[f] * p.bins), 0, p.bins - 1).astype(int)
                    for cut in range(p.bins - 1):
                        left = b <= cut
                        nl, nr = left.sum(), (~left).sum()
                        if nl < p.min_leaf or nr < p.min_leaf:
                            continue
                        score = float(r[idx][left].sum()) ** 2 / nl + float(r[idx][~left].sum()) ** 2 / nr
                        if best is None or score > best[0]:
                            best = (score, f, cut)
            if best:
                _, f, cut = best
                at = math.floor((lo[f] + w[f] * (cut + 1) / p.bins) * scale + 0.5)
                right = xq[idx, f] > at
                if right.sum() >= p.min_leaf and (~right).sum() >= p.min_leaf:
                    feat[node], thr[node] = f, at
                    grow(2 * node + 1, idx[~right]), grow(2 * node + 2, idx[right])
                    return
            fill(node, r[idx])

        grow(0, np.flatnonzero(train))
        tree = boost.Tree(np.array(feat), np.array(thr), np.array(leaf))
        out.append((feat, thr, leaf))
        pred = add_trees(pred[:, None], [[tree]], xq, p.depth)[:, 0]
    return out


def test_trees_equal_a_plain_trainer_for_any_partitioning(spark, rows):
    p = boost.Params(trees=3, depth=3, lr=0.3, bins=16, min_leaf=8, early_stop=False, keep_every=2)
    plain = plain_regression(rows.toPandas(), p)
    for n in (1, 3, 16):
        run = boost.train_regression(rows.repartition(n), FS, p)
        assert shape(run.ensemble)[0] == plain


def plain_classifier(pdf, p, task, weights):
    """The second-order rules in plain numpy, node after node; same drawing, bins and rounding."""
    x, grid = pdf[FS].to_numpy(float), float(1 << 26)
    train = (pdf["split"] == "train").to_numpy()
    y = np.stack(pdf["target"].to_numpy()).astype(int) if task == "multilabel" else pdf["target"].to_numpy(int)[:, None]
    n_out = {"binary": 1, "multiclass": 3, "multilabel": 2}[task]
    scale = int(max(1, min(1_000_000, math.floor(2147480000 / np.abs(x).max()))))
    xq = np.floor(x * scale + 0.5).astype(np.int64)
    lo, w = x[train].min(0), x[train].max(0) - x[train].min(0)
    usable = [f for f in range(len(FS)) if w[f] > 0]
    draw = max(1, int(math.floor(math.sqrt(len(usable)) + 0.5)))
    bins = np.clip(np.floor((x - lo) / np.where(w > 0, w, 1) * p.bins), 0, p.bins - 1).astype(int)
    odds = lambda share: math.floor(math.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6))) * scale + 0.5)
    if task == "multiclass":
        mass = np.array([(y[train, 0] == k).sum() * weights[k] for k in range(3)])
        base = [math.floor(math.log(max((m + 1e-3) / (mass.sum() + 3e-3), 1e-9)) * scale + 0.5) for m in mass]
    elif task == "binary":
        one, zero = (y[train] == 1).sum() * weights[1], (y[train] == 0).sum() * weights[0]
        base = [odds(one / (one + zero))]
    else:
        base = [odds((y[train, k] == 1).sum() * weights[k] / ((y[train, k] == 0).sum() + (y[train, k] == 1).sum() * weights[k])) for k in range(2)]
    score, out = np.tile(np.array(base, float), (len(x), 1)), [[] for _ in range(n_out)]
    for t in range(1, p.trees + 1):
        z = score / scale
        if task == "multiclass":
            e = np.exp(z - z.max(1, keepdims=True))
            prob, truth = e / e.sum(1, keepdims=True), np.eye(3)[y[:, 0]]
            row_w = np.array(weights)[y[:, 0]][:, None]
        else:
            prob, truth = 1 / (1 + np.exp(-z)), y.astype(float)
            row_w = np.array(weights)[y] if task == "binary" else np.where(y == 1, np.array(weights), 1.0)
        g = np.floor((truth - prob) * row_w * grid + 0.5).astype(np.int64)
        h = np.floor(np.maximum(prob * (1 - prob), 1e-12) * row_w * grid + 0.5).astype(np.int64)
        trees = []
        for k in range(n_out):
            n_in = (1 << p.depth) - 1
            feat, thr, leaf = [0] * n_in, [MAX] * n_in, [0] * (n_in + 1)

            def grow(node, idx, whole):
                """whole: the rows whose sums a leaf below gets if this node is not split."""
                if node >= n_in:
                    value = p.lr * (g[whole, k].sum() / grid) / (h[whole, k].sum() / grid + 1.0) * scale
                    leaf[node - n_in] = math.floor(value + 0.5)
                    return
                best = None
                if idx is not None and len(idx) >= 2 * p.min_leaf:
                    G, H = g[idx, k].sum() / grid, h[idx, k].sum() / grid
                    for f in sorted(usable, key=lambda f: hashlib.md5(f"{p.seed}:{t}:{k}:{node}:{f}".encode()).hexdigest())[:draw]:
                        for cut in range(p.bins - 1):
                            left = bins[idx, f] <= cut
                            if left.sum() < p.min_leaf or (~left).sum() < p.min_leaf:
                                continue
                            gl, hl = g[idx, k][left].sum() / grid, h[idx, k][left].sum() / grid
                            gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, f, cut)
                if best:
                    _, f, cut = best
                    at = math.floor((lo[f] + w[f] * (cut + 1) / p.bins) * scale + 0.5)
                    right = xq[idx, f] > at
                    if right.sum() >= p.min_leaf and (~right).sum() >= p.min_leaf:
                        feat[node], thr[node] = f, at
                        grow(2 * node + 1, idx[~right], idx[~right]), grow(2 * node + 2, idx[right], idx[right])
                        return
                grow(2 * node + 1, None, whole), grow(2 * node + 2, None, whole)

            grow(0, np.flatnonzero(train), np.flatnonzero(train))
            out[k].append((feat, thr, leaf))
            trees.append([boost.Tree(np.array(feat), np.array(thr), np.array(leaf))])
        score = add_trees(score, trees, xq, p.depth)
    return out


@pytest.mark.parametrize("task, weights", [("binary", (1.0, 2.0)), ("multiclass", (1.0, 0.5, 3.0)), ("multilabel", (2.0, 0.5))])
def test_classifiers_equal_a_plain_trainer(rows, task, weights):
    p = boost.Params(trees=2, depth=3, lr=0.3, bins=16, early_stop=False, weights=weights, keep_every=1)
    df = rows.withColumn("target", (F.col("y") > 40).cast("int"))
    if task == "multiclass":
        df = df.withColumn("target", (F.col("c") % 3).cast("int"))
    elif task == "multilabel":
        df = df.withColumn("target", F.array("target", (F.col("b") > 0).cast("int")))
    fit = {"binary": boost.train_binary, "multiclass": lambda d, f, p, y: boost.train_multiclass(d, f, 3, p, y=y), "multilabel": lambda d, f, p, y: boost.train_multilabel(d, f, 2, p, y=y)}[task]
    assert shape(fit(df, FS, p, y="target").ensemble) == plain_classifier(df.toPandas(), p, task, weights)


@pytest.mark.parametrize("width", [64, 500])
def test_wide_tables(spark, tmp_path, width):
    """Hundreds of features are a width, not expressions: nothing is compiled for each of them."""
    rng = np.random.default_rng(width)
    x = rng.normal(size=(300, width))
    data = [(i, *map(float, r), float(r[3] > 0)) for i, r in enumerate(x)]
    names = [f"f{i}" for i in range(width)]
    df = split.seeded_split(spark.createDataFrame(data, ["id", *names, "y"]), "id")
    p = boost.Params(trees=2, depth=2, lr=0.5, early_stop=False)
    run = boost.train_binary(df, names, p)
    trees = run.ensemble.trees[0]
    assert len(trees) == 2 and any(t.thr[0] != MAX for t in trees)
    curve = {(s, part, m): v for s, part, m, v in run.curve}
    assert curve[2, "train", "logloss"] < curve[1, "train", "logloss"] < math.log(2)


def test_rows_that_are_not_clean_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0, "train"), (None, 2.0, "train")], "a double, y double, split string")
    with pytest.raises(Exception, match="clean the rows"):
        boost.train_regression(df, ["a"], boost.Params(trees=1))


@pytest.mark.parametrize("task", ["binary", "multiclass", "multilabel"])
def test_classifiers_do_not_depend_on_partitions(rows, task):
    p = boost.Params(trees=2, depth=2, lr=0.3, early_stop=False)
    df = rows.withColumn("target", (F.col("y") > 40).cast("int"))
    if task == "binary":
        fit = lambda d: boost.train_binary(d, FS, p, y="target")
    elif task == "multiclass":
        df = df.withColumn("target", (F.col("c") % 3).cast("int"))
        fit = lambda d: boost.train_multiclass(d, FS, 3, p, y="target")
    else:
        df = df.withColumn("target", F.array("target", (F.col("b") > 0).cast("int")))
        fit = lambda d: boost.train_multilabel(d, FS, 2, p, y="target")
    runs = [fit(df.repartition(n)) for n in (1, 5)]
    assert shape(runs[0].ensemble) == shape(runs[1].ensemble)
    first = [v for s, part, m, v in runs[0].curve if part == "train" and m == "logloss"]
    assert first == sorted(first, reverse=True)


def test_model_bytes_round_trip(spark, rows):
    ensemble = boost.train_regression(rows, FS, boost.Params(trees=2, depth=2, early_stop=False)).ensemble
    again, rest = files.decode(files.encode(ensemble) + b"tail")
    assert shape(again) == shape(ensemble) and rest == b"tail"
    head, trees = ensemble.tables(spark)
    assert shape(from_tables(head, trees)["model"]) == shape(ensemble)
    for bad in (b"", b"XXXX" + b"\0" * 40, files.encode(ensemble)[:-1]):
        with pytest.raises(ValueError):
            files.decode(bad)


def test_early_stop_keeps_the_best_trees(rows):
    run = boost.train_regression(rows, FS, boost.Params(trees=6, depth=2, lr=1.0, patience=1))
    assert len(run.ensemble.trees[0]) == run.best_iter
    val = [v for s, part, m, v in run.curve if part == "val"]
    assert min(val) == val[run.best_iter - 1]


def test_evaluate_agrees_with_the_curve(rows):
    run = boost.train_regression(rows, FS, boost.Params(trees=2, depth=2, lr=0.3, early_stop=False))
    told = {r["split"]: r["mse"] for r in evaluate.evaluate(rows, run.ensemble).collect()}
    for step, part, _, value in run.curve:
        if step == 2:
            assert told[part] == pytest.approx(value, rel=1e-5)


def test_segments():
    assert boost.parse_segments("1:5:0.1, 6-9 0.05") == [(1, 5, 0.1), (6, 9, 0.05)]
    for bad in ("1:5:0.1,5:6:0.1", "5:1:0.1", "1:2:0"):
        with pytest.raises(ValueError):
            boost.parse_segments(bad)


def test_positive_and_top(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5],)], "probabilities array<double>")
    assert predict.positive_labels(df, ["a", "b", "c"]).first()["positive"] == ["b", "c"]
    assert [t["name"] for t in predict.top_probabilities(df, 2, ["a", "b", "c"]).first()["top"]] == ["b", "c"]


def test_requests_meet_their_own_models(spark):
    """1,000 models, one of them with most of the requests; both ways agree with plain traversal."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

    from tilework.operators.model import HEAD_SCHEMA, TREE_SCHEMA

    rng = np.random.default_rng(2)
    heads = [(f"m{i}", 1, 2, 1, 1, 1, 10 + i % 7, [i], "regression") for i in range(1000)]
    trees = [(f"m{i}", 0, 0, [i % 2], [i % 50], [i, -i]) for i in range(1000)]
    asked = [(i, "m7" if i % 3 else f"m{i % 1000}", [float(rng.normal() * 4), float(rng.normal() * 4)]) for i in range(1500)] + [(9999, "none", [0.0, 0.0])]
    schema = StructType([StructField("request_id", LongType()), StructField("model_id", StringType()), StructField("features", ArrayType(DoubleType()))])
    requests = spark.createDataFrame(asked, schema)
    head, own = spark.createDataFrame(heads, HEAD_SCHEMA), spark.createDataFrame(trees, TREE_SCHEMA)
    want = {}
    for r, m, x in asked[:-1]:
        i = int(m[1:])
        q = math.floor(x[i % 2] * (10 + i % 7) + 0.5)
        want[r] = i + (-i if q > i % 50 else i)
    for size in (1 << 20, 0):
        told = predict.score_requests(requests, head, own, block=200, broadcast_bytes=size).collect()
        assert {r["request_id"]: r["score_q"][0] for r in told if r["reason"] is None} == want
        assert [(r["request_id"], r["score_q"], r["reason"]) for r in told if r["reason"]] == [(9999, None, "unknown_model")]
