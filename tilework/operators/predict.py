"""Scoring tables with one model or many; a map over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.functions import INT32_MAX, INT32_MIN, argmax, quantize, sigmoid, softmax
from tilework.operators.model import Ensemble, Tree, add_trees, from_tables

#: Bytes of models up to which all of them go to every executor; models up to which their few numbers do.
BROADCAST_BYTES = 64 << 20
BROADCAST_MODELS = 200_000


def score_q(features: Sequence[Column], ensemble: Ensemble) -> Column:
    """ARRAY<BIGINT> of the quantised score of each output."""
    scale, width, outputs = ensemble.scale_q, len(features), ensemble.n_out

    @F.arrow_udf("array<long>")
    def run(xq: pa.Array) -> pa.Array:
        x = xq.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(xq), width)
        score = add_trees(np.tile(np.array(ensemble.base_q, np.int64), (len(x), 1)), ensemble.trees, x, ensemble.depth)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * outputs, pa.int32()), pa.array(score.ravel()))

    return run(F.array(*[quantize(c, scale) for c in features]))


def predict(df: DataFrame, ensemble: Ensemble, features: Sequence[str] | None = None) -> DataFrame:
    """df with score_q and, by task: value; probability and cls; or probabilities and cls or labels."""
    cols = [F.col(c) for c in (features or ensemble.features)]
    out = df.withColumn("score_q", score_q(cols, ensemble))
    scale = float(ensemble.scale_q)
    if ensemble.task == "regression":
        return out.withColumn("value", F.col("score_q")[0] / scale)
    if ensemble.task == "binary_classification":
        return out.withColumn("probability", sigmoid(F.col("score_q")[0] / scale)).withColumn("cls", (F.col("probability") >= 0.5).cast("int"))
    if ensemble.task == "multiclass_classification":
        return out.withColumn("probabilities", softmax("score_q", scale)).withColumn("cls", argmax("score_q"))
    out = out.withColumn("probabilities", F.transform("score_q", lambda v: sigmoid(v / scale)))
    return out.withColumn("predicted", F.transform("probabilities", lambda p: (p >= 0.5).cast("int")))


def _scores_of(features: list, model: Ensemble) -> list:
    """Quantised scores of the rows of one model."""
    x = np.array([list(f) for f in features], np.float64).reshape(len(features), -1)
    q = np.minimum(np.floor(np.clip(x * model.scale_q, INT32_MIN, INT32_MAX) + 0.5), INT32_MAX).astype(np.int64)
    return list(add_trees(np.tile(np.array(model.base_q, np.int64), (len(q), 1)), model.trees, q, model.depth))


def refusal(n_features: str = "n_features", features: str = "features") -> Column:
    """Why a request is not scored: unknown_model, feature_count, bad_feature (null or NaN); null where it is."""
    f = F.col(features)
    count = F.coalesce(F.size(f) != F.col(n_features), F.lit(True))
    bad = F.exists(f, lambda v: v.isNull() | F.isnan(v.cast("double")))
    return F.when(F.col(n_features).isNull(), "unknown_model").when(f.isNull() | count, "feature_count").when(bad, "bad_feature")


def _beside(rows: DataFrame, models: DataFrame, many: bool, how: str = "inner", salts: int = 32) -> DataFrame:
    """rows with the one row of their model: broadcast, or with ``many`` models copied, so that those who ask for one meet it in many tasks."""
    if not many:
        return rows.join(F.broadcast(models), "model_id", how)  # BROADCAST_MODELS at most
    salt = F.pmod(F.xxhash64("request_id"), F.lit(salts)).cast("int")
    copies = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies, ["model_id", "_salt"], how).drop("_salt")


def score_requests(requests: DataFrame, head: DataFrame, trees: DataFrame, block: int = 100_000, broadcast_bytes: int = BROADCAST_BYTES, broadcast_models: int = BROADCAST_MODELS) -> DataFrame:
    """requests (request_id, model_id, features) scored by their own model: (request_id, model_id, score_q, reason).

    Every request has a row: one that names no model, has another number of
    features than its model or a feature that is no number has a ``reason``
    and no score. A model never travels with the rows. Models of a small total
    size are sent to all executors once. Otherwise the requests of each model
    are dealt into blocks of about ``block`` rows, and a task meets one block
    with one copy of its model, so that a model with most of the requests is
    not one task's work. What is known of each model meets the requests without
    moving them, or beyond ``broadcast_models`` in several copies of each.
    """
    kind = requests.schema["request_id"].dataType.simpleString()
    schema = f"request_id {kind}, model_id string, score_q array<long>, reason string"
    known = head.select("model_id", "n_features")
    many = known.count() > broadcast_models
    rows = _beside(requests.select("request_id", "model_id", "features"), known, many, "left")
    rows = rows.select("request_id", "model_id", "features", refusal().alias("reason"))
    size = trees.agg(F.sum(F.size("feat") * 8 + F.size("leaf") * 4)).first()[0] or 0

    def told(own: pd.DataFrame, scores) -> pd.DataFrame:
        return pd.DataFrame({"request_id": own["request_id"], "model_id": own["model_id"], "score_q": pd.Series(scores or [None] * len(own), index=own.index, dtype=object), "reason": own["reason"]})

    if size <= broadcast_bytes:
        shared = requests.sparkSession.sparkContext.broadcast(from_tables(head, trees))  # broadcast_bytes at most

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                good = pdf["reason"].isna()
                yield told(pdf[~good], None)
                for model_id, own in pdf[good].groupby("model_id", sort=False):
                    yield told(own, _scores_of(own["features"], shared.value[model_id]))

        return rows.mapInPandas(run, schema)
    refused = rows.filter(F.col("reason").isNotNull()).select("request_id", "model_id", F.lit(None).cast("array<long>").alias("score_q"), "reason")
    rows = rows.filter(F.col("reason").isNull())
    blocks = rows.groupBy("model_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    packed = trees.groupBy("model_id").agg(F.collect_list(F.struct("out", "tree", "feat", "thr", "leaf")).alias("trees"))
    copies = head.select("model_id", "depth", "scale_q", "base_q", "task").join(packed, "model_id").join(blocks, "model_id")
    copies = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    dealt = _beside(rows, blocks, many).withColumn("block", F.pmod(F.xxhash64("request_id"), F.col("blocks")).cast("int")).drop("blocks")

    def meet(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(model):
            return told(own[:0], None)
        r = model.iloc[0]
        by_output: list[list[Tree]] = [[] for _ in r["base_q"]]
        for t in sorted(r["trees"], key=lambda t: (t["out"], t["tree"])):
            by_output[t["out"]].append(Tree(*(np.array(t[c], np.int64) for c in ("feat", "thr", "leaf"))))
        ensemble = Ensemble(r["task"], 0, int(r["depth"]), int(r["scale_q"]), list(r["base_q"]), by_output)
        return told(own, _scores_of(own["features"], ensemble))

    key = ["model_id", "block"]
    return dealt.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(meet, schema).unionByName(refused)


def top_probabilities(df: DataFrame, k: int, names: Sequence[str], probabilities: str = "probabilities") -> DataFrame:
    """df with ``top``: the k likeliest classes, the lower number first of equal ones."""
    named = F.transform(probabilities, lambda p, i: F.struct((-p).alias("p"), i.alias("cls")))
    label = F.array(*[F.lit(n) for n in names])
    top = F.transform(F.slice(F.array_sort(named), 1, k), lambda s: F.struct(s["cls"].alias("cls"), F.element_at(label, s["cls"] + 1).alias("name"), (-s["p"]).alias("p")))
    return df.withColumn("top", top)


def positive_labels(df: DataFrame, names: Sequence[str], threshold: float = 0.5, k: int = 12, probabilities: str = "probabilities") -> DataFrame:
    """df with ``positive`` (labels at the threshold, likeliest first, k at most) and ``n_positive``."""
    named = F.filter(F.transform(probabilities, lambda p, i: F.struct((-p).alias("p"), i.alias("label"))), lambda s: -s["p"] >= threshold)
    label = F.array(*[F.lit(n) for n in names])
    out = df.withColumn("n_positive", F.size(named))
    return out.withColumn("positive", F.transform(F.slice(F.array_sort(named), 1, k), lambda s: F.element_at(label, s["label"] + 1)))
