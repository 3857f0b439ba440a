"""Model files: bytes to tables and back, packages, chunks."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.functions import CHUNK_SIZE, MAX_CHUNK
from tilework.operators.model import HEAD_SCHEMA, Ensemble, Tree
from tilework.sources.shared import Folder

# Fixed values of the file format: what files, footers and chunks begin with.
MODEL_MAGIC = b"GL1F"
PACKAGE_MAGIC = b"GL1X"
CHUNK_MAGIC = b"GL1C"

HEADER = struct.Struct("<4sBBHHIiIH")
NODE = np.dtype([("feat", "<u2"), ("thr", "<i4"), ("pad", "<u2")])
MODEL_SCHEMA = "path string, bytes long, reason string, " + HEAD_SCHEMA + ", trees array<struct<out:int,tree:int,feat:array<int>,thr:array<int>,leaf:array<int>>>, footer binary"


def encode(ensemble: Ensemble) -> bytes:
    """One output: version 1; several: version 2, trees by output."""
    n_trees, k = len(ensemble.trees[0]), ensemble.n_out
    if not (0 < ensemble.n_features <= 0xFFFF and 0 < ensemble.depth <= 0xFFFF and 0 < ensemble.scale_q <= 0xFFFFFFFF and k <= 0xFFFF):
        raise ValueError("a field does not fit its width")
    if any(len(t) != n_trees for t in ensemble.trees):
        raise ValueError("outputs differ in trees")
    first = ensemble.base_q[0] if k == 1 else 0
    out = [HEADER.pack(MODEL_MAGIC, 1 if k == 1 else 2, 0, ensemble.n_features, ensemble.depth, n_trees, first, ensemble.scale_q, 0 if k == 1 else k)]
    if k > 1:
        out.append(np.array(ensemble.base_q, "<i4").tobytes())
    for trees in ensemble.trees:
        for tree in trees:
            if len(tree.feat) and (tree.feat.min() < 0 or tree.feat.max() >= ensemble.n_features):
                raise ValueError("a node names a feature that is not there")
            nodes = np.zeros(len(tree.feat), NODE)
            nodes["feat"], nodes["thr"] = tree.feat, tree.thr
            out += [nodes.tobytes(), np.asarray(tree.leaf, "<i4").tobytes()]
    return b"".join(out)


class NotAModel(ValueError):
    """Bytes that are no model; the text says why in one word."""


def layout(data: bytes) -> tuple[int, int, int, int, int, int, int]:
    """(version, features, depth, trees of an output, outputs, where trees begin, where they end) from the header."""
    if len(data) < HEADER.size:
        raise NotAModel("short")
    magic, version, _, n_features, depth, n_trees, _, _, k = HEADER.unpack_from(data)
    if magic != MODEL_MAGIC:
        raise NotAModel("magic")
    if version not in (1, 2):
        raise NotAModel("version")
    if version == 2 and k < 2:
        raise NotAModel("outputs")
    outputs, begin = (1, HEADER.size) if version == 1 else (k, HEADER.size + 4 * k)
    per_tree = ((1 << depth) - 1) * NODE.itemsize + (4 << depth)
    end = begin + per_tree * n_trees * outputs
    if len(data) < end:
        raise NotAModel("truncated")
    return version, n_features, depth, n_trees, outputs, begin, end


def decode(data: bytes, model_id: str = "model", task: str | None = None) -> tuple[Ensemble, bytes]:
    """The ensemble and what follows it; wrong or short bytes raise NotAModel.

    The bytes do not say what one output or several stand for: without a
    ``task`` they are taken for regression and for classes.
    """
    _, n_features, depth, n_trees, outputs, begin, end = layout(data)
    *_, base, scale_q, _ = HEADER.unpack_from(data)
    base_q = [base] if outputs == 1 else np.frombuffer(data, "<i4", outputs, HEADER.size).tolist()
    inner = (1 << depth) - 1
    tree_type = np.dtype([("nodes", NODE, (inner,)), ("leaf", "<i4", (inner + 1,))])
    flat = np.frombuffer(data, tree_type, n_trees * outputs, begin)
    own = [Tree(t["nodes"]["feat"].astype(np.int32), t["nodes"]["thr"].astype(np.int32), t["leaf"].astype(np.int32)) for t in flat]
    trees = [own[k * n_trees : (k + 1) * n_trees] for k in range(outputs)]
    return Ensemble(task_for(task, outputs), n_features, depth, scale_q, base_q, trees, model_id), data[end:]


def task_for(task: str | None, outputs: int) -> str:
    """The task that a package names where it fits the number of outputs."""
    fits = ("regression", "binary_classification") if outputs == 1 else ("multiclass_classification", "multilabel_classification")
    return task if task in fits else fits[0]


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, bytes, ``reason`` and, where that is null, header, trees and footer.

    A file that is no model gives a row with its reason (short, magic,
    version, outputs, truncated) and does not stop the others.
    """
    names = [c.split()[0] for c in HEAD_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at, content in zip(pdf["path"], pdf["content"]):
                data = bytes(content)
                try:
                    f, rest = decode(data, at.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                except NotAModel as why:
                    rows.append((at, len(data), str(why), *[None] * (len(names) + 2)))
                    continue
                trees = [{"out": k, "tree": t, "feat": x.feat.tolist(), "thr": x.thr.tolist(), "leaf": x.leaf.tolist()} for k, own in enumerate(f.trees) for t, x in enumerate(own)]
                rows.append((at, len(data), None, f.model_id, 1 if f.n_out == 1 else 2, f.n_features, f.depth, len(f.trees[0]), f.n_out, f.scale_q, f.base_q, f.task, trees, rest))
            yield pd.DataFrame(rows, columns=["path", "bytes", "reason", *names, "trees", "footer"]).astype({c: "Int64" for c in ("version", "n_features", "depth", "n_trees", "n_out", "scale_q")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, MODEL_SCHEMA)


def trees_of(models: DataFrame) -> DataFrame:
    return models.select("model_id", F.explode("trees").alias("t")).select("model_id", "t.*")


def read_model_packages(models: DataFrame) -> DataFrame:
    """models with ``package``: the footer's JSON text, cut at its length; null where it is missing, short or broken."""
    f = F.col("footer")
    size = F.conv(F.hex(F.concat(*[F.substring(f, i, 1) for i in (12, 11, 10, 9)])), 16, 10).cast("long")
    good = (F.length(f) >= 12) & (F.hex(F.substring(f, 1, 4)) == PACKAGE_MAGIC.hex().upper()) & (F.length(f) - 12 >= size) & (size > 0)
    package = F.when(good, F.try_validate_utf8(F.substr(f, F.lit(13), size.cast("int")).cast("string")))
    return models.withColumn("package", F.when(F.try_parse_json(package).isNotNull(), package))


def with_package_fields(models: DataFrame) -> DataFrame:
    """models with title, task, feature_names, labels, params and curve of their ``package``; null where it has none.

    Feature names are lines behind a first one that holds the task and the
    labels as JSON. The task is the package's where it fits the outputs.
    """
    lines = F.split(F.get_json_object("package", "$.nft.featuresPacked"), "\n")
    has_meta = F.coalesce(F.startswith(lines[0], F.lit("#meta=")), F.lit(False))
    meta = F.when(has_meta, F.substr(lines[0], F.lit(7)))
    named = F.coalesce(F.get_json_object(meta, "$.task"), F.get_json_object("package", "$.local.trainMeta.task"))
    one = F.col("n_out") == 1
    fits = F.when(one, named.isin("regression", "binary_classification")).otherwise(named.isin("multiclass_classification", "multilabel_classification"))
    labels = F.coalesce(F.get_json_object(meta, "$.labelNames"), F.get_json_object(meta, "$.labels"))
    return models.select(
        *[c for c in models.columns if c != "task"], F.when(fits, named).otherwise(F.col("task")).alias("task"),
        F.get_json_object("package", "$.nft.title").alias("title"),
        F.when(has_meta, F.slice(lines, 2, 1 << 16)).otherwise(lines).alias("feature_names"),
        F.from_json(labels, "array<string>").alias("labels"),
        F.get_json_object("package", "$.local.trainParams").alias("params"),
        F.get_json_object("package", "$.local.trainMeta").alias("meta"),
        F.get_json_object("package", "$.local.curve").alias("curve"),
    )


def curve_rows(models: DataFrame) -> DataFrame:
    """(model_id, step, split, value) from the ``curve`` of packages: steps, train, val and test side by side."""
    told = F.from_json("curve", "steps array<int>, train array<double>, val array<double>, test array<double>")
    each = models.select("model_id", told.alias("c")).filter(F.col("c.steps").isNotNull())
    step = each.select("model_id", "c", F.posexplode("c.steps").alias("i", "step"))
    by_split = F.explode(F.create_map(*[x for s in ("train", "val", "test") for x in (F.lit(s), F.try_element_at(F.col(f"c.{s}"), F.col("i") + 1))]))
    return step.select("model_id", "step", by_split.alias("split", "value")).filter(F.col("value").isNotNull())


def package_of(task: str, title: str, features: Sequence[str], labels: Sequence[str], params: dict, curve: Sequence[tuple[int, str, str, float]], meta: dict) -> str:
    """The JSON of a package: how the model was trained and what its outputs are called."""
    told = {"v": 1, "task": task} | ({"labelNames": list(labels), "labels": ["0", "1"]} if task == "multilabel_classification" else {"labels": list(labels)} if labels else {})
    main = "mse" if task == "regression" else "logloss"
    steps = sorted({step for step, _, metric, _ in curve if metric == main})
    values = {(step, split): v for step, split, metric, v in curve if metric == main}
    return json.dumps({
        "v": 1, "nft": {"title": title, "featuresPacked": "\n".join([f"#meta={json.dumps(told)}", *features])},
        "local": {"trainMeta": {"task": task} | meta, "trainParams": params, "curve": {"steps": steps} | {s: [values.get((t, s)) for t in steps] for s in ("train", "val", "test")}},
    })


def write_model_files(models: DataFrame, path: str) -> None:
    """models (model_id, data) as one file each, model after model."""
    folder = Folder(models.sparkSession, path)
    for r in models.select("model_id", "data").toLocalIterator():  # one model at a time, 15 MB at most
        folder.write(f"{r['model_id']}.bin", bytes(r["data"]))


# ---- a store of models as tables ---------------------------------------------

STORE_BUCKETS = 32
STORED = ["model_id", "version", "n_features", "depth", "n_trees", "n_out", "scale_q", "base_q", "task", "title", "feature_names", "labels", "params", "meta"]


def write_store(models: DataFrame, path: str) -> None:
    """What read_models() gave as tables: models, trees in buckets by model, curve, and files that were rejected.

    ``models`` is read four times; settle it where reading files is dear.
    """
    good = with_package_fields(read_model_packages(models.filter(F.col("reason").isNull())))
    good.select(*STORED).write.parquet(f"{path}/models")
    curve_rows(good).write.parquet(f"{path}/curve")
    bucket = F.pmod(F.xxhash64("model_id"), F.lit(STORE_BUCKETS)).cast("int")
    trees_of(good).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/trees")
    models.filter(F.col("reason").isNotNull()).select("path", "bytes", "reason").write.parquet(f"{path}/rejected")


def read_store(spark: SparkSession, path: str, model_ids: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(head, trees) for predict.score_requests(); of named models only their buckets are read."""
    head, trees = spark.read.parquet(f"{path}/models"), spark.read.parquet(f"{path}/trees")
    if model_ids is not None:
        named = spark.createDataFrame([(m,) for m in model_ids], "model_id string")
        buckets = [r[0] for r in named.select(F.pmod(F.xxhash64("model_id"), F.lit(STORE_BUCKETS)).cast("int")).distinct().collect()]
        head = head.filter(F.col("model_id").isin(*model_ids))
        trees = trees.filter(F.col("bucket").isin(*buckets) & F.col("model_id").isin(*model_ids))
    return head, trees.drop("bucket")


def write_model_tables(run, spark: SparkSession, path: str, title: str = "", labels: Sequence[str] = (), params: dict | None = None) -> None:
    """One trained Run (see boost) as the tables of a store, with its curve and how it was made."""
    head, trees = run.ensemble.tables(spark)
    meta = json.dumps({"task": run.ensemble.task, "bestIter": run.best_iter, "bestValMetric": run.best_val})
    text = lambda v: F.lit(v).cast("string")
    names = F.array(*[F.lit(c) for c in run.ensemble.features]).cast("array<string>")
    rows = head.select("*", text(title).alias("title"), names.alias("feature_names"), F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias("labels"), text(json.dumps(params or {})).alias("params"), text(meta).alias("meta"))
    rows.select(*STORED).write.mode("append").parquet(f"{path}/models")
    bucket = F.pmod(F.xxhash64("model_id"), F.lit(STORE_BUCKETS)).cast("int")
    trees.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(f"{path}/trees")
    main = "mse" if run.ensemble.task == "regression" else "logloss"
    told = [(run.ensemble.model_id, step, split, value) for step, split, metric, value in run.curve if metric == main]
    spark.createDataFrame(told, "model_id string, step int, split string, value double").write.mode("append").parquet(f"{path}/curve")


# ---- bytes of models ---------------------------------------------------------


def encode_models(head: DataFrame, trees: DataFrame) -> DataFrame:
    """(model_id, data): each model's bytes; a model is the work of one task."""
    packed = trees.groupBy("model_id").agg(F.collect_list(F.struct("out", "tree", "feat", "thr", "leaf")).alias("trees"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                own: list[list[Tree]] = [[] for _ in range(r.n_out)]
                for t in sorted(r.trees, key=lambda t: (t["out"], t["tree"])):
                    own[t["out"]].append(Tree(*(np.array(t[c], np.int32) for c in ("feat", "thr", "leaf"))))
                out.append((r.model_id, encode(Ensemble(r.task, r.n_features, r.depth, r.scale_q, list(r.base_q), own))))
            yield pd.DataFrame(out, columns=["model_id", "data"])

    return head.join(packed, "model_id").mapInPandas(run, "model_id string, data binary")


def write_models(head: DataFrame, trees: DataFrame, path: str) -> None:
    encode_models(head, trees).write.parquet(path)


def attach_package(models: DataFrame, package: str = "package") -> DataFrame:
    """(model_id, data) with a footer of magic, version, length and JSON text."""
    body = F.encode(F.col(package), "UTF-8")
    n = F.lpad(F.hex(F.length(body).cast("long")), 8, "0")
    length = F.unhex(F.concat(*[F.substring(n, i, 2) for i in (7, 5, 3, 1)]))
    head = F.unhex(F.lit(PACKAGE_MAGIC.hex() + "01000000"))
    return models.withColumn("data", F.concat("data", head, length, body))


def chunk_blobs(models: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """(model_id, idx, total, data): the bytes in numbered chunks, each behind its magic."""
    if not 0 < size <= MAX_CHUNK:
        raise ValueError(f"chunks hold 1 to {MAX_CHUNK} bytes")
    n = F.ceil(F.length("data") / size).cast("int")
    at = models.select("model_id", F.length("data").cast("long").alias("total"), "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    piece = F.col("data").substr(F.col("idx") * size + 1, F.lit(size))
    return at.select("model_id", "idx", "total", F.concat(F.unhex(F.lit(CHUNK_MAGIC.hex())), piece).alias("data"))


def reassemble_chunks(chunks: DataFrame) -> DataFrame:
    """(model_id, data) from chunks in any order, cut at the total; wrong magic or missing bytes fail."""
    good = F.hex(F.substring("data", 1, 4)) == CHUNK_MAGIC.hex().upper()
    part = F.when(good, F.substring(F.hex("data"), 9, 2 * MAX_CHUNK)).otherwise(F.raise_error(F.lit("bad chunk magic")).cast("string"))
    rows = chunks.groupBy("model_id").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("idx", part.alias("h")))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["h"]), "")
    enough = F.length(whole) >= F.col("total") * 2
    cut = F.when(enough, F.substr(whole, F.lit(1), (F.col("total") * 2).cast("int"))).otherwise(F.raise_error(F.lit("chunks are missing")).cast("string"))
    return rows.select("model_id", F.unhex(cut).alias("data"))
