"""From model files to scores: tolerant reading, packages, the store, requests that are refused."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.operators import boost, predict
from tilework.operators.model import Ensemble, Tree
from tilework.plans.models import k_file_to_model
from tilework.sources import models


def ensemble(task, outputs, model_id):
    tree = lambda k: Tree(np.array([0, 1, 1], np.int32), np.array([10, 5, 2**31 - 1], np.int32), np.array([1, 2, 3, 4], np.int32) * (k + 1))
    return Ensemble(task, 2, 2, 10, list(range(outputs)), [[tree(k), tree(k + 1)] for k in range(outputs)], model_id, features=["a", "b"])


ALL = [("regression", 1), ("binary_classification", 1), ("multiclass_classification", 3), ("multilabel_classification", 2)]
CURVE = [(1, "train", "logloss", 0.5), (1, "val", "logloss", 0.6), (1, "val", "accuracy", 0.9), (2, "train", "logloss", 0.4)]


def package(task):
    return models.package_of(task, "Ünïcode title", ["a", "b"], ["x", "y"] if task != "regression" else [], {"trees": 2}, CURVE if task != "regression" else [(1, "train", "mse", 4.0)], {"bestIter": 1})


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Four good models with packages, one without, and bytes that are no models."""
    path = tmp_path_factory.mktemp("models")
    rows = []
    for task, outputs in ALL:
        e = ensemble(task, outputs, task)
        rows.append((task, bytearray(models.encode(e)), package(task)))
    df = spark.createDataFrame(rows, "model_id string, data binary, package string")
    models.write_model_files(models.attach_package(df), str(path))
    plain = models.encode(ensemble("regression", 1, "plain"))
    bad = {"short": plain[:20], "magic": b"XXXX" + plain[4:], "version": plain[:4] + b"\x09" + plain[5:], "truncated": plain[:-1]}
    outputs = bytearray(models.encode(ensemble("multiclass_classification", 3, "x")))
    outputs[22:24] = b"\x01\x00"
    bad["outputs"] = bytes(outputs)
    for name, data in {"plain": plain, **bad}.items():
        (path / f"{name}.bin").write_bytes(data)
    footer = models.PACKAGE_MAGIC + b"\x01\0\0\0" + (9).to_bytes(4, "little")
    (path / "tail.bin").write_bytes(plain + footer + b'{"meta":1}'[:9] + b"")
    (path / "cut.bin").write_bytes(plain + models.PACKAGE_MAGIC + b"\x01\0\0\0" + (10).to_bytes(4, "little") + b'{"meta":1}\0tail')
    (path / "far.bin").write_bytes(plain + models.PACKAGE_MAGIC + b"\x01\0\0\0" + (99).to_bytes(4, "little") + b"{}")
    return models.read_models(spark, str(path))


def test_bad_files_do_not_stop_the_others(files):
    told = {os.path.basename(r["path"]).removesuffix(".bin"): r["reason"] for r in files.select("path", "reason").collect()}
    assert {k: v for k, v in told.items() if v} == {"short": "short", "magic": "magic", "version": "version", "truncated": "truncated", "outputs": "outputs"}
    assert sum(v is None for v in told.values()) == 8


def test_package_is_cut_at_its_length(files):
    told = {r["model_id"]: r["package"] for r in models.read_model_packages(files).collect() if r["model_id"]}
    assert told["cut"] == '{"meta":1}' and told["tail"] is None and told["far"] is None and told["plain"] is None
    assert json.loads(told["regression"])["nft"]["title"] == "Ünïcode title"


def test_task_names_and_curve_come_from_the_package(files):
    good = models.with_package_fields(models.read_model_packages(files.filter("reason is null")))
    told = {r["model_id"]: r for r in good.collect()}
    assert {m: told[m]["task"] for m, _ in ALL} == {m: m for m, _ in ALL} and told["plain"]["task"] == "regression"
    assert told["multilabel_classification"]["feature_names"] == ["a", "b"] and told["multilabel_classification"]["labels"] == ["x", "y"] and told["plain"]["labels"] is None
    assert json.loads(told["regression"]["params"]) == {"trees": 2}
    curve = sorted(tuple(r) for r in models.curve_rows(good).collect())
    assert ("regression", 1, "train", 4.0) in curve and ("binary_classification", 2, "train", 0.4) in curve and ("binary_classification", 1, "val", 0.6) in curve
    assert not [c for c in curve if c[0] == "binary_classification" and c[1:3] == (2, "val")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_files_to_scores(spark, files, tmp_path, limit):
    path = str(tmp_path / "store")
    models.write_store(files, path)
    assert spark.read.parquet(f"{path}/rejected").count() == 5
    head, trees = models.read_store(spark, path, ["regression", "multiclass_classification"])
    assert {r["model_id"] for r in trees.select("model_id").distinct().collect()} == {"regression", "multiclass_classification"}
    asked = [(0, "regression", [1.0, 0.3]), (1, "regression", [1.0, 9.0]), (2, "multiclass_classification", [2.0, 0.0]), (3, "gone", [1.0, 1.0]), (4, "regression", [1.0]), (5, "regression", [1.0, 2.0, 3.0]), (6, "regression", None), (7, "regression", [1.0, None]), (8, "regression", [float("nan"), 1.0]), (9, None, [1.0, 1.0]), (10, "regression", [])]
    df = spark.createDataFrame(asked, "request_id int, model_id string, features array<double>")
    told = {r["request_id"]: r for r in predict.score_requests(df, head, trees, block=2, broadcast_bytes=limit).collect()}
    assert {i: r["reason"] for i, r in told.items() if r["reason"]} == {3: "unknown_model", 4: "feature_count", 5: "feature_count", 6: "feature_count", 7: "bad_feature", 8: "bad_feature", 9: "unknown_model", 10: "feature_count"}
    assert [told[i]["score_q"] for i in (0, 1, 2)] == [[0 + 1 + 2], [0 + 2 + 4], [0 + 3 + 6, 1 + 6 + 9, 2 + 9 + 12]]
    assert all(told[i]["score_q"] is None for i in told if told[i]["reason"])


def test_trained_model_as_tables(spark, tmp_path):
    run = boost.Run(ensemble("binary_classification", 1, "own"), CURVE, 2, 0.4)
    models.write_model_tables(run, spark, str(tmp_path), "title", ["no", "yes"], {"trees": 2})
    head = spark.read.parquet(f"{tmp_path}/models").first()
    assert (head["task"], head["labels"], head["feature_names"], json.loads(head["meta"])["bestIter"]) == ("binary_classification", ["no", "yes"], ["a", "b"], 2)
    assert spark.read.parquet(f"{tmp_path}/curve").count() == 3
    assert models.read_store(spark, str(tmp_path))[1].count() == 2


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_a_wanted_model_is_not_one_task(spark, limit):
    """Nearly all requests name one model: they stay where they are, and with many models meet it in several tasks."""
    one, other = ensemble("regression", 1, "one"), ensemble("multiclass_classification", 3, "other")
    (h1, t1), (h2, t2) = one.tables(spark), other.tables(spark)
    model = F.when(F.col("id") % 50 == 0, "other").when(F.col("id") % 51 == 0, "gone").otherwise("one")
    asked = spark.range(3000).select(F.col("id").alias("request_id"), model.alias("model_id"), F.array(F.lit(1.0), F.col("id") / 300).alias("features"))
    told = [predict.score_requests(asked, h1.union(h2), t1.union(t2), block=500, broadcast_bytes=limit, broadcast_models=m) for m in (0, 100)]
    few, many = [sorted(map(str, t.collect())) for t in told]
    assert few == many and len(few) == 3000 and sum("unknown_model" in r for r in few) == len([i for i in range(3000) if i % 50 and i % 51 == 0])
    was = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    for c, v in zip(was, ("-1", "false")):
        spark.conf.set(c, v)
    try:
        met = predict._beside(asked, h1.union(h2).select("model_id", "n_features"), True, "left").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in met) < 1800
        known = predict._beside(asked, h1.union(h2).select("model_id", "n_features"), False, "left")
        assert "SortMergeJoin" not in known._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_a_job_is_judged_by_its_file(spark, tmp_path, monkeypatch):
    """Scores are those of the bytes on disk: a file with other leaves, or without its last tree, is not alike."""
    rows = [(i, i % 29, i % 5, 1, float(i % 50 + 1), (i % 50 + 1) * 1500.0, i % 10 / 100, i % 8 / 100, "N") for i in range(1, 600)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    told = lambda: {r["what"]: r["n"] for r in k_file_to_model(spark, str(tmp_path)).collect()}
    alike = {f"scores alike: {s}": 1 for s in ("train", "val", "test")}
    whole = told()
    assert alike.items() <= whole.items()
    write = models.encode_models
    for other in (lambda h, t: write(h, t.withColumn("leaf", F.transform("leaf", lambda v: -v))), lambda h, t: write(h.withColumn("n_trees", F.lit(1)), t.filter("tree = 0"))):
        monkeypatch.setattr(models, "encode_models", other)
        assert told() == {k: n for k, n in whole.items() if k not in alike}
