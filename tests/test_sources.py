import pytest
from pyspark.sql import functions as F

from tilework.operators import catalog, clean, profile, split
from tilework.sources import delimited, models


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    path = tmp_path / "x.csv"
    path.write_text(f"﻿a{sep} b {sep}c\n1{sep}\"x{sep}\"\"q\"\"\"{sep}3\n\n{sep}{sep}\n4{sep}5\n6{sep}7{sep}8{sep}9\n", encoding="utf-8")
    df = delimited.read_delimited(spark, str(path))
    assert df.columns == ["a", "b", "c"]
    assert sorted(map(tuple, df.collect())) == [("1", f'x{sep}"q"', "3"), ("4", "5", ""), ("6", "7", "8")]


def test_no_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2\n3,4\n")
    assert delimited.read_delimited(spark, str(tmp_path / "x.csv"), "comma", header=False).columns == ["c0", "c1"]


def test_chunks_in_any_order(spark):
    data = spark.createDataFrame([("m", bytearray(range(256)) * 3)], "model_id string, data binary")
    chunks = models.chunk_blobs(data, 100)
    assert chunks.count() == 8
    back = models.reassemble_chunks(chunks.orderBy(F.col("idx").desc())).first()["data"]
    assert bytes(back) == bytes(range(256)) * 3
    with pytest.raises(Exception, match="missing"):
        models.reassemble_chunks(chunks.filter("idx <> 7")).collect()
    with pytest.raises(ValueError):
        models.chunk_blobs(data, 30_000)


def test_packages(spark):
    df = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "model_id string, data binary")
    packed = models.attach_package(df.withColumn("package", F.lit('{"v":1}'))).select("model_id", F.substring("data", 2, 999).alias("footer"))
    bad = packed.withColumn("footer", F.when(F.col("model_id") == "a", F.col("footer")).otherwise(F.lit(b"oops")))
    assert {r["model_id"]: r["package"] for r in models.read_model_packages(bad).collect()} == {"a": '{"v":1}', "b": None}


def test_columns_by_name_and_place(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, b int, c int")
    assert clean.resolve_columns(df, ["a", 2, "b"]) == ["A", "c", "b"]
    assert clean.select_features(df, ["b", "B"], None) == (["b"], ["A", "c"])
    with pytest.raises(ValueError):
        clean.resolve_columns(df, ["zz"])


def test_default_mapping():
    assert clean.default_binary_mapping(["0", "5"], True) == ("0", "5")
    assert clean.default_binary_mapping(["ham", "spam"], False) == ("ham", "spam")
    assert clean.default_binary_mapping(["other", "yes"], False) == ("other", "yes")
    assert clean.default_binary_mapping(["blue", "red"], False) == ("blue", "red")
    with pytest.raises(ValueError, match="two labels"):
        clean.default_binary_mapping(["a", "b", "c"], False)
    assert clean.default_binary_mapping(["1", "2", "7"], True, True) == ("1", "7")
    assert clean.default_binary_mapping(["a", "ham", "no", "Spam", "yes"], False, True) == ("ham", "Spam")
    assert clean.default_binary_mapping(["no", "other", "zebra"], False, True) == ("no", "other")
    assert clean.default_binary_mapping(["a", "true", "yes"], False, True) == ("a", "true")
    assert clean.default_binary_mapping(["false", "no"], False) == ("false", "no")


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        clean.check_usable(spark.range(2), 3)


def test_tiny_splits(spark):
    for n in (3, 4, 10):
        counts = {r["split"]: r["count"] for r in split.seeded_split(spark.range(n), "id").groupBy("split").count().collect()}
        assert sum(counts.values()) == n and len(counts) == 3
        a, b = split.split_sizes(n, 0.7, 0.2)
        assert counts["train"] == a and counts["val"] == b - a


def test_rare_class_falls_back(spark):
    df = spark.range(1).withColumn("c", F.lit(1))
    assert split.stratified_split(df, "id", "c").count() == 1


def test_weight_for_a_label_without_negatives(spark):
    df = spark.createDataFrame([([1, 0],), ([1, 1],)], "labels array<int>")
    rows = profile.label_pos_weights(df, 2).orderBy("label").collect()
    assert rows[0]["w"] == 1e-6 and rows[1]["w"] == 1.0


def test_access_fold(spark):
    rows = [(5, 0, "access_bought"), (7, 0, "access_bought"), (100, 0, "access_bought"), (101, 0, "access_revoked"), (101, 1, "access_granted"), (102, 0, "access_bought"), (103, 0, "access_revoked"), (104, 0, "access_bought")]
    events = spark.createDataFrame([("m", "k", 0, *r) for r in rows], "model_id string, key string, plan_id int, block long, log_index int, kind string")
    plans = spark.createDataFrame([("m", 0, 10)], "model_id string, plan_id int, duration_blocks long")
    got = [int(r["expiry"]) for r in catalog.access_history(events, plans).orderBy("block", "log_index").collect()]
    never = 18446744073709551615
    assert got == [15, 25, 110, 0, never, never, 0, 114]


def test_texts_are_parsed_once_for_the_split(spark, tmp_path, monkeypatch):
    """The split reads usable rows three times; it reads them as numbers, and they are deleted afterwards."""
    from tilework.operators import boost, job

    (tmp_path / "rows.csv").write_text("id,a,b,label\n" + "".join(f"{i},{i % 7},{'x' if i == 5 else i / 3},{' Yes' if i % 2 else 'no'}\n" for i in range(60)))
    kept, gone = {}, []
    settle, discard = job.settle, job.discard

    def settled(df, label):
        out = settle(df, label)
        kept[label] = {f.name: f.dataType.simpleString() for f in out.schema}, out.count(), out
        return out

    monkeypatch.setattr(job, "settle", settled)
    monkeypatch.setattr(job, "discard", lambda *t: (gone.extend(t), discard(*t)))
    done = job.train_file(spark, str(tmp_path / "rows.csv"), str(tmp_path / "out"), "binary_classification", ["label"], params=boost.Params(trees=1, depth=1, early_stop=False), row_id="id")
    types, n, table = kept["usable"]
    assert types["a"] == types["b"] == "double" and types["y"] == "int" and n == 59 and any(t is table for t in gone)
    assert {r["reason"]: r["n"] for r in done.report.collect()} == {"kept": 59, "bad_feature": 1}
