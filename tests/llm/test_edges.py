"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for all operators."""

import random

import pytest
from pyspark.sql import functions as F

from tilework.llm import decontaminate, exact_dedup, jaccard_join, language, lm_scoring, mixing, secrets, sharding, substring_dedup, toxicity

CLASH = ["o", "tk", "row", "key", "size", "rep", "node", "shard", "slot", "n", "keys", "src", "copies", "_h", "turn"]


def word(r):
    return "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))


@pytest.fixture(scope="module")
def edge(spark):
    r = random.Random(1)
    long = " ".join(word(r) for _ in range(60_000))
    shared = " ".join(word(r) for _ in range(80))
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n", "de", None), (4, "one", None, "s"), (5, long, "en", "s"), (6, long, "en", "t"),
        (7, f"x {shared} y", "en", None), (8, f"{shared} z", "de", "t"), (8, f"{shared} z", "de", "t"), (None, f"{shared} w", "de", "t"), (None, None, None, None),
        (9, "12 34 !!", "en", "s"), (10, "é ü ñ " * 30, "de", "u"), (11, "A" * 100_000, "en", "u"), (8, "other text with eight", "en", "t"), (12, "a\0b c\0", "en", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (3, None), (2, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "12 34"), (3, "é ü ñ é")], "item_id long, text string").withColumn("key", F.lit(1))


OPERATORS = {
    "mix": lambda d, l, i: mixing.mix(d),
    "toxicity": lambda d, l, i: toxicity.score(d, toxicity.learn(d, l)),
    "secrets": lambda d, l, i: secrets.secrets(d),
    "decontaminate": lambda d, l, i: decontaminate.hit_runs(d, i),
    "lm": lambda d, l, i: lm_scoring.lm_scores(d, d),
    "exact": lambda d, l, i: exact_dedup.exact_groups(d),
    "language": lambda d, l, i: language.identify(d, d),
    "shards": lambda d, l, i: sharding.shard_documents(d, 3),
    "jaccard": lambda d, l, i: jaccard_join.jaccard_join(d),
    "substring": lambda d, l, i: substring_dedup.deduplicate(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(edge, labels, items, name):
    out = OPERATORS[name](edge, labels, items).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in edge.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(edge, labels, items, name):
    none = edge.limit(0)
    assert OPERATORS[name](none, labels.limit(0), items.limit(0)).collect() == []


@pytest.mark.parametrize("stage", [lambda d, i: language.accept(d, d), lambda d, i: jaccard_join.keep_one(d), lambda d, i: decontaminate.clean(d, i), lambda d, i: mixing.apply_mix(d), lambda d, i: sharding.place(d, 3).drop("shard", "slot")])
def test_stages_keep_columns(edge, items, stage):
    plain = edge.drop("shard", "slot")
    out = stage(plain, items)
    assert out.columns == [c for c in plain.columns if c not in ("shard", "slot")]
    assert {str(r["doc_id"]) for r in out.collect()} <= {str(r["doc_id"]) for r in plain.collect()}
    assert stage(plain.limit(0), items.limit(0)).collect() == []


def test_place_replaces_its_own_columns(edge):
    out = sharding.place(edge, 3)
    assert sorted(out.columns) == sorted(edge.columns) and out.count() == edge.count()
    assert {r["shard"] for r in out.select("shard").collect()} <= {0, 1, 2}
    assert sharding.place(edge.limit(0), 3).collect() == []


@pytest.mark.parametrize("name", ["jaccard", "substring"])
def test_ids_are_whole_numbers(edge, labels, items, name):
    with pytest.raises(ValueError, match="whole number"):
        OPERATORS[name](edge.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), labels, items)
    small = edge.filter("doc_id < 9").withColumn("doc_id", F.col("doc_id").cast("int"))
    assert OPERATORS[name](small, labels, items).count() == small.count()


def test_exact_groups_edges(edge):
    rows = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(edge).collect()]
    assert (1, 2, 3, False) in rows and (2, 2, 3, True) in rows and (5, 6, 2, False) in rows
    assert sorted(r for r in rows if r[0] == 8 and r[2] == 2) == [(8, 8, 2, False), (8, 8, 2, True)]


def test_unknown_language(edge):
    told = {r["doc_id"]: r["lang_pred"] for r in language.identify(edge, edge).collect() if r["doc_id"]}
    assert {told[i] for i in (1, 2, 3, 9)} == {"und"} and "und" not in {told[i] for i in (4, 5, 7, 10)}


def test_equal_ids_keep_each_others_words(edge):
    cut = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.deduplicate(edge).collect()}
    assert cut[7, 82] == 0 and cut[8, 81] == 80 and cut[None, 81] == 80 and cut[6, 60_000] == 60_000 and cut[5, 60_000] == 0
