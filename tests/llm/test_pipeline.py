import collections
import random

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from tilework.llm import decontaminate, language, mixing


def plain_accept(rows):
    """Ids that the language stage keeps, row by row on one machine: the sample is all labelled rows of a small table."""
    seen = [language.ngram_counts(r["text"]) for r in rows]
    some = [c > 0 for c, r in zip(seen, rows) if c is not None and r["lang"] is not None]
    idf = np.log((1 + len(some)) / (1 + sum(some).astype(int))) + 1
    vectors = [None if c is None else language.tf_idf(c, idf) for c in seen]
    labelled = {(r["doc_id"], r["text"], r["lang"]): v for r, v in zip(rows, vectors) if v is not None and r["lang"] is not None}
    spark = SparkSession.getActiveSession()
    keys = spark.createDataFrame(list(labelled), "doc_id long, text string, lang string").select("*", F.xxhash64(F.lit(8), "doc_id", "text").alias("h")).collect()
    order = sorted(keys, key=lambda k: (k["h"], k["lang"]))
    train = [(labelled[k["doc_id"], k["text"], k["lang"]][0], labelled[k["doc_id"], k["text"], k["lang"]][1].astype(np.float32), k["lang"]) for k in order]
    labels, w, t, scores = language.cross_fit(train)
    kept = set()
    for r, v in zip(rows, vectors):
        if v is not None:
            p = language.softmax((v[1] @ w[v[0]] + w[language.SIZE]) / t).max()
            alike = [s for s, x in zip(scores, train) if len(x[0]) <= 2 * len(v[0])]
            if p >= language.least_score(len(labels)) or (1 + sum(s <= p for s in alike)) / (1 + len(alike)) > 0.02:
                kept.add(r["doc_id"])
    return kept


def test_each_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.settle(stage(spark, docs, SMALL), name)
        seen[name] = docs
        if name == "language_id":
            letters = {r["doc_id"] for r in before.collect() if any(c.isalpha() for c in r["text"] or "")}
            kept = {r["doc_id"] for r in docs.collect()}
            assert kept == plain_accept(before.collect()) and kept <= letters and len(kept) >= 0.98 * len(letters)
        if name == "decontamination":
            found = decontaminate.hit_runs(before, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in found.filter("n_hit = 0").collect()}
        if name == "mixture":
            want = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]})
            assert collections.Counter(r["doc_id"] for r in docs.collect()) == want
        if name != "shards":
            assert docs.columns == columns
    rows = docs.collect()
    assert len(rows) == seen["mixture"].count() and set(docs.columns) == {*columns, "shard", "slot"}
    by_shard = collections.Counter(r["shard"] for r in rows)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    again = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)


def test_language_stage_rejects_what_no_language_explains(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    r = random.Random(2)
    odd = {}
    for i, letters in enumerate(("абвгдежзиклмнопрст", "αβγδεζηθικλμνξ", "的一是不了人我在有他", "qxzjkvwbpfhg")):
        odd[10**6 + i] = " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(60))
    more = spark.createDataFrame([(i, t, None, "odd", len(t)) for i, t in odd.items()], docs.schema)
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, docs.union(more), SMALL).collect()}
    assert not kept & set(odd) and len(kept) >= 0.98 * docs.filter("text is not null").count()


def test_language_stage_without_labels_keeps_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, docs, SMALL).collect()}
    assert kept == {x["doc_id"] for x in docs.collect() if any(c.isalpha() for c in x["text"] or "")}


@pytest.mark.parametrize("k", [1, 3, 8, 20, 60])
def test_language_stage_with_few_labels_keeps_texts(spark, k):
    """The rule of rarity needs labelled texts to go by; with a few of them nearly all texts with a letter stay."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = [r["doc_id"] for r in docs.filter("n_chars > 200").orderBy("doc_id").limit(k).collect()]
    few = docs.withColumn("lang", F.when(F.col("doc_id").isin(*known), F.col("lang")))
    letters = [r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, few, SMALL).collect()}
    assert kept <= set(letters) and len(kept) >= 0.98 * len(letters)


def test_rarity_is_by_length():
    scores, lengths = np.linspace(0.5, 1, 200), np.repeat([10, 1000], 100)
    assert language.is_rare(0.3, 600, scores, lengths) and language.is_rare(0.3, 10, scores, lengths)
    assert not language.is_rare(0.3, 4, scores, lengths)  # no labelled text is as short
    assert not language.is_rare(0.52, 600, scores, lengths) and not language.is_rare(0.1, 600, scores[:40], lengths[:40])
