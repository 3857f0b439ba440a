"""Recall on given documents, the leader path at its real size, and hot keys."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tilework.llm import jaccard_join, substring_dedup

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text):
    w = (text or "").encode().translate(LOW).split()
    return frozenset(b" ".join(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([b" ".join(w)] if w else [])


def links_of(sets):
    """Linked pairs of different sets, exactly: a pair at 0.8 shares one of the rarest fifth of either's shingles."""
    often = collections.Counter(g for s in sets for g in s)
    at, out = collections.defaultdict(list), []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        s = sets[i]
        rare = sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-4 * len(s) // 5) + 1]
        for j in {j for g in rare for j in at[g] if 5 * len(sets[j]) >= 4 * len(s)}:
            both = len(s & sets[j])
            if both * 5 >= (len(s) + len(sets[j]) - both) * 4:
                out.append((i, j))
        for g in rare:
            at[g].append(i)
    return out


def test_recall_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rep = {}
    for r in docs.orderBy("doc_id").collect():
        s = shingles(r["text"])
        if s:
            rep.setdefault(s, r["doc_id"])
    sets, ids = list(rep), list(rep.values())
    want = collections.Counter(ids[x] for pair in links_of(sets) for x in pair)
    got = {r["text_class"]: r["n_links"] for r in jaccard_join.op9_jaccard_join(spark, "/root/testdata/sf0.1").collect() if r["n_links"]}
    assert sum(want.values()) > 50
    assert sum(min(got.get(i, 0), n) for i, n in want.items()) >= 0.99 * sum(want.values()) and all(n <= want[i] for i, n in got.items())


def test_leaders_of_a_large_node(spark):
    """1,600 near copies, far more than a node compares at once, in a bucket of the real size's proportions."""
    r = random.Random(4)
    base = ["w%d" % r.randrange(10**6) for _ in range(150)]
    texts = []
    for _ in range(1600):
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = "x%d" % r.randrange(10**6)
        texts.append(" ".join(t))
    sets = list(dict.fromkeys(shingles(t) for t in texts))
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(shingles(t), i)
    want = collections.Counter(first[sets[x]] for pair in links_of(sets) for x in pair)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["text_class"]: x["n_links"] for x in jaccard_join.jaccard_join(df, bucket=200).collect()}
    assert sum(got.values()) == sum(want.values()) and all(got[i] == n for i, n in want.items())


def test_sizes_far_apart_in_one_cluster(spark):
    """A chain of ever longer beginnings of one text: one cluster over many bands of size, cut into blocks."""
    r = random.Random(6)
    words = ["w%d" % r.randrange(10**6) for _ in range(1200)]
    texts = [" ".join(words[: 40 + 4 * k]) for k in range(290)]
    r.shuffle(texts)
    want = collections.Counter(x for pair in links_of([shingles(t) for t in texts]) for x in pair)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.jaccard_join(df, block=16).collect()
    assert {x["doc_id"]: x["n_links"] for x in got} == dict(want)
    assert {x["class_id"] for x in got} == {0}


def test_passage_in_unlike_texts(spark):
    """Texts that share a passage but are not alike stay apart as candidates, also where a node's leaders meet."""
    r = random.Random(8)
    passage = ["p%d" % i for i in range(60)]
    own = [["w%d" % r.randrange(10**7) for _ in range(60)] for _ in range(500)]
    own += [[*w[:30], "x%d" % i, *w[31:]] for i, w in enumerate(own[:20])]
    texts = [" ".join([*passage, *w]) for w in own]
    want = collections.Counter(x for pair in links_of([shingles(t) for t in texts]) for x in pair)
    assert len(want) == 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_links"] for x in jaccard_join.jaccard_join(df, bucket=20).collect() if x["n_links"]}
    assert got == dict(want)
    sets = jaccard_join.survey(df).select(F.col("doc_id").alias("rep"), "tokens", "sig")
    ties = {(min(t), max(t)) for t in jaccard_join.candidates(sets, bucket=20).collect()}
    assert {(i, 500 + i) for i in range(20)} <= ties and len(ties) < 60


def test_leaders_meet_in_blocks(spark):
    df = spark.range(50).select(F.lit(1).cast("long").alias("node"), F.col("id").alias("rep"), F.lit(b"x").alias("sig"))
    groups = collections.defaultdict(set)
    for r in jaccard_join.leader_pairs(df, 10).collect():
        groups[r["node"]].add(r["rep"])
    assert max(map(len, groups.values())) <= 40
    assert all(any({a, b} <= g for g in groups.values()) for a in range(50) for b in range(a))


def test_hot_keys_are_met_by_broadcast(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7 * F.when(F.col("id") < 500, 0).otherwise(1)).alias("k"))
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for hot in (100, 10**6):
        assert sorted(r["id"] for r in substring_dedup.met(rows, keys, ["k"], hot).collect()) == list(range(1000))


@pytest.mark.parametrize("hot", [2, 50])
def test_cut_with_hot_windows(spark, monkeypatch, hot):
    r = random.Random(1)
    shared = " ".join(r.choice("abcdefgh") for _ in range(20))
    texts = [f"u{i} {shared} v{i}" for i in range(60)] + ["p q r s t u v w x y " * 2] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {x["doc_id"]: (x["n_removed"], x["kept_sha256"]) for x in substring_dedup.deduplicate(df, window=8, gram=3).collect()}
    monkeypatch.setattr(substring_dedup.met, "__defaults__", (hot,))
    assert want == {x["doc_id"]: (x["n_removed"], x["kept_sha256"]) for x in substring_dedup.deduplicate(df, window=8, gram=3).collect()}
    assert want[0][0] == 0 and all(want[i][0] == 20 for i in range(1, 60)) and want[61][0] == 20
