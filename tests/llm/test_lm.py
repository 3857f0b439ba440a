"""Language-model scores against a plain bit-by-bit mixer, and what they must not depend on."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tilework.llm import lm_scoring

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def scored(docs, train):
    return {r["doc_id"]: (r["score"], r["n_known"], round(r["base_score"], 6)) for r in lm_scoring.lm_scores(docs, train).collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(60)


def test_scores_equal_a_plain_mixer(spark, docs, monkeypatch):
    models, real = [], lm_scoring.gram_scores
    monkeypatch.setattr(lm_scoring, "gram_scores", lambda grams, model: models.append(model) or real(grams, model))
    train = docs.filter("doc_id % 3 <> 0")
    got = scored(docs, train)
    m = models[0]
    pad = b"\0" * 6
    follows = collections.defaultdict(collections.Counter)
    for r in train.collect():
        t = pad + (r["text"] or "").encode().translate(LOW) + b"\xff"
        for i in range(6, len(t)):
            for order in lm_scoring.ORDERS:
                follows[t[i - order : i]][t[i]] += 1

    def log_of(context, byte):
        out = 0.0
        letters = next((k for k in range(6) if context[5 - k] in b"\0\t\n\x0b\x0c\r "), 6)
        for j in range(8):
            x, degrees = [], []
            for order in lm_scoring.ORDERS:
                after = [(b, c) for b, c in follows.get(context[6 - order :], {}).items() if b >> (8 - j) == byte >> (8 - j)]
                total, one = sum(c for _, c in after), sum(c for b, c in after if b >> (7 - j) & 1)
                degrees.append(0 if not total else 1 if total < 3 else 2 if total < 8 else 3 if total < 32 else 4)
                x.append(min(255, max(0, round((math.log((one + 0.05) / (total - one + 0.05)) + 8) * 16))) / 16 - 8 if total else 0.0)
            longest = max((o for o, d in zip(lm_scoring.ORDERS, degrees) if d), default=0)
            w = m.weights[letters * 7 + longest]
            z = max(-12.0, min(12.0, sum(w[i, d] * v for i, (d, v) in enumerate(zip(degrees, x))) + w[6, 0] * 0.3))
            node = (256 | byte) >> (8 - j)
            place = (min(7.999, max(-7.999, z)) + 8) * 2
            low = int(place)
            p = (1 / (1 + math.exp(-z)) + m.refined[node, low] * (1 - place + low) + m.refined[node, low + 1] * (place - low)) / 2
            p = min(1 - 1e-6, max(1e-6, p))
            out += math.log10(p if byte >> (7 - j) & 1 else 1 - p)
        return out

    for r in docs.limit(12).collect():
        t = pad + (r["text"] or "").encode().translate(LOW) + b"\xff"
        assert got[r["doc_id"]][0] == pytest.approx(sum(log_of(t[i - 6 : i], t[i]) for i in range(6, len(t))), rel=1e-4)


def test_scores_do_not_depend_on_partitions_or_portions(docs, monkeypatch):
    want = scored(docs.coalesce(1), docs.coalesce(1))
    assert scored(docs.repartition(7), docs.repartition(5)) == want
    monkeypatch.setattr(lm_scoring, "PORTION", 3000)
    monkeypatch.setattr(lm_scoring, "HELD", 5000)
    assert scored(docs, docs) == want


def test_rare_words_and_grams_meet_their_values(docs, monkeypatch):
    want = scored(docs, docs)
    monkeypatch.setattr(lm_scoring, "WORDS", 50)
    monkeypatch.setattr(lm_scoring, "GRAMS", 500)
    assert scored(docs, docs) == want


def test_a_condition_learns_what_a_table_does(docs):
    assert scored(docs, F.col("doc_id") % 3 != 0) == scored(docs, docs.filter("doc_id % 3 <> 0"))


def test_better_than_the_word_base_line(spark):
    rows = lm_scoring.op5_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_all_bytes_after_a_context_add_up_to_one():
    r = np.random.default_rng(5)
    grams = np.unique(r.integers(0, 1 << 56, 3000, dtype=np.uint64) & np.uint64(0x03030303030303))
    n = r.integers(1, 40, len(grams))
    model = lm_scoring.Model([lm_scoring.ShortTable(o, grams, n) for o in lm_scoring.SHORT], refined=r.random((256, lm_scoring.CURVE)) * 0.8 + 0.1)
    model.weights += r.normal(0, 0.3, model.weights.shape)
    for context in (grams[5] & ~np.uint64(255), np.uint64(0x61626364656600)):
        asked = np.arange(256, dtype=np.uint64) + context
        assert (10 ** model.score(asked, lm_scoring.long_states(grams, n, asked))).sum() == pytest.approx(1)


def test_contexts_never_share_a_place():
    """Of 400,000 contexts all are told apart, and unseen ones stay unseen."""
    r = np.random.default_rng(3)
    grams = np.unique(r.integers(1 << 48, 1 << 56, 400_000, dtype=np.uint64))
    n = r.integers(1, 5, len(grams))
    asked = np.unique(np.concatenate((grams[::50], r.integers(0, 1 << 48, 4000, dtype=np.uint64))))
    logit, degree = lm_scoring.long_states(grams, n, asked)
    for i, order in enumerate(lm_scoring.LONG):
        followed = collections.defaultdict(collections.Counter)
        for k, c in zip(grams.tolist(), n.tolist()):
            followed[k >> 8 & (1 << 8 * order) - 1][k & 255] += c
        for a, k in enumerate(asked.tolist()):
            after = followed.get(k >> 8 & (1 << 8 * order) - 1, {})
            for j in range(8):
                here = [(b, c) for b, c in after.items() if b >> (8 - j) == (k & 255) >> (8 - j)]
                total, one = sum(c for _, c in here), sum(c for b, c in here if b >> (7 - j) & 1)
                assert degree[a, i, j] == lm_scoring._DEGREE[min(total, 255)]
                if total:
                    p = (one + 0.05) / (total + 0.1)
                    assert abs(logit[a, i, j] - np.clip((np.log(p / (1 - p)) + 8) * 16, 0, 255)) <= 0.51


def test_wide_ends_give_the_same_scores(docs, monkeypatch):
    """Contexts dealt by four to six bytes, with what followed their shorter ends from outside."""
    want, models, real = scored(docs, docs), [], lm_scoring.gram_scores
    monkeypatch.setattr(lm_scoring, "gram_scores", lambda grams, model: models.append(model) or real(grams, model))
    monkeypatch.setattr(lm_scoring, "WIDE", 40)
    monkeypatch.setattr(lm_scoring, "PIECE", 100)
    assert scored(docs.repartition(5), docs) == want
    assert models[0].ends.wide.any(axis=1).all() and all(len(models[0].ends.followed[o][0]) for o in (3, 4, 5))


def test_a_frequent_end_of_contexts_is_not_one_bucket(spark, monkeypatch):
    """A seventh of all grams follow the same three bytes, and a fourteenth the same four."""
    r = np.random.default_rng(9)
    letters = np.array(list("defghijklmnopqrstuvwxyz"))
    rows = []
    for i in range(40):
        drawn = letters[r.integers(0, len(letters), (2000, 4))]
        drawn[::2, 2] = "c"
        rows.append((i, "".join(f"{a}{b}{c}abc{d}" for a, b, c, d in drawn)))
    monkeypatch.setattr(lm_scoring, "WIDE", 1 << 12, raising=False)
    sizes, real = [], lm_scoring.settle

    def settle(df, label, *how):
        out = real(df, label, *how)
        if label == "counts":
            sizes.extend(x[0] for x in out.filter("gram").select(F.length("keys") / 8).collect())
        return out

    monkeypatch.setattr(lm_scoring, "settle", settle)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert lm_scoring.lm_scores(docs, docs).count() == 40
    assert max(sizes) < sum(sizes) / 16, (max(sizes), sum(sizes))
