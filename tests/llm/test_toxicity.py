"""That pairs of terms decide, that scores are a factorization machine's, and what is bounded."""

import random
import re

import numpy as np
import pytest

from tilework.llm import toxicity

SOUNDS = ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "zu"]


def invented(r, n):
    return ["".join(r.choice(SOUNDS) for _ in range(r.randint(1, 4))) for _ in range(n)]


def planted(spark, n=900, seed=1):
    """Toxic are texts with both an insult and a group mention; either alone is clean."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = invented(r, 30) + (["grobian"] if insult else []) + (["nachbarn"] if group else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def right(docs, labels, machine):
    rows = toxicity.score(docs, machine, 0.5).join(labels, "doc_id").collect()
    return sum(x["predicted"] == x["toxic"] for x in rows) / len(rows)


def test_pairs_decide_through_learn(spark):
    docs, labels = planted(spark)
    machine = toxicity.learn(docs, labels)
    later, truth = planted(spark, 400, 2)
    assert right(later, truth, machine) > 0.97
    whole = right(later, truth, machine)
    machine.v[:] = 0
    assert right(later, truth, machine) < whole - 0.05


def test_a_hot_group_of_copies_does_not_hide_an_insult(spark):
    """A third of the labelled rows are one toxic text; other toxic rows share its insult."""
    r = random.Random(3)
    rows = [(i, " ".join(invented(r, 40) + (["grobian", "nachbarn"] if i % 8 == 0 else [])), int(i % 8 == 0)) for i in range(400)]
    rows += [(400 + i, "grobian nachbarn " + "ba de fi " * 10, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert right(df.select("doc_id", "text"), df.select("doc_id", "toxic"), toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))) > 0.98


def plain_terms(text):
    out = {}
    for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))):
        for part in [("word", w)] + [(n, w[:n]) for n in toxicity.BEGINNINGS if len(w) >= n]:
            out[part] = out.get(part, 0) + 1
    return {(*part, i) for part, n in out.items() for i, least in enumerate(toxicity.LEVELS) if n >= least}


def test_terms_are_words_and_beginnings_by_times():
    rows = ["Alpha alphabet ALPHA beta".encode(), b"", "über überall, 12é3".encode(), b"alpha"]
    row, term = toxicity.terms(rows)
    assert [int((row == i).sum()) for i in range(len(rows))] == [len(plain_terms(t)) for t in rows]
    names = {}
    for i, t in enumerate(rows):
        alone = toxicity.terms([t])[1]
        assert sorted(alone) == sorted(term[row == i])
        names.setdefault(t, set(alone))
    shared = len(plain_terms(rows[0]) & plain_terms(rows[3]))
    assert len(names[rows[0]] & names[rows[3]]) == shared


def test_scores_equal_a_plain_machine(spark):
    docs, labels = planted(spark, 300)
    m = toxicity.learn(docs, labels)
    place = {int(t): i for i, t in enumerate(m.kept)}
    for x in toxicity.score(docs, m).join(docs, "doc_id").collect():
        at = [place[int(t)] for t in toxicity.terms([x["text"].encode()])[1] if int(t) in place]
        z = m.b + sum(m.w[a] for a in at) + sum(float(m.v[a] @ m.v[b]) for i, a in enumerate(at) for b in at[:i])
        assert x["score"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_sample_and_pairs_are_bounded(spark, monkeypatch):
    docs, labels = planted(spark, 400)
    monkeypatch.setattr(toxicity, "PAIRS", 500)
    seen = []
    real = toxicity.fitted
    monkeypatch.setattr(toxicity, "fitted", lambda kept, row, term, y: seen.append(len(row)) or real(kept, row, term, y))
    toxicity.learn(docs, labels, most=200)
    assert seen and seen[0] <= 700


def test_one_label_or_none(spark):
    docs, labels = planted(spark, 40)
    for some, share in ((labels.filter("toxic = 0"), 0.2), (labels.limit(0), 0.5)):
        rows = toxicity.score(docs, toxicity.learn(docs, some)).collect()
        assert len(rows) == 40 and all(0 <= r["score"] <= max(share, 0.5) for r in rows)
