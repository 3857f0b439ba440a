"""The divergence audit against plain loops over terms, and its trees."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tilework.llm import divergence

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain(rows, least=10, top=10):
    docs = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOW)) for _, _, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        df, counts = Counter(), {}
        for (g, s, _), words in zip(docs, terms):
            if g == lang:
                df.update(set(words))
                counts.setdefault(s, Counter()).update(words)
        kept = [t for t in df if df[t] >= least]
        whole = sum(counts.values(), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            best = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o.decode(), -v, r + 1) for r, (v, o) in enumerate(pairs)]
            out += [(lang, s, "term", o.decode(), -v, r + 1) for r, (v, o) in enumerate(best)]
    return sorted(out)


def texts(r, n, vocabulary):
    return [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None]), " ".join(r.choice(vocabulary[: 5 + r.randrange(len(vocabulary))]) for _ in range(r.randrange(60)))) for _ in range(n)]


def told(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block, band, held", [(4096, 64, 400_000), (8, 2, 40)])
def test_as_plain(spark, monkeypatch, block, band, held):
    for name, value in (("BLOCK", block), ("BAND", band), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abÉzQß") for _ in range(r.randint(1, 4))) for _ in range(70)]
    rows = texts(r, 300, vocabulary) + [("xx", "only", "one"), ("yy", "p", ""), ("yy", "q", None), ("yy", None, "few 12 words")] + [("en", "a", "Same tie text")] * 12
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as term", "2 as n", "3 as total", "4 as block")
    found = told(divergence.audit(df))
    assert found == plain(rows)
    assert any(x[2] == "term" for x in found) and ("yy", "p", "pair", "q", 0, 2) in found


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert told(divergence.audit(none)) == []
    one = spark.createDataFrame([(None, None, None)], none.schema)
    assert told(divergence.audit(one)) == []


def test_long_text_is_read_whole(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PORTION", 50)
    text = " ".join(f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz" * 20) + " " + "x" * 500
    rows = [("en", "a", text)] * 10 + [("en", "b", "wa")]
    assert told(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"))) == plain(rows)


def test_equal_subtrees_are_one_node():
    counts = np.array([[0, 0, 1, 2, 0, 0, 1, 2], [0, 0, 1, 2, 0, 0, 0, 0], [5, 0, 1, 2, 0, 0, 1, 2]])
    roots, leaves, levels = divergence.consed(counts)
    assert leaves.tolist() == [0, 1, 2, 5] and [len(left) for left, _ in levels] == [3, 3, 3] and len(set(roots)) == 3
    walk, a, b, times = divergence.walks(roots[[0, 0]], roots[[1, 2]], levels)
    met = Counter({(w, int(leaves[x]), int(leaves[y])): int(t) for w, x, y, t in zip(walk, a, b, times)})
    assert met == Counter((w, int(x), int(y)) for w, o in ((0, 1), (1, 2)) for x, y in zip(counts[0], counts[o]))


def test_walk_opens_equal_pairs_once():
    """Groups that repeat one pattern over 2**16 terms are compared in a few steps."""
    counts = np.tile(np.array([[0, 1, 0, 2], [0, 0, 3, 2]]), (1, 1 << 14))
    roots, leaves, levels = divergence.consed(counts)
    assert sum(len(left) for left, _ in levels) == 34
    walk, a, b, times = divergence.walks(roots[:1], roots[1:], levels)
    assert len(walk) == 4 and times.sum() == 1 << 16


def test_huge_counts_are_exact():
    counts, total, terms = np.array([0, 7, 10**12]), 10**13, 10**6
    assert divergence.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]
    p, q = np.array([10**9 + 1, 1, 5]), np.array([1, 10**9 + 1, 5])
    assert divergence.prices(p, q).tolist() == [(int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p, q)]


def test_zero_subtrees_are_left_out():
    counts = np.array([[0, 0, 0, 3, 0, 1, 0, 0], [1, 1, 1, 3, 1, 1, 1, 1]])
    roots, leaves, levels = divergence.consed(counts)
    row, place, a, b = divergence._occurring(roots[:1], roots[1:], leaves, levels)
    assert sorted(zip(row.tolist(), place.tolist(), leaves[a].tolist(), leaves[b].tolist())) == [(0, 3, 3, 3), (0, 5, 1, 1)]


def test_products_of_levels_have_no_repeats():
    grid = np.array(list(product([0, 1], repeat=4)))
    roots, _, levels = divergence.consed(grid)
    assert len(set(roots.tolist())) == 16 and [len(left) for left, _ in levels] == [4, 16]
