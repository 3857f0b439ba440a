"""Hard negatives against a plain search over all pairs."""

import math
import random

import numpy as np
import pytest

from tilework.llm import negatives


def plain(rows, anchors, k=5, n=5):
    """rows: (vec_id, label, vector); the definition, pair by pair."""
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (aid, alabel, av) in enumerate(ok):
        if not anchors(aid):
            continue
        told = [(-max(min(sum(x * y for x, y in zip(av, v)), negatives.MOST), negatives.LEAST), i, lab, at) for at, (i, lab, v) in enumerate(ok)]
        told.sort(key=lambda t: t[:2])
        mine = [t for t in told if t[2] == alabel and t[3] != a][:k]
        for ps, pid, *_ in mine:
            fits = [(ns, i) for ns, i, lab, _ in told if lab != alabel and 80 * -ps <= 100 * -ns <= 100 * -ps][:n]
            out += [(aid, pid, r + 1, i, -ps, -ns) for r, (ns, i) in enumerate(fits)]
    return sorted(out)


def vectors(r, n, dim, labels, same=0):
    hot = [r.gauss(0.1, 0.2) for _ in range(dim)]
    return [(i, r.randrange(labels), hot if r.random() < same else [r.gauss(0.05, 0.2) for _ in range(dim)]) for i in range(n)]


SCHEMA = "vec_id long, label int, embedding array<float>"


def told(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("same, rows_a_cell, anchors_a_cell", [(0, 8192, 2048), (0.4, 50, 3), (1.0, 60, 2)])
def test_as_plain(spark, monkeypatch, same, rows_a_cell, anchors_a_cell):
    monkeypatch.setattr(negatives, "ROWS", rows_a_cell)
    monkeypatch.setattr(negatives, "ANCHORS", anchors_a_cell)
    df = spark.createDataFrame(vectors(random.Random(3), 240, 6, 3, same), SCHEMA)
    rows = [tuple(r) for r in df.collect()]
    found = told(negatives.mine(df, "id % 20 = 0"))
    assert found == plain(rows, lambda i: i % 20 == 0) and found


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [1.0, 0.5]), (2, 2, [1.0, 0.5]), (3, 2, [0.9, 0.5]), (None, 2, [1.0, 1.0]), (4, None, [1.0, 1.0]), (5, 2, None),
        (6, 2, [None, 1.0]), (7, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [1.0]), (10, 2, []), (11, 1, [-1.0, -1.0]), (20, 3, [0.1, 0.1]), (40, 1, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as id", "3 as q", "'x' as key")
    padded = [(i, lab, v if v is None else v + [0.0] * (2 - len(v))) for i, lab, v in [tuple(r) for r in df.select("vec_id", "label", "embedding").collect()]]
    assert told(negatives.mine(df, "id % 20 = 0")) == plain(padded, lambda i: i % 20 == 0)
    assert told(negatives.mine(df.limit(0), "id % 20 = 0")) == []
    assert told(negatives.mine(df.filter("label = 1"), "id % 20 = 0")) == []
    assert told(negatives.mine(df, "id = 999")) == []


def test_large_components_are_exact():
    r = random.Random(5)
    for high in (2**20, 2**28, 2**40):
        a, b = (np.array([[r.randint(-high, high) for _ in range(4)] for _ in range(5)]) for _ in range(2))
        exact = [[max(min(sum(int(x) * int(y) for x, y in zip(u, v)), negatives.MOST), negatives.LEAST) for v in b] for u in a]
        assert negatives.products(a, b).tolist() == exact


def test_keys_sort():
    r = random.Random(1)
    keys = [(r.randrange(3), r.choice([negatives.MOST, negatives.LEAST, 0, -1, 1, r.randint(-9, 9)]), r.randrange(2), r.choice([-(2**63), 2**63 - 1, r.randint(-5, 5)])) for _ in range(400)]
    packed = sorted(negatives.pack(*k) for k in keys)
    assert [negatives.unpack(k) for k in packed] == sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))


def test_iterator_holds_one_anchor():
    """A positive opens its window; a negative closes nothing and goes to all windows that it fits."""
    P, N = negatives.POSITIVE, negatives.NEGATIVE
    pairs = [(1, 100, P, 7), (1, 100, N, 8), (1, 90, P, 9), (1, 85, N, 3), (1, 75, N, 4), (2, 50, N, 1), (2, 40, P, 2), (2, 33, N, 5), (2, 31, N, 6)]
    stream = ((negatives.pack(*p), p[0] * 100) for p in pairs)
    assert list(negatives.windows(stream, 2, (80, 100))) == [(100, 7, 1, 8, 100, 100), (100, 7, 2, 3, 100, 85), (100, 9, 1, 3, 90, 85), (100, 9, 2, 4, 90, 75), (200, 2, 1, 5, 40, 33)]
