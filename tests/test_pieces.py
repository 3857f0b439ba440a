"""What a task computes beside its Arrow batch does not grow with the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tilework.operators import blocks, boost
from tilework.operators.model import Ensemble, Tree


class Caught:
    """Stands for a table: keeps the function that would be mapped over it."""

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def __getattr__(self, _):
        return lambda *a, **k: self


def binned(n_blocks, rows=blocks.ROWS):
    rng = np.random.default_rng(n_blocks)
    cell = lambda v: v.tobytes()
    made = {"n": [], "split": [], "x": [], "xq": [], "bins": [], "y": [], "score": []}
    for _ in range(n_blocks):
        x, y = rng.integers(0, 1000, (rows, 4)), rng.integers(-(1 << 31), 1 << 31, rows)
        parts = {"n": rows, "split": cell(rng.integers(0, 3, rows).astype(np.uint8)), "x": cell(x.astype(float)), "xq": cell(x.astype(np.int32)), "bins": cell((x % 32).astype(np.uint16)), "y": cell(y.astype(np.int64)), "score": cell(np.zeros(rows))}
        for c, v in parts.items():
            made[c].append(v)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "n" else pa.binary()) for c, v in made.items()], list(made))


def a_pass(level):
    caught = Caught()
    grown = [Tree.blank(2)]
    grown[0].feat[0], grown[0].thr[0] = 1, 500
    drawn = {(0, node): [3, 0] for node in ((0,) if level == 0 else (1, 2))}
    boost.level_pass(caught, Ensemble("regression", 4, 2, 1, [0], [[]]), [[]], grown, level, drawn, 32, None, level == 0)
    return caught.run


def others():
    ranges, scored = Caught(), Caught()
    blocks.with_bins(ranges, 1000, [(0.0, 1000.0)] * 4, 32, None, [0], 1, False)
    boost._with_scores(scored, [[Tree.blank(2)]], 2, 4)
    return ranges.run, scored.run


@pytest.mark.parametrize("which", range(4))
def test_memory_beside_the_batch(spark, which):
    run, peaks = (a_pass(0), a_pass(1), *others())[which], []
    for n in (50, 300):
        batch = binned(n)
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] and peaks[1] < 60 << 20, peaks


@pytest.mark.parametrize("level", [0, 1])
def test_sums_of_pieces(spark, level):
    """One batch, many batches and plain sums give the same rows."""
    batch = binned(37, 50)
    told = lambda got: sorted(tuple(r.values()) for b in got for r in b.to_pylist() if r["kind"] != boost.METRIC)
    whole = told(a_pass(level)(iter([batch])))
    assert whole == told(a_pass(level)(iter([batch.slice(0, 5), batch.slice(5, 31), batch.slice(36, 1)])))
    x, b = blocks.packed(batch, "xq", np.int32, 4), blocks.packed(batch, "bins", np.uint16, 4)
    y, train = blocks.packed(batch, "y", np.int64, 1)[:, 0], blocks.packed(batch, "split", np.uint8, 1)[:, 0] == 0
    node = 1 + (x[:, 1] > 500) if level else np.zeros(len(x), int)
    plain = {}
    for i in np.flatnonzero(train):
        for key in [(boost.TOTAL, node[i], -1, 0, 0)] + [(boost.HIST, node[i], f, d, b[i, f]) for d, f in enumerate((3, 0))]:
            n, g = plain.get(key, (0, 0))
            plain[key] = n + 1, g + int(y[i])
    assert {(r[0], r[2], r[3], r[4], r[5]): (r[6], r[7]) for r in whole} == plain


def test_large_sums_stay_exact():
    at, value = np.array([0, 1, 0]), np.array([(1 << 53) + 1, -(1 << 54) - 3, 1])
    assert boost._summed(at, value, 3).tolist() == [(1 << 53) + 2, -(1 << 54) - 3, 0]
    assert boost._summed(at, None, 3).tolist() == [2, 1, 0]
