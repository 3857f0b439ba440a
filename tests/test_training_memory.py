"""Each pass that training makes holds a piece of its Arrow batch, whatever is trained and for whom."""

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

    def collect(self):
        return []

    def __getattr__(self, _):
        return lambda *a, **k: self


def binned(n_blocks):
    """Blocks of all cells, y is 0 or 1."""
    rng, made = np.random.default_rng(n_blocks), {c: [] for c in ("n", "split", "x", "xq", "bins", "y", "score")}
    for _ in range(n_blocks):
        x = rng.integers(0, 1000, (blocks.ROWS, 4))
        cells = [rng.integers(0, 3, blocks.ROWS).astype(np.uint8), x.astype(float), x.astype(np.int32), (x % 32).astype(np.uint16), rng.integers(0, 2, blocks.ROWS), np.zeros(blocks.ROWS)]
        for c, v in zip(made, [blocks.ROWS, *(v.tobytes() for v in cells)]):
            made[c].append(v)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "n" else pa.binary()) for c, v in made.items()], list(made))


def a_level(task="regression", level=0, measure=False, since=0, growing=True):
    """A pass over the rows, after ``since`` trees."""
    caught, tree = Caught(), Tree.blank(2)
    tree.feat[0], tree.thr[0] = 1, 500
    drawn = {(0, node): [3, 0] for node in ((0,), (1, 2))[level]} if growing else {}
    boost.level_pass(caught, Ensemble(task, 4, 2, 1000, [0], [[]]), [[tree] * since], [tree] if growing else None, level, drawn, 32, None, measure)
    return caught.run


def of(make, *args):
    caught = Caught()
    make(caught, *args)
    return caught.run


CASES = {
    "m_search": lambda: a_level(level=1, since=1),  # a node's rows in a trial's second tree
    "m_train_regression": lambda: a_level(measure=True, since=3, growing=False),  # the last of the curve
    "m_importance": lambda: a_level("binary_classification", measure=True),  # hessians and losses
    "k_model_round_trip": lambda: of(blocks.ranges_of, 4),  # the scale of the stored model
    "m_refit": lambda: of(blocks.targets, 1),  # the starting score, of validation rows too
    "m_root_histogram": lambda: a_level(),  # the root alone, nothing measured
}


@pytest.mark.parametrize("query", CASES)
def test_memory_beside_the_batch(spark, query):
    run, peaks = CASES[query](), []
    for n in (50, 300):
        batch = binned(n)
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] and peaks[1] < 60 << 20, peaks
