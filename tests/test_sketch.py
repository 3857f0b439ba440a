"""The quantile sketch: its stated error holds, in any order and however it is merged."""

import numpy as np
import pytest

from tilework.operators import sketch
from tilework.operators.binning import quantile_thresholds

AT = [j / 32 for j in range(1, 32)]


def off_by(values, cuts):
    """The largest distance of a cut's exact ranks from where it should be."""
    ranked, n = np.sort(values), len(values)
    low, high = np.searchsorted(ranked, cuts, "left"), np.searchsorted(ranked, cuts, "right")
    want = np.array(AT) * n
    return np.maximum(np.maximum(low - want, want - high), 0).max()


@pytest.mark.parametrize("kind", ["rising", "falling", "random", "ties", "one"])
def test_error_is_as_stated(kind):
    rng, n = np.random.default_rng(1), 50_000
    x = {"rising": np.arange(n), "falling": -np.arange(n), "random": rng.normal(size=n), "ties": rng.integers(0, 5, n), "one": np.full(n, 7)}[kind].astype(float)
    s = sketch.Sketch(1, 64)
    s.add(x[:, None])
    bound = s.shift + (1 << (len(s.levels) - 1))
    assert off_by(x, s.quantiles(AT)[0]) <= bound < 0.2 * n and s.rows == n
    assert sum(v.shape[1] << h for h, v in enumerate(s.levels)) == n


def test_merged_sketches_keep_their_bound():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=(40_000, 3)), axis=0)
    whole = sketch.Sketch(3, 128)
    for part in np.array_split(x, 37):
        own = sketch.Sketch(3, 128)
        own.add(part)
        whole.merge(own)
    assert whole.rows == len(x) and max(v.shape[1] for v in whole.levels) < 256
    for f, cuts in enumerate(whole.quantiles(AT)):
        assert off_by(x[:, f], cuts) <= whole.shift + (1 << (len(whole.levels) - 1))
        assert (np.diff(cuts) >= 0).all()


def test_small_tables_are_exact():
    s = sketch.Sketch(2, 1024)
    x = np.random.default_rng(3).normal(size=(500, 2))
    s.add(x)
    assert s.shift == 0 and off_by(x[:, 1], s.quantiles(AT)[1]) <= 1


def test_all_rows_of_many_features(spark, monkeypatch):
    monkeypatch.setattr(sketch, "GROUPS", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 20))
    df = spark.createDataFrame(x.tolist(), [f"f{i}" for i in range(20)]).repartition(5)
    told = {r["feature"]: r for r in sketch.quantile_sketch(df, df.columns, 32, size=64).collect()}
    assert len(told) == 20 and 0 < told["f3"]["error"] < 0.3
    for i in range(20):
        assert off_by(x[:, i], told[f"f{i}"]["thresholds"]) <= told[f"f{i}"]["error"] * len(x)
    assert quantile_thresholds(df, ["f1"], 8).columns == ["feature", "thresholds"]
    assert sketch.quantile_sketch(df.limit(0), ["f0"]).collect() == []
