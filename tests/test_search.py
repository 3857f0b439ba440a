"""Search on shared data: the same best trial in waves as one after another, data prepared once, hopeless trials ended."""

import numpy as np
import pytest

from tilework.operators import boost, search, split

BASE = boost.Params(trees=3, depth=2, lr=0.3, min_leaf=3, early_stop=True, patience=10)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    data = [(i, *map(float, r), float(3 * r[0] + (r[1] > 0))) for i, r in enumerate(x)]
    return split.seeded_split(spark.createDataFrame(data, ["id", "a", "b", "c", "y"]), "id").cache()


def told(df):
    return [(r["round"], r["status"], r["params"], r["best_val"]) for r in df.orderBy("round").collect()]


def test_waves_end_as_one_after_another(rows, monkeypatch):
    prepared = []
    prepare = search.prepare
    monkeypatch.setattr(search, "prepare", lambda *a, **b: prepared.append(1) or prepare(*a, **b))
    run, trials = search.search(rows, ["a", "b", "c"], "regression", BASE, rounds=4, cap_trees=3, parallel=3)
    alone = []
    for r, _, params, value in told(trials):
        p = search.candidate(BASE, BASE, r, 42, "regression", 1) if r > 1 else BASE
        one = boost.train_regression(rows, ["a", "b", "c"], boost.dataclasses.replace(p, trees=min(3, p.trees)))
        assert value == pytest.approx(one.best_val, abs=1e-12)
        alone.append(one.best_val)
    assert run.best_val == pytest.approx(min(alone), abs=1e-12) and len(prepared) == 1


def test_hopeless_trials_are_ended(rows, monkeypatch):
    """A rate of next to nothing is worse than the median from the first rounds on."""
    slow = {3: 1e-3, 4: 1e-3}
    monkeypatch.setattr(search, "candidate", lambda base, best, r, *a: boost.dataclasses.replace(base, lr=slow.get(r, 0.3 + r / 100)))
    run, trials = search.search(rows, ["a", "b", "c"], "regression", BASE, rounds=4, end_early=1, parallel=1)
    status = [(r, s) for r, s, _, _ in told(trials)]
    assert status == [(1, "done"), (2, "done"), (3, "stopped"), (4, "stopped")] and run.best_val == min(v for _, s, _, v in told(trials) if s == "done")


def test_a_trial_that_fails_is_noted(rows, monkeypatch):
    monkeypatch.setattr(search, "candidate", lambda base, *a: boost.dataclasses.replace(base, schedule="piecewise", segments=((3, 1, 0.1),)))
    run, trials = search.search(rows, ["a", "b", "c"], "regression", BASE, rounds=2)
    assert [s for _, s, _, _ in told(trials)] == ["done", "error"] and run is not None


def test_a_wave_reads_the_rows_once_for_all_its_trials(rows, monkeypatch):
    """Trials of depth 1, 2 and 3 and two trees ask for 5, 7 and 9 passes; the wave makes 9, and each run is what it is alone."""
    made, whole = [], boost.shared_pass
    monkeypatch.setattr(boost, "shared_pass", lambda asks, *a: made.append(len(asks)) or whole(asks, *a))
    runs = [boost.dataclasses.replace(BASE, trees=2, depth=d, min_leaf=4 * d, lr=0.1 * d) for d in (1, 2, 3)]
    prepared = boost.prepare(rows, ["a", "b", "c"], "regression", BASE)
    together = boost.fit_together(prepared, runs)
    assert made == [3] * 5 + [2] * 2 + [1] * 2
    for p, run in zip(runs, together):
        alone = boost.fit(prepared, p)
        assert [r[:3] for r in alone.curve] == [r[:3] for r in run.curve] and alone.best_val == pytest.approx(run.best_val, abs=1e-12)
        for a, b in zip(alone.ensemble.trees[0], run.ensemble.trees[0], strict=True):
            assert (a.feat.tolist(), a.thr.tolist(), a.leaf.tolist()) == (b.feat.tolist(), b.thr.tolist(), b.leaf.tolist())


def test_trials_of_a_wave_go_apart_with_scores_of_their_own(rows):
    """Several classes, scores written after every tree, one trial that fails and one that is ended."""
    labelled = rows.withColumn("y", (boost.F.col("y") > 0).cast("int") + (boost.F.col("y") > 2).cast("int"))
    runs = [boost.dataclasses.replace(BASE, depth=d, keep_every=1) for d in (1, 2)] + [boost.dataclasses.replace(BASE, schedule="piecewise", segments=((3, 1, 0.1),))]
    prepared = boost.prepare(labelled, ["a", "b", "c"], "multiclass_classification", BASE, n_out=3)
    first, second, failed = boost.fit_together(prepared, runs, watch=lambda step, value: step == 2)
    assert isinstance(failed, ValueError) and first.stopped and second.stopped
    for p, run in zip(runs, (first, second)):
        alone = boost.fit(prepared, p, watch=lambda step, value: step == 2)
        assert alone.curve == [(*r[:3], pytest.approx(r[3], abs=1e-12)) for r in run.curve]
        assert [[t.leaf.tolist() for t in own] for own in alone.ensemble.trees] == [[t.leaf.tolist() for t in own] for own in run.ensemble.trees]
