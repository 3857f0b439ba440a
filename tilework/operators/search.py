"""Search over training parameters by hill climbing."""

from __future__ import annotations

import dataclasses
import itertools
import json
import math
import statistics
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.functions import clamp_for_size
from tilework.operators.boost import Params, Run, fit_together, prepare, train
from tilework.sources.shared import discard

TRIALS = "round int, status string, params string, best_val double, best_iter int, error string"


@dataclasses.dataclass(frozen=True)
class Range:
    """Where a parameter may lie; ``log`` ones are walked in the logarithm."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def to_unit(self, value: float) -> float:
        value = min(self.high, max(self.low, value))
        if self.log:
            return math.log(value / self.low) / math.log(self.high / self.low)
        return (value - self.low) / (self.high - self.low)

    def from_unit(self, u: float) -> float:
        u = min(1.0, max(0.0, u))
        value = self.low * (self.high / self.low) ** u if self.log else self.low + u * (self.high - self.low)
        return round(value) if self.whole else float(f"{value:.6g}")


RANGES = {
    "trees": Range(10, 5000, log=True, whole=True),
    "depth": Range(1, 12, whole=True),
    "lr": Range(0.001, 1.0, log=True),
    "min_leaf": Range(1, 1000, log=True, whole=True),
    "patience": Range(1, 500, log=True, whole=True),
    "plateau_patience": Range(1, 1000, log=True, whole=True),
    "plateau_factor": Range(0.01, 0.99),
    "lr_min": Range(1e-6, 1.0, log=True),
}


def moved_parameters(p: Params) -> list[str]:
    """The names that a search moves under the schedule and stopping of p."""
    out = ["trees", "depth", "lr", "min_leaf"]
    out += ["patience"] if p.early_stop else []
    out += ["plateau_patience", "plateau_factor", "lr_min"] if p.schedule == "plateau" else []
    return out


def candidate(base: Params, best: Params | None, round_: int, seed: int, task: str, n_out: int, widest: float = 0.35, least: float = 0.08) -> Params:
    """Parameters for a round: a step from the best so far in the unit cube of RANGES.

    One rule for all: every parameter moves by a triangular draw whose width
    shrinks with the rounds; every fifth round starts from the base again.
    """
    rng = np.random.default_rng([seed, round_])
    middle = base if best is None or round_ % 5 == 0 else best
    width = max(least, widest / math.sqrt(round_))
    new = {}
    for name in moved_parameters(base):
        r = RANGES[name]
        new[name] = r.from_unit(r.to_unit(getattr(middle, name)) + width * float(rng.triangular(-1, 0, 1)))
    new["trees"], new["depth"] = clamp_for_size(new["trees"], new["depth"], task, n_out)
    return dataclasses.replace(base, **new)


class Medians:
    """Ends a trial whose loss is above the median of the finished trials' best losses up to the same round."""

    def __init__(self, warm: int):
        self.warm, self.curves = warm, []

    def watch(self, step: int, value: float) -> bool:
        known = [c[min(step, len(c)) - 1] for c in self.curves]
        return step >= self.warm and len(known) >= 2 and value > statistics.median(known)

    def finished(self, run: Run) -> None:
        metric = "mse" if run.ensemble.task == "regression" else "logloss"
        parts = {part for _, part, m, _ in run.curve if m == metric}
        losses = [v for _, part, m, v in run.curve if m == metric and part == ("val" if "val" in parts else "train")]
        if losses:
            self.curves.append(list(itertools.accumulate(losses, min)))


def search(df: DataFrame, features: Sequence[str], task: str, base: Params, rounds: int = 10, seed: int = 42, cap_trees: int | None = None, parallel: int = 1, end_early: int | None = None, **more) -> tuple[Run | None, DataFrame]:
    """The best run and the table of trials; the first round is the base. A failing trial is noted, not fatal.

    The data are quantised, binned and written once for all trials. After the
    base, trials run in waves of ``parallel``, in step: the passes of a wave
    over the rows serve all of its trials. All of a wave step from the best
    before it, so the result does not depend on which ends first. With
    ``end_early`` a trial is ended from that round on when it is worse than the
    median of the waves before.
    """
    spark = df.sparkSession
    base = dataclasses.replace(base, bins=max(8, min(512, base.bins)))
    prepared = prepare(df, features, task, base, **more)
    medians = Medians(end_early) if end_early is not None else None

    best_run, best_params, rows, r = None, None, [], 1
    try:
        while r <= rounds:
            wave = range(r, min(r + (parallel if r > 1 else 1), rounds + 1))
            trials = [(i, base if i == 1 else candidate(base, best_params, i, seed, task, more.get("n_out", 1))) for i in wave]
            if cap_trees:
                trials = [(i, dataclasses.replace(p, trees=min(p.trees, cap_trees))) for i, p in trials]
            ended = fit_together(prepared, [p for _, p in trials], watch=medians.watch if medians else None)
            told = [(None, str(e)[:500]) if isinstance(e, Exception) else (e, None) for e in ended]
            for (i, p), (run, error) in zip(trials, told):
                text = json.dumps({k: v for k, v in dataclasses.asdict(p).items() if k != "extra"})
                if run is None:
                    rows.append((i, "error", text, None, None, error))
                    continue
                rows.append((i, "stopped" if run.stopped else "done", text, run.best_val, run.best_iter, None))
                if not run.stopped and run.best_val is not None and (best_run is None or run.best_val < best_run.best_val):
                    best_run, best_params = run, p
            if medians:
                for run, _ in told:
                    if run is not None and not run.stopped:
                        medians.finished(run)
            r = wave[-1] + 1
    finally:
        discard(prepared[0])
    return best_run, spark.createDataFrame(rows, TRIALS)


def best_trial(trials: DataFrame) -> DataFrame:
    """The finished trial of least finite loss; the earlier of equal ones."""
    ok = trials.filter((F.col("status") == "done") & F.col("best_val").isNotNull() & ~F.isnan("best_val") & (F.abs("best_val") < float("inf")))
    return ok.withColumn("_r", F.row_number().over(W.orderBy("best_val", "round"))).filter("_r = 1").drop("_r")


def refit(df: DataFrame, features: Sequence[str], task: str, p: Params, trees: int, **more) -> Run:
    """Train on train and validation rows for a fixed number of trees."""
    return train(df, features, task, dataclasses.replace(p, trees=trees, early_stop=False), refit=True, **more)


def trial_page(trials: DataFrame, page: int, size: int = 25) -> DataFrame:
    return trials.orderBy("round").offset(page * size).limit(size)


