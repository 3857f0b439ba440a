"""Scoring and cleaning over streams; access and listings have modules of their own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.operators import clean
from tilework.operators.model import Ensemble
from tilework.operators.predict import predict
from tilework.streaming.access import current_access, keep_batches, stream_access  # noqa: F401
from tilework.streaming.listings import current_listings, stream_listings  # noqa: F401
def stream_score(requests: DataFrame, ensemble: Ensemble, features: Sequence[str] | None = None) -> DataFrame:
    """A stream of requests with their scores; no state."""
    return predict(requests, ensemble, features)


def stream_clean(rows: DataFrame, task: str, labels: Sequence[str], features: Sequence[str], classes: Sequence[str] = ()) -> DataFrame:
    """A stream of text rows with ``reason``; the kept ones are those with reason 'kept'."""
    return rows.withColumn("reason", clean.drop_reason(task, labels, features, classes))


def clean_batches(task: str, labels: Sequence[str], features: Sequence[str], classes: Sequence[str], out: str, report: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: kept rows to ``out``, the batch's drop report to ``report``."""
    def run(batch: DataFrame, n: int) -> None:
        told = stream_clean(batch, task, labels, features, classes)
        told.filter("reason = 'kept'").drop("reason").write.mode("overwrite").parquet(f"{out}/batch={n}")
        told.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{report}/batch={n}")

    return run
