"""Open listings as a table in buckets that a stream keeps current.

A token's events are in the bucket of its hash. A micro-batch reads and
writes only the buckets that its tokens fall into, as new files, and then
writes a manifest that says for each bucket which batch wrote it last. Readers
follow the newest manifest, so they see whole batches; files that no manifest
names any more are deleted a few batches later.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.operators import catalog
from tilework.sources.shared import Folder

COLUMNS = ["token_id", "block", "log_index", "kind", "amount", "actor"]
KINDS = ("listed", "cancelled", "bought")
BUCKETS = 64
#: Manifests that stay readable.
KEPT = 2


def _manifests(folder: Folder) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in folder.names("manifests") if n.endswith(".json"))


def _manifest(folder: Folder, n: int) -> dict[int, str]:
    """Where each bucket is, as of batch n."""
    return {int(b): at for b, at in json.loads(folder.read(f"manifests/{n}.json")).items()}


def merge_listings(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """(token_id, block, log_index, kind, amount, actor): the events that still matter.

    Of each token those since it was last closed, or the closing one. An event
    that comes twice counts once; order does not matter.
    """
    rows = batch.filter(F.col("kind").isin(*KINDS)).select(*COLUMNS)
    rows = rows if state is None else state.select(*COLUMNS).unionByName(rows)
    when = F.struct("block", "log_index")
    closed = rows.groupBy("token_id").agg(F.max(F.when(F.col("kind") != "listed", when)).alias("closed"))
    kept = rows.join(closed, "token_id").filter(F.col("closed").isNull() | (when >= F.col("closed")))
    return kept.select(*COLUMNS).distinct()


def bucket_of(token: str, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_batch(batch: DataFrame, n: int, path: str, buckets: int = BUCKETS) -> None:
    """Bring the table up to date with batch n.

    A batch that is tried again starts from the manifest before it and writes
    its own files anew, so the table ends the same. A batch without an event
    of these kinds writes a manifest only.
    """
    folder = Folder(batch.sparkSession, path)
    before = [m for m in _manifests(folder) if m < n]
    now = _manifest(folder, before[-1]) if before else {}
    mine = batch.filter(F.col("kind").isin(*KINDS)).select(*COLUMNS).withColumn("bucket", bucket_of("token_id", buckets))
    touched = sorted(r["bucket"] for r in mine.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    folder.delete(f"data/{n}")
    if touched:
        known = [f"{path}/{now[b]}" for b in touched if b in now]
        state = batch.sparkSession.read.schema(mine.drop("bucket").schema).parquet(*known) if known else None
        merged = merge_listings(state, mine).withColumn("bucket", bucket_of("token_id", buckets))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{n}")
    folder.write(f"manifests/{n}.json", json.dumps(now | {b: f"data/{n}/bucket={b}" for b in touched}))
    _compact(folder, n)


def _compact(folder: Folder, n: int) -> None:
    """Delete manifests before the last few, and the files that none of those left names."""
    known = [m for m in _manifests(folder) if m <= n]
    kept = known[-KEPT:]
    named = {at for m in kept for at in _manifest(folder, m).values()}
    for m in known[:-KEPT]:
        folder.delete(f"manifests/{m}.json")
    for batch in folder.names("data"):
        if int(batch) > n:
            continue
        used = {at.rpartition("/")[2] for at in named if at.startswith(f"data/{batch}/")}
        if not used and int(batch) not in kept:
            folder.delete(f"data/{batch}")
        elif int(batch) not in kept:
            for bucket in folder.names(f"data/{batch}"):
                if bucket.startswith("bucket=") and bucket not in used:
                    folder.delete(f"data/{batch}/{bucket}")


def stream_listings(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Keep the open listings under ``path`` current; returns the query's writer."""
    return events.writeStream.foreachBatch(lambda batch, n: write_batch(batch, n, path, buckets)).option("checkpointLocation", checkpoint)


def current_listings(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(token_id, price, seller) as of batch n, or of the newest."""
    folder = Folder(spark, path)
    known = _manifests(folder)
    at = [f"{path}/{x}" for x in _manifest(folder, known[-1] if n is None else n).values()] if known else []
    kinds = "token_id long, block long, log_index int, kind string, amount decimal(38,0), actor string"
    state = spark.read.schema(kinds).parquet(*at) if at else spark.createDataFrame([], kinds)
    return catalog.listings_from_events(state)
