"""Paid access over an event log, as a scan in segments.

A purchase at block b of d blocks takes the expiry e to max(e, b) + d, a grant
sets it to "never ends", a revocation to 0. All of these, and everything that
follows from applying several, are of two forms: ``max(e, a) + s`` for some
(a, s), or a fixed value. So the events of a (model, key) need not be walked
in one place: they are cut into ranges of blocks, each range is folded into
one such function, the functions are scanned over the few ranges, and every
row applies what its own range gives up to it to the expiry that comes in.
A key with most of all events is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.functions import NEVER
from tilework.sources.shared import settle

KINDS = ("access_bought", "access_granted", "access_revoked")
#: Events of one range of blocks over all keys, about; and ranges at most.
RANGE_ROWS, MOST_RANGES = 200_000, 4096
BLOCKS = "decimal(20,0)"


def never() -> Column:
    return F.lit(str(NEVER)).cast(BLOCKS)


def _zero() -> Column:
    return F.lit(0).cast(BLOCKS)


def when() -> Column:
    return F.struct("block", "log_index")


def block_ranges(df: DataFrame, rows: int = RANGE_ROWS, most: int = MOST_RANGES) -> list[float]:
    """Inner bounds of block ranges that hold about ``rows`` rows each; none where one range does.

    A count, and one aggregation where there are several ranges; the driver
    gets the bounds, ``most`` numbers at most.
    """
    n = min(most, -(-df.agg(F.count("block")).first()[0] // rows))
    if n <= 1:
        return []
    at = ", ".join(repr(i / n) for i in range(1, n))
    cuts = df.agg(F.expr(f"percentile_approx(block, array({at}), {4 * most})")).first()[0]
    return sorted({float(c) for c in cuts})


def with_range(df: DataFrame, bounds: list[float]) -> DataFrame:
    """df with ``range``, the number of the block's range; whole keys are one range without bounds."""
    if not bounds:
        return df.withColumn("range", F.lit(0))
    placed = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_at", outputCol="_range", handleInvalid="keep")
    return placed.transform(df.withColumn("_at", F.col("block").cast("double"))).withColumn("range", F.col("_range").cast("int")).drop("_at", "_range")


def access_events(events: DataFrame, plans: DataFrame) -> DataFrame:
    """(model_id, key, block, log_index, kind, d) of the events that change an expiry; a plan that is not known lasts 0 blocks."""
    mine = events.filter(F.col("kind").isin(*KINDS)).join(plans.select("model_id", "plan_id", "duration_blocks"), ["model_id", "plan_id"], "left")
    d = F.when(F.col("kind") == "access_bought", F.coalesce("duration_blocks", F.lit(0))).otherwise(0).cast(BLOCKS)
    return mine.select("model_id", "key", "block", "log_index", "kind", d.alias("d"))


def _functions(events: DataFrame) -> DataFrame:
    """Each event's row with the function from the expiry before its range to the one after the row.

    ``fixed`` (null: none) where a grant or revocation came, else ``lead`` (a,
    null: no purchase) and ``sum`` (s): e goes to max(e, a) + s.
    """
    order = W.partitionBy("model_id", "key", "range").orderBy("block", "log_index")
    bought = F.col("kind") == "access_bought"
    cut = events.withColumn("segment", F.sum((~bought).cast("int")).over(order))
    inside = W.partitionBy("model_id", "key", "range", "segment").orderBy("block", "log_index")
    cut = cut.withColumn("sum", F.sum("d").over(inside).cast(BLOCKS))
    cut = cut.withColumn("lead", F.max(F.when(bought, F.col("block") - (F.col("sum") - F.col("d")))).over(inside).cast(BLOCKS))
    start = F.first("kind").over(inside)
    fixed = F.when(F.col("segment") == 0, F.lit(None)).when(start == "access_granted", never()).otherwise(_applied(_zero()))
    return cut.withColumn("fixed", fixed).drop("segment")


def _applied(before: Column) -> Column:
    """max(e, a) + s on an expiry; what never ends stays so, and without a purchase nothing changes."""
    return F.when(before == never(), before).when(F.col("lead").isNull(), before).otherwise(F.greatest(before, F.col("lead")) + F.col("sum")).cast(BLOCKS)


def _incoming(functions: DataFrame) -> DataFrame:
    """(model_id, key, range, before): the expiry that each range starts from.

    One row for each range of a key is scanned; the ranges' functions are put
    together by running sums and maxima, as rows are inside a range.
    """
    last = functions.groupBy("model_id", "key", "range").agg(*[F.max_by(c, when()).alias(c) for c in ("fixed", "lead", "sum")])
    order = W.partitionBy("model_id", "key").orderBy("range")
    fixed = F.col("fixed").isNotNull()
    cut = last.withColumn("segment", F.sum(fixed.cast("int")).over(order))
    inside = W.partitionBy("model_id", "key", "segment").orderBy("range")
    own = F.when(fixed, _zero()).otherwise(F.col("sum"))
    cut = cut.withColumn("start", F.coalesce(F.first("fixed").over(inside), _zero())).withColumn("total", F.sum(own).over(inside).cast(BLOCKS))
    lead = F.max(F.when(~fixed, F.col("lead") - (F.col("total") - F.col("sum")))).over(inside)
    cut = cut.select("model_id", "key", "range", "start", lead.cast(BLOCKS).alias("lead"), F.col("total").alias("sum"))
    cut = cut.withColumn("after", _applied(F.col("start")))
    return cut.select("model_id", "key", "range", F.coalesce(F.lag("after").over(order), _zero()).alias("before"))


def access_history(events: DataFrame, plans: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """(model_id, key, block, log_index, expiry) after each access event.

    ``bounds`` are those of block_ranges(); left out, they are taken from the
    events. Events of one (model, key) have different (block, log_index).
    """
    mine = access_events(events, plans)
    bounds = block_ranges(mine) if bounds is None else bounds
    rows = _functions(with_range(mine, bounds))
    # With a single range every key starts from nothing.
    rows = rows.join(_incoming(rows), ["model_id", "key", "range"]) if bounds else rows.withColumn("before", _zero())
    return rows.select("model_id", "key", "block", "log_index", F.coalesce("fixed", _applied(F.col("before"))).alias("expiry"))


def access_from_events(events: DataFrame, plans: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """(model_id, key, expiry) in the end."""
    return access_history(events, plans, bounds).groupBy("model_id", "key").agg(F.max_by("expiry", when()).alias("expiry"))


def access_at(requests: DataFrame, history: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """requests with the expiry in force at their block (0: none) and whether it is valid.

    An as-of join without a range join: both sides in one order inside each
    (model, key, range of blocks), the last expiry carried forward, and over
    the ranges of a key the last one of those before.
    """
    if bounds is None:
        history = settle(history, "history")  # read for the ranges and for the join
        bounds = block_ranges(requests.select("block").union(history.select("block")))
    ids = [c for c in requests.columns if c not in ("model_id", "key", "block")]
    asked = requests.select("model_id", "key", "block", F.lit(2**31 - 1).alias("log_index"), F.lit(None).cast(BLOCKS).alias("expiry"), F.struct(*ids).alias("r"))
    known = history.select("model_id", "key", "block", F.col("log_index").cast("int"), "expiry", F.lit(None).cast(asked.schema["r"].dataType).alias("r"))
    both = with_range(asked.unionByName(known), bounds)
    order = W.partitionBy("model_id", "key", "range").orderBy("block", "log_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = both.withColumn("expiry", F.last("expiry", ignorenulls=True).over(order))
    if bounds:
        ends = both.groupBy("model_id", "key", "range").agg(F.max_by("expiry", F.when(F.col("expiry").isNotNull(), when())).alias("end"))
        over = W.partitionBy("model_id", "key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
        before = ends.select("model_id", "key", "range", F.last("end", ignorenulls=True).over(over).alias("before"))
        carried = carried.filter(F.col("r").isNotNull()).join(before, ["model_id", "key", "range"]).withColumn("expiry", F.coalesce("expiry", "before"))
    out = carried.filter(F.col("r").isNotNull()).withColumn("expiry", F.coalesce("expiry", _zero()))
    valid = (F.col("expiry") == never()) | ((F.col("expiry") >= F.col("block")) & (F.col("expiry") > 0))
    return out.select("model_id", "key", "block", "r.*", "expiry", valid.alias("valid"))
