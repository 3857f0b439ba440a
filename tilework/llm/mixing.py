"""Mixing sources to target weights by entropy balancing.

Each document d of source s gets a rate r_d in (0, 3): the expected number of
copies that the mix takes. Rates minimise the divergence from taking every
document once,

    sum r log r + (3 - r) log((3 - r) / 2),

subject to one token constraint per source, sum over d of size_d r_d = target_s.
The convex dual has one variable per source and its solution tilts the odds
exponentially by the document's tokens: r / (3 - r) = exp(lambda_s x_d) / 2
with x_d = size_d / mean size of the source. Newton steps on the dual run as
Spark aggregations over (source, size) cells; a bracket per source catches
steps that leave it. Rates are then rounded to whole copies.

Everything here is DataFrame code; the driver sees one number per iteration.
The per-source table (weights by code point, levels) is one row per source and
is ranked in one task; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.llm.common import WORD, discard, settle, table

CAP = 3
WEIGHTS = (5, 2, 1)
KEY = ["no_source", "src"]


def size_columns(doc_id: str = "doc_id", text: str = "text", source: str = "source") -> list[Column]:
    """doc_id, source and size in words; a null text has none."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return [
        F.col(doc_id).alias("doc_id"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source), F.lit("")).alias("src"),
        words.alias("size"),
    ]


def source_targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: its size, documents and target.

    Weights repeat over the sources by code point, null last. A level is the
    words per unit of weight; a source stops at cap times its size, and the
    level rises until all words are shared. Sorted by the level at which they
    stop, the stopped sources come first, so one pass of sums finds the level.
    """
    per = cells.groupBy(*KEY).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs"))
    rank = F.row_number().over(W.orderBy(*KEY)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    limit = F.lit(float(cap)) * F.col("source_size")
    by_stop = W.orderBy((limit / F.col("weight")), *KEY)
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    onward = by_stop.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = by_stop.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(onward))
    top = F.max("level").over(whole)
    return per.withColumn("target", F.greatest(F.lit(0.0), F.least(limit, F.col("weight") * top))).drop("level", "weight")


def rate(lam: Column, x: Column, cap: int = CAP) -> Column:
    """The tilted rate; lam null stands for no bound (the cap itself)."""
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(cap / (1 + (cap - 1) * F.exp(-lam * x)))


def balance(cells: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = 1e-9, most: int = 100) -> DataFrame:
    """targets with ``lam``, the dual variable of each source.

    Sources whose target is their cap (or that have no words) have no finite
    solution or any; they get null and take the cap. Each iteration is one
    aggregation of the cells by source, summed as decimals so that reruns agree
    to the last bit; it ends when every constraint holds to the tolerance.
    Newton's steps need about ten iterations; ArithmeticError after ``most``.
    """
    share = F.col("target") / F.col("source_size")
    free = (F.col("source_size") > 0) & (share < cap * (1 - 1e-12)) & (F.col("target") > 0)
    start = F.log(share * (cap - 1) / (cap - share))
    mean = F.col("source_size") / F.col("source_docs")
    far = F.lit(700.0)
    state = targets.select(*KEY, "source_size", "source_docs", "target", mean.alias("mean"), F.when(free, start).alias("lam"), (-far * 1e6).alias("lo"), (far * 1e6).alias("hi"))
    before = state = settle(state, "dual_0")
    for i in range(most):
        x = F.col("size") / F.col("mean")
        r = rate(F.col("lam"), x, cap)
        tokens = F.col("n") * F.col("size")
        joined = cells.join(state.filter(F.col("lam").isNotNull()).select(*KEY, "mean", "lam"), KEY)
        sums = joined.groupBy(*KEY).agg(*[F.sum(v.cast("decimal(28,9)")).cast("double").alias(c) for c, v in (("have", tokens * r), ("slope", tokens * x * r * (cap - r) / cap))])
        gap = F.col("have") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.greatest(F.col("slope"), F.lit(1e-300))
        # Before a side is known, the step may double the size of lam at most.
        reach = F.abs(F.col("lam")) + 1
        step = F.greatest(F.least(step, F.col("lam") + reach), F.col("lam") - reach)
        next_lam = F.when((step > F.col("nlo")) & (step < F.col("nhi")), step).otherwise((F.col("nlo") + F.col("nhi")) / 2)
        state = (
            state.join(sums, KEY, "left")
            .withColumn("nlo", lo).withColumn("nhi", hi)
            .withColumn("off", F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0)))
            .withColumn("lam", F.when(F.col("off") <= tolerance, F.col("lam")).otherwise(next_lam))
            .select(*KEY, "source_size", "source_docs", "target", "mean", "lam", F.col("nlo").alias("lo"), F.col("nhi").alias("hi"), "off")
        )
        last, state = before, settle(state, f"dual_{i + 1}")
        discard(last)
        before = state
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise ArithmeticError(f"the dual is off by {worst:.2g} of a target after {most} iterations")
    return state.select(*KEY, "source_size", "target", "mean", "lam")


def round_cells(cells: DataFrame, solved: DataFrame, cap: int = CAP, rounds: int = 8) -> DataFrame:
    """Whole copies for each (source, size) cell.

    Running sums of the rates, largest sizes first, are rounded at each cell,
    which leaves each source off by less than one large document; then a few
    passes add or take away copies of ever smaller documents until what is
    missing is less than the smallest that could serve. A cell of n documents
    keeps between 0 and cap * n copies.
    """
    x = F.col("size") / F.col("mean")
    cells = cells.join(solved, KEY).withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate(F.col("lam"), x, cap)))
    order = W.partitionBy(*KEY).orderBy(F.col("size").desc())
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    source = W.partitionBy(*KEY)
    # Sums of doubles run in one order here, so reruns agree.
    run = F.sum(F.col("n") * F.col("rate")).over(upto)
    cells = cells.withColumn("run", F.floor(run + 0.5))
    cells = cells.withColumn("copies", F.col("run") - F.coalesce(F.lag("run").over(order), F.lit(0)))
    cells = cells.withColumn("copies", F.least(F.greatest(F.col("copies"), F.lit(0)), cap * F.col("n")))
    for _ in range(rounds):
        cells = cells.withColumn("miss", F.col("target") - F.sum(F.col("size") * F.col("copies")).over(source))
        room = F.when(F.col("miss") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("miss"))
        cells = cells.withColumn("room", F.when(fits, room).otherwise(0))
        ahead = F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0))
        cells = cells.withColumn("ahead", ahead)
        take = F.floor((F.abs("miss") - F.col("ahead")) / F.greatest(F.col("size"), F.lit(1)))
        take = F.least(F.greatest(take, F.lit(0)), F.col("room")) * F.signum("miss").cast("long")
        cells = cells.withColumn("copies", F.col("copies") + take)
    return cells.select(*KEY, "size", "n", "source_size", "target", "rate", F.col("copies").alias("cell_copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42, spread: int = 1024) -> DataFrame:
    """doc_id, no_source, src, size, source_size, target, rate, copies.

    Copies of a cell go to its documents evenly; which get one more is drawn by
    a seeded hash of doc_id, ranked inside hash buckets, so that a cell with
    most of the rows (many equal texts) is not ranked in one task. A null
    source is one of its own and comes last; documents without words count as
    taken once and weigh nothing; repeated rows each have their copies; an
    empty table gives no rows. Columns other than doc_id, text and source are
    not read.
    """
    # Rows without an id are interchangeable; a number of their own spreads them.
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = settle(docs.select(*size_columns()).withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "doc_id", own), F.lit(spread)).cast("int")), "sizes")
    cells = settle(rows.groupBy(*KEY, "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    solved = balance(cells, source_targets(cells, weights, cap), cap)
    rounded = round_cells(cells, solved, cap)
    per = rows.groupBy(*KEY, "size", "b").agg(F.count(F.lit(1)).alias("nb"))
    run = F.sum("nb").over(W.partitionBy(*KEY, "size").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow))
    offsets = settle(per.withColumn("skip", run - F.col("nb")).join(rounded, [*KEY, "size"]).drop("nb"), "offsets")
    r = F.row_number().over(W.partitionBy(*KEY, "size", "b").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"))
    out = rows.withColumn("r", r).join(offsets, [*KEY, "size", "b"])
    more = (F.col("skip") + F.col("r") <= F.col("cell_copies") % F.col("n")).cast("long")
    copies = F.expr("cell_copies div n") + more
    return out.select("doc_id", *KEY, "size", "source_size", "target", "rate", copies.alias("copies"))


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed table: each document as often as the mix takes it.

    Rows alike in doc_id, source and size share their copies. Null texts and
    texts without words are taken once, null ids and sources are rows like
    others, an empty table gives no rows. Keeps the columns of the input,
    whatever their names. The texts are shuffled once.
    """
    key = ["no_id", "id", *KEY, "size"]
    named = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")]
    total = mix(docs, **how).select(*named, *KEY, "size", "copies").groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *named, *size_columns()[1:])
    turn = F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64("row")))
    mine = F.expr("copies div alike") + (turn <= F.col("copies") % F.col("alike")).cast("long")
    taken = rows.join(settle(total, "copies"), key).withColumn("mine", mine).filter("mine > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mine")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in the mix of all sources."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
