"""Connected components of a graph by pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.llm.common import discard, settle


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of the (a, b) edges; root is the least node.

    Each round every edge hooks the larger root onto the smallest neighbouring
    one, then pointers are halved and edges are drawn between roots, so that
    settled edges go. The graph shrinks with each round and the driver sees a
    count only.
    """
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    roots = settle(nodes.withColumn("root", F.col("node")), "roots_0")
    for i in range(most):
        if edges.isEmpty():
            return roots
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        hook = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up"))
        # A chain of hooks is followed twice before roots are renamed.
        for _ in range(2):
            above = hook.select(F.col("a").alias("up"), F.col("up").alias("upper"))
            hook = hook.join(above, "up").select("a", F.col("upper").alias("up"))
        hook = settle(hook, f"hook_{i}")
        roots_then = roots
        roots = roots.join(hook.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        before, roots = roots_then, settle(roots, f"roots_{i + 1}")
        up_a, up_b = hook.select("a", F.col("up").alias("ua")), hook.select(F.col("a").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(up_a, "a").join(up_b, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        last, edges = edges, settle(moved.filter("a < b").distinct(), f"edges_{i + 1}")
        discard(last, hook, before)
    raise RuntimeError(f"components did not settle in {most} rounds")
