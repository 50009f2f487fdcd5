"""Connected components by hooking to the smallest neighbour and contracting the edges.

Each round aggregates with partial sums only, so a node with many links is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm.tables import discard, written


def components(edges: DataFrame) -> DataFrame:
    """For each node of the edges (a, b): node, component, the smallest node it reaches."""
    start = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "cc-edges")
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, live = None, start
    while not live.isEmpty():
        hook = both(live).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        hook = written(hook, "cc-hooks")
        # where a node's parent hooks in turn, take two steps
        far = hook.alias("x").join(hook.alias("y"), F.col("x.up") == F.col("y.node")).select("x.node", F.col("y.up").alias("up"))
        far = written(far, "cc-steps")
        p, q = far.select(F.col("node").alias("a"), F.col("up").alias("pa")), far.select(F.col("node").alias("b"), F.col("up").alias("pb"))
        moved = live.join(p, "a").join(q, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        onward = far.alias("x").join(far.alias("y"), F.col("x.up") == F.col("y.node")).select(F.col("x.up").alias("a"), F.col("y.up").alias("b"))
        done = live
        live = written(moved.unionAll(onward).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        older = labels
        if labels is None:
            labels = far.select("node", F.col("up").alias("component"))
        else:
            labels = labels.join(far.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = written(labels, "cc-labels")
        discard(done, hook, far, *([] if older is None else [older]))
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return labels
