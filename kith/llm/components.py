"""Connected components by label propagation with pointer jumping; everything stays in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kith.sources.workspace import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for each id in ``edges (a, b)``: the smallest id reachable.

    First each edge moves to the smallest neighbour of its larger end. Ends that then hang on one edge alone, as the members of a
    star do, wait for that neighbour's component; rounds run on what is left.
    """
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    low = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = e.join(low, "b").filter("a <> m").select("m", F.col("a").alias("b")).distinct()
    e = materialize(low.select("m", "b").union(moved).distinct(), "edges")
    ends = e.select(F.col("m").alias("x")).union(e.select("b")).groupBy("x").agg(F.count("*").alias("n"))
    e = materialize(e.join(ends.withColumnRenamed("x", "b"), "b").select("m", "b", (F.col("n") == 1).alias("leaf")), "edges")
    core = _rounds(e.filter("not leaf").select(F.col("m").alias("a"), "b"))
    hung = e.filter("leaf").join(core.select(F.col("id").alias("m"), "component"), "m", "left").select("m", "b", F.coalesce("component", "m").alias("component"))
    alone = hung.filter("m = component").select(F.col("m").alias("id"), "component")
    return core.union(hung.select(F.col("b").alias("id"), "component")).union(alone).distinct()


def _rounds(edges: DataFrame) -> DataFrame:
    """A round takes the smallest label among neighbours and then the label of that label, so paths shorten by half. Labels are
    written between rounds; a driver sees only whether any moved.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), "labels")
    while True:
        near = (both.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("near"))
                .join(labels, "a").select("a", F.least("near", "l").alias("near"), "l"))
        target = labels.select(F.col("a").alias("near"), F.col("l").alias("far"))
        step = near.join(target, "near").select("a", F.least("near", "far").alias("l"), (F.least("near", "far") != F.col("l")).alias("moved"))
        step = materialize(step, "labels")
        labels = step.select("a", "l")
        if step.filter("moved").limit(1).count() == 0:
            return labels.select(F.col("a").alias("id"), F.col("l").alias("component"))
