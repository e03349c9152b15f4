"""Connected components by contraction: every round joins each vertex to its least neighbour and rewrites the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.storage import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """vertex and component (a vertex of it) of all vertices that edges touch. Each round is a written table."""
    left = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    left = written(left, "edges")
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("least")).select("vertex", F.least("vertex", "least").alias("parent"))
        parents = written(parents, "parents")
        up = parents.select(F.col("vertex").alias("parent"), F.col("parent").alias("grand"))
        for _ in range(2):
            jumped = parents.join(up, "parent", "left").select("vertex", F.coalesce("grand", "parent").alias("parent"))
            parents = jumped
        parents = written(parents, "parents")
        if labels is None:
            labels = parents.withColumnRenamed("parent", "component")
        else:
            p = parents.select(F.col("vertex").alias("component"), "parent")
            labels = labels.join(p, "component", "left").select("vertex", F.coalesce("parent", "component").alias("component"))
        labels = written(labels, "labels")
        pa_, pb = parents.select(F.col("vertex").alias("a"), F.col("parent").alias("pa")), parents.select(F.col("vertex").alias("b"), F.col("parent").alias("pb"))
        moved = left.join(pa_, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        left = written(moved.where("a < b").distinct(), "edges")
    if labels is None:
        return left.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return labels
