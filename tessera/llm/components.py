"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, stored


def _ordered(a, b) -> list:
    return [F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")]


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for every node but the smallest ones, of edges (a, b).

    Every edge runs from a larger child to a smaller parent. In a round each child keeps its smallest parent,
    hands its other parents to that one, and then skips to its parent's parent. Only children are grouped, so
    a parent of very many children is a skewed join key and never a group. Rounds end when parents are roots;
    paths halve in each. An edge from a node to itself, or with a null end, is no edge. A round's tables are
    removed when the next one's edges are written.
    """
    spark = edges.sparkSession
    own = edges.select(*_ordered(F.col("a"), F.col("b"))).filter("child > parent").distinct()
    own = held = stored(own, "edges")
    while True:
        least = stored(own.groupBy("child").agg(F.min("parent").alias("least")), "parents")
        kept = own.join(least, "child")
        moved = kept.filter("parent > least").select(*_ordered(F.col("parent"), F.col("least")))
        star = stored(kept.select("child", F.col("least").alias("parent")).unionByName(moved).distinct(), "edges")
        up = stored(star.groupBy(F.col("child").alias("parent")).agg(F.min("parent").alias("over")), "parents")
        jumped = star.join(up, "parent", "left").select("child", F.coalesce("over", "parent").alias("parent"), F.col("over").isNotNull().alias("_moved"))
        own = stored(jumped, "edges")
        discard(spark, held, least, star, up)
        held = own
        ends = own.agg(F.coalesce(F.max("_moved"), F.lit(False)), F.count("*"), F.count_distinct("child")).first()
        own = own.drop("_moved")
        if not ends[0] and ends[1] == ends[2]:
            return own.select(F.col("child").alias("node"), F.col("parent").alias("component"))
        # A child that skipped its parent keeps it in the component by that parent's own edge.
        own = own.distinct()
