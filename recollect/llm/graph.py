"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """v and component (the smallest vertex reachable) of each vertex of the links (a, b); loops and repeats do no harm.

    Each round every vertex points to its smallest neighbour, pointers are followed once more, and links are redrawn
    between what is pointed to, until none is left. Tables shrink from round to round; nothing goes to the driver but
    their row counts.
    """
    left = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        up = checkpoint(near)
        then = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
        point = checkpoint(up.join(then, "p").select("a", F.col("q").alias("root")))
        if labels is None:
            labels = point.select(F.col("a").alias("v"), F.col("root").alias("component"))
        else:
            moved = point.select(F.col("a").alias("component"), "root")
            labels = labels.join(moved, "component", "left").select("v", F.coalesce("root", "component").alias("component"))
        labels = checkpoint(labels)
        by_a = left.join(point, "a").select(F.col("root").alias("ra"), "b")
        by_b = by_a.join(point.select(F.col("a").alias("b"), F.col("root").alias("rb")), "b").filter("ra <> rb")
        left = checkpoint(by_b.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
    if labels is None:
        labels = left.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return labels
