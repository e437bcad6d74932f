"""Connected components by alternating large and small stars.

Each round is two passes of grouping and joining over the edges and a written table, so a lost
executor costs one round at most. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.session import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (
        moved.filter("a <> b")
        .union(least.select("a", F.col("m").alias("b"))).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for each node a that is not the smallest of its component, b being the smallest.

    ``edges``: two long columns a and b in any direction, repeats and loops allowed.
    """
    current = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b").distinct()
    )
    before = None
    while True:
        sums = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(sums) == before:
            return current
        before = tuple(sums)
        following = materialize(_small_star(_large_star(current)))
        release(current)
        current = following
