"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import discard
from .common import staged


def _least(edges: DataFrame) -> DataFrame:
    """``u, m, n``: for each node its smallest neighbour and how many it has."""
    return staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each node of an edge is linked with.

    Alternates large and small star steps: each node's larger (then smaller) neighbours are
    tied to its smallest neighbour. The number of edges does not grow, a hub's neighbours
    are never gathered in one row or task (its edges meet its row of the smallest
    neighbours in a plain join of two tables, which Spark splits where it is skewed), and
    rounds grow with the logarithm of the longest path. Every step is a table in the shared
    folder; a round's tables go when the next has been written.
    """
    now = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        # Large star: neighbours above u go to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both)
        large = both.where("v > u").join(low.select("u", F.least("u", "m").alias("m")), "u")
        large = staged(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = _least(large)
        same = F.xxhash64("u", "m").cast("decimal(38,0)")
        most, total = least.agg(F.max("n"), F.sum(same)).first()
        done = (most or 1) == 1 and total == now.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]
        if done:
            discard(now, low, least)
            break
        if most > 1:
            # Small star: u and its smaller neighbours go to the smallest of them.
            small = large.join(least.select("u", "m"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
            after = staged(small, "edges")
            discard(large)
        else:
            after = large
        discard(now, low, least)
        now = after
    return large.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(large.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
