"""Connected components of an undirected edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node and component (the smallest node that edges reach) of every node with an edge.

    ``edges`` has long columns a and b. Each round hangs every node's larger
    neighbours on its least neighbour (large star) and then its smaller ones
    (small star), which halves the depth of what is left; it ends when a round
    changes nothing. The least neighbour is an aggregate, so that Spark
    combines the edges of a hot node before the shuffle.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.join(least, "a")
        if large:
            return hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    # every edge goes from the larger node to the smaller
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    for _ in range(rounds):
        now = stored(star(star(now, True), False))
        n, s = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, s) == sign:
            break
        sign = (n, s)
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select("b", "b").distinct())
