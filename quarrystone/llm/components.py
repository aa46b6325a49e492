"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import BROADCAST_ROWS, forget, written

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges``: ``a``, ``b``.  ``node``, ``root``: every node with an edge and the least node that it reaches.

    Each round keeps at most as many edges as there were; the number of rounds grows with the logarithm of the longest
    path.  A node with very many neighbours is a hot key of joins only, which adaptive execution splits.
    """
    spark = edges.sparkSession
    now, path = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        # A node is one row of the tables of least neighbours, which have two rows an edge at most.
        light = F.broadcast if 2 * mark[0] <= BROADCAST_ROWS else lambda df: df
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(light(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(light(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old = path
        now, path = written(small.filter("a <> b").distinct())
        forget(spark, old)
    else:
        raise ValueError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
