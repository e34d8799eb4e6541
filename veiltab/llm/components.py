"""Connected components of an edge table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node of its component.

    Each step attaches neighbours to the smallest node seen, in combinable minima and joins on the node; nodes never
    gather their neighbours in one place. Rounds grow with the logarithm of the longest path. No edges give no rows.
    """
    stars = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(down, "a").where("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        stars = written(down.select("a", F.col("_m").alias("b")).unionByName(small).distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
