"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, part) of every node of the edges (a, b): part is the smallest node connected to it.

    Each round hangs every node's larger neighbours (then its smaller ones) on its smallest
    neighbour. Rounds end when nothing changes; each is written to the shared folder. Neighbourhoods
    are never gathered into rows: a round is a grouped minimum and a join.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:  # about the square of the logarithm of the longest path
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct())
