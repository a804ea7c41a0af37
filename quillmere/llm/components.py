"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


#: Edges that one task holds in a round.
EDGES = 1 << 17


def _large_star(edges: DataFrame) -> DataFrame:
    # Both directions by explode, not union, which would double the partitions.
    both = edges.select(F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    # An edge to the least node stays; every other one becomes an edge from its end to the least node.
    return moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the least node that it reaches.

    Edges may repeat and may join a node to itself; nulls link nothing. Each round rewrites the edges
    towards stars whose centre is the least node; it ends when a round changes nothing. Links stay
    distributed, and each round is a written table, so a lost executor costs no earlier round.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    start = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v"))
    now, state = written(start.distinct(), "stars", start.count()), None
    while True:
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == (count, total) or not count:
            break
        state = (count, total)
        # As few tasks as can hold the edges: up to EDGES of them, a round shuffles nothing.
        after = written(_small_star(_large_star(now.coalesce(math.ceil(count / EDGES)))), "stars")
        dropped(now)
        now = after
    centres = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)
