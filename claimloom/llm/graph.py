"""Connected components of an edge table, by alternating star contractions.

Each round replaces edges by edges to smallest neighbours, first for the larger neighbours of every
vertex and then for the smaller ones, until nothing changes: O(log^2) rounds, each a few grouped minima
and equi-joins over at most as many edges as there were. Minima are combined before the shuffle and hot
vertices stand on the join's splittable side. No edge reaches the driver, only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, a: str, b: str, keep: Scratch) -> DataFrame:
    """(vertex, component) of every vertex that has an edge to another: the smallest vertex reachable.
    Null ends, loops and repeated edges are ignored. The result stands in one of keep's tables."""
    now = keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = keep(small.select("e.u", "e.v").where("u <> v").distinct())
    return keep(now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()))
