"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import dropped, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round of the two-phase star algorithm: neighbours move to the smallest node of their neighbourhood."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))) if large else both.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
    joined = both.join(least, "x")
    if large:
        out = joined.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): each node of an edge with the smallest node of its component.

    Rounds of large and small stars, each written to the shared folder, until the edges stay the same; the number of
    rounds grows with the logarithm of the longest path. Loops, repeated edges and an empty table are fine; null ends drop out."""
    now = edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct()
    seen, old = None, None
    while True:
        now = keep(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old is not None:
            dropped(old)
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, old = mark, now
