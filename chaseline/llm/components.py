"""Connected components by alternating stars, with joins and map-side minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, tidied


def join_sums(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``sums``, an aggregate by ``key``, so that adaptive execution can split a key that many rows hold.

    It splits only joins of two plain shuffles. The second key, made of the first, asks for
    one on top of the aggregate, which has one row a key.
    """
    part = F.pmod(F.xxhash64(key), F.lit(1024))
    return rows.withColumn("part", part).join(sums.withColumn("part", part), [key, "part"]).drop("part")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over directed pairs (u, v); no neighbour list is ever gathered."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = join_sums(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = join_sums(down, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.filter("u != v")
    return out if large else out.distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of the undirected ``edges (a long, b long)``; label: the smallest node reachable.

    Loops and repeated edges are allowed; no edges give no rows. Each round is cut by a
    checkpoint. Rounds grow with the logarithm of the longest path; ``most_rounds`` only
    guards against a fault and raises.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    mark = None
    for _ in range(most_rounds):
        now = tidied(_star(_star(now, True), False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
