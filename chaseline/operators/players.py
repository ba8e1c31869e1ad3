"""Leaderboards of leverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def player_leverage(rows: DataFrame, who: str = "batter", least_balls: int = 500) -> DataFrame:
    """Leverage of each player's balls, ranked by its mean, ties by name; null players are left out."""
    out = rows.filter(F.col(who).isNotNull()).groupBy(F.col(who).alias("player")).agg(
        F.count("*").alias("balls"), F.avg("li").alias("mean_li"), F.percentile("li", F.lit(0.5)).alias("median_li"), F.percentile("bat_pos", F.lit(0.5)).alias("median_pos"), F.avg((F.col("phase") == "death").cast("double")).alias("death_share"),
    )
    kept = out.filter(F.col("balls") >= least_balls)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("mean_li", 9)), "player")))  # one row a player


def by_position(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bat_pos").agg(F.avg("li").alias("mean_li"), F.count("*").alias("n"), F.avg((F.col("phase") == "death").cast("double")).alias("death_share"))


def leverage_correlations(rows: DataFrame, least_balls: int = 500) -> DataFrame:
    """Correlation over players of mean leverage and death share, both rounded half-even to three places first."""
    sides = []
    for who in ("batter", "bowler"):
        table = player_leverage(rows, who, least_balls).select(F.bround("mean_li", 3).alias("x"), F.bround("death_share", 3).alias("y"))
        sides.append(table.agg(F.corr("x", "y").alias("correlation"), F.count("*").alias("players")).select(F.lit(who).alias("side"), "correlation", "players"))
    return sides[0].unionByName(sides[1])


def leverage_lists(table: DataFrame, top: int = 20, bottom: int = 10) -> DataFrame:
    """``list, place`` and the columns of ``player_leverage``: its first ``top`` players, and its last ``bottom`` from the end."""
    size = F.count("*").over(Window.partitionBy())  # a row a player
    ranked = table.withColumn("from_end", size - F.col("rank") + 1)
    lists = F.filter(F.array(*(F.struct(F.lit(name).alias("list"), F.col(at).cast("long").alias("place"), F.lit(n).alias("most")) for name, at, n in (("top", "rank", top), ("bottom", "from_end", bottom)))), lambda x: x["place"] <= x["most"])
    return ranked.withColumn("entry", F.explode(lists)).select("entry.list", "entry.place", *table.columns)


def position_correlations(profile: DataFrame, order: int = 7) -> DataFrame:
    """Correlation of the batting position with its mean leverage, rounded half-even to three places first: the first ``order`` positions, and all."""
    rows = profile.filter("bat_pos is not null").select(F.col("bat_pos").cast("double").alias("x"), F.bround("mean_li", 3).alias("y"))
    scopes = ((f"1-{order}", rows.filter(F.col("x") <= order)), ("all", rows))
    parts = [part.agg(F.corr("x", "y").alias("correlation"), F.count("*").alias("positions")).select(F.lit(name).alias("scope"), "correlation", "positions") for name, part in scopes]
    return parts[0].unionByName(parts[1])


def find_player(table: DataFrame, part: str) -> DataFrame:
    """The one player whose name holds ``part``, letters in either case; none if several do."""
    hits = table.filter(F.contains(F.lower("player"), F.lit(part.lower())))
    return hits.withColumn("hits", F.count("*").over(Window.partitionBy())).filter("hits = 1").drop("hits")
