"""Win probability added: signed credit of each ball, and player totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chase
from .leverage import steps

HIGH_LI = 2.0


def per_ball(rows: DataFrame) -> DataFrame:
    """Raw and de-drifted credit: the mean move among balls of a like value before is taken off."""
    moved = steps(rows).withColumn("wpa_bat", F.col("wp_after") - F.col("wp")).withColumn("drift_bin", chase.drift_bin("wp"))
    drift = moved.groupBy("drift_bin").agg(F.avg("wpa_bat").alias("wpa_drift"))  # at most 51 rows
    out = moved.join(F.broadcast(drift), "drift_bin").withColumn("wpa_bat_dd", F.col("wpa_bat") - F.col("wpa_drift"))
    return out.withColumns({"wpa_bowl": -F.col("wpa_bat"), "wpa_bowl_dd": -F.col("wpa_bat_dd")})


def by_player(credited: DataFrame, who: str, side: str, least_balls: int = 500) -> DataFrame:
    """Totals and high- and low-leverage means of each player; null players are left out."""
    raw, dd = F.col(f"wpa_{side}"), F.col(f"wpa_{side}_dd")
    high = F.col("li") >= HIGH_LI
    out = credited.filter(F.col(who).isNotNull()).groupBy(F.col(who).alias("player")).agg(
        F.count("*").alias("balls"), F.sum(raw).alias("total_wpa"), F.sum(dd).alias("total_wpa_dd"), (100 * F.avg(dd)).alias("wpa_dd_per100"), F.avg("li").alias("mean_li"),
        F.count_if(high).alias("n_high"), F.avg(F.when(high, dd)).alias("wpa_high_dd"), F.avg(F.when(~high, dd)).alias("wpa_low_dd"),
    )
    return out.filter(F.col("balls") >= least_balls)


def totals(credited: DataFrame) -> DataFrame:
    """Grand totals; the raw one telescopes to results less the values before the first balls."""
    firsts = credited.groupBy("match_id").agg(F.min_by("wp", "ball_index").alias("first_wp"), F.max("y").alias("y"))
    tele = firsts.agg(F.sum(F.col("y") - F.col("first_wp")).alias("telescoped"))
    return credited.agg(F.sum("wpa_bat").alias("total_bat"), F.sum("wpa_bowl").alias("total_bowl"), F.sum("wpa_bat_dd").alias("total_bat_dd")).crossJoin(tele)


def top_lists(players: DataFrame, n: int = 20, least_high: int = 100) -> DataFrame:
    """``list, rank, player, ...``: the first ``n`` by de-drifted total, and by high-leverage mean of those with ``least_high`` such balls; ties by name."""
    out = []
    for name, measure, rows in (("total", "total_wpa_dd", players), ("clutch", "wpa_high_dd", players.filter(F.col("n_high") >= least_high))):
        order = Window.orderBy(F.desc(F.round(measure, 9)), "player")
        first = rows.orderBy(F.desc(F.round(measure, 9)), "player").limit(n)  # ranked below: n rows
        out.append(first.select(F.lit(name).alias("list"), F.row_number().over(order).alias("rank"), "player", "balls", "n_high", "total_wpa_dd", "wpa_high_dd", "wpa_low_dd"))
    return out[0].unionByName(out[1])


def inversions(batters: DataFrame, bowlers: DataFrame) -> DataFrame:
    """The batter who loses most and the bowler who gains most by de-drifting, ties by name."""
    loss = F.round(F.col("total_wpa") - F.col("total_wpa_dd"), 9)
    worst = batters.orderBy(loss.desc(), "player").limit(1).select(F.lit("batter").alias("side"), "player", "total_wpa", "total_wpa_dd")
    best = bowlers.orderBy(loss.asc(), "player").limit(1).select(F.lit("bowler").alias("side"), "player", "total_wpa", "total_wpa_dd")
    return worst.unionByName(best)
