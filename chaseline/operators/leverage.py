"""Leverage: how far one ball moves the win probability, and checks of the surface's dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chase
from . import outcomes, winprob

LAGS, PARTNERSHIP_LAGS = (1, 2, 3, 5, 10, 20, 30), (1, 2, 3, 5, 10)


def era_model(balls: DataFrame, half_life: float | None = outcomes.ERA_HALF_LIFE) -> tuple[DataFrame, DataFrame]:
    """(grid, surface) of the recency-weighted model fitted on the train split, tabulated for all balls."""
    grid = outcomes.full_grid(outcomes.with_recency(balls.filter("split = 'train'"), half_life))
    return grid, winprob.solve(grid, winprob.greatest_r(balls))


def swings(states: DataFrame, surface: DataFrame) -> DataFrame:
    """``b, w, r, swing``: mean absolute move of the win probability over the next ball."""
    return winprob.children(states, surface).groupBy("b", "w", "r").agg(F.sum(F.col("prob") * F.abs(F.col("next_wp") - F.col("wp"))).alias("swing"))


def scored(balls: DataFrame, grid: DataFrame, surface: DataFrame) -> DataFrame:
    """``balls`` with ``wp``, ``swing`` and ``li``, whose mean over all balls is 1. Swings are found once a state."""
    states = balls.select("b", "w", "r", "rrr", "phase").dropDuplicates(["b", "w", "r"])
    by_state = swings(winprob.with_wp(outcomes.with_distribution(states, grid), surface), surface)
    rows = winprob.with_wp(balls, surface).join(by_state, ["b", "w", "r"])
    mean = rows.agg(F.avg("swing").alias("mean_swing"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("li", F.col("swing") / F.col("mean_swing"))


def leverage_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.avg("li").alias("mean_li"), F.count("*").alias("n"))


def top_states(rows: DataFrame, n: int = 15, least_b: int = 1, lowest: bool = False) -> DataFrame:
    """The ``n`` balls of highest (or lowest) leverage; ties by match and ball."""
    order = [F.col("li").asc() if lowest else F.col("li").desc(), "match_id", "ball_index"]
    return rows.filter(F.col("b") >= least_b).orderBy(*order).limit(n)


def steps(rows: DataFrame) -> DataFrame:
    """``rows`` with ``wp_after``: the next ball's value, behind the last ball the result."""
    game = Window.partitionBy("match_id").orderBy("ball_index")
    return rows.withColumn("wp_after", F.coalesce(F.lead("wp").over(game), F.col("y").cast("double")))


def martingale_drift(rows: DataFrame, buckets: int = 10) -> DataFrame:
    """Mean signed move by bucket of the value before, and overall (bucket -1)."""
    moved = steps(rows).withColumn("delta", F.col("wp_after") - F.col("wp")).withColumn("bucket", chase.probability_bin("wp", buckets))
    sets = moved.groupingSets([[F.col("bucket")], []], F.col("bucket")).agg(F.count("*").alias("n"), F.avg("wp").alias("mean_from"), F.avg("delta").alias("mean_signed_change"))
    return sets.withColumn("bucket", F.coalesce("bucket", F.lit(-1)))


def residuals(balls: DataFrame) -> DataFrame:
    """``match_id, ball_index, part, runs, wkt``: runs and wickets less their mean by phase and wickets; ``part``: wickets fallen before."""
    game = Window.partitionBy("match_id").orderBy("ball_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = balls.select("match_id", "ball_index", "phase", "w", chase.runs_of("outcome").alias("x_runs"), (F.col("outcome") == "W").cast("double").alias("x_wkt"))
    rows = rows.withColumn("part", F.coalesce(F.sum("x_wkt").over(game), F.lit(0.0)).cast("int"))
    means = rows.groupBy("phase", "w").agg(F.avg("x_runs").alias("m_runs"), F.avg("x_wkt").alias("m_wkt"))  # at most 30 rows
    return rows.join(F.broadcast(means), ["phase", "w"]).select("match_id", "ball_index", "part", (F.col("x_runs") - F.col("m_runs")).alias("runs"), (F.col("x_wkt") - F.col("m_wkt")).alias("wkt"))


def partnership_lag1(balls: DataFrame) -> DataFrame:
    """Pooled lag-1 correlation of run residuals within partnerships, and its pairs."""
    part = Window.partitionBy("match_id", "part").orderBy("ball_index")
    pairs = residuals(balls).withColumn("after", F.lead("runs").over(part)).filter("after is not null")
    return pairs.agg(F.corr("runs", "after").alias("lag1"), F.count("*").alias("n_pairs"))
