"""Choice of the recency half-life by rolling-origin folds, all models solved in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chase
from ..session import cut
from . import outcomes, winprob
from .ingest import season_table
from .metrics import row_log_loss

#: Half-lives in seasons, larger first; 0 stands for none. Folds, and the least effective share of rows.
HALF_LIVES = [0, 8.0, 6.0, 4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5]
FOLDS, ESS_FLOOR = 3, 0.15


def season_cells(train: DataFrame) -> DataFrame:
    """``season, ord, rrr_bin, w, phase, outcome, n, rrr``: balls of each season, cell and outcome, and one rate of the cell's.

    All folds' and half-lives' weighted counts are sums of these; the balls are read once.
    """
    seasons = season_table(train).select("season", "ord")
    placed = train.withColumn("rrr_bin", chase.rrr_bin("rrr"))
    counted = placed.groupBy("season", "rrr_bin", "w", "phase", "outcome").agg(F.count("*").alias("n"), F.min("rrr").alias("rrr"))
    return cut(counted.join(F.broadcast(seasons), "season"))


def season_states(train: DataFrame) -> DataFrame:
    """``ord, b, w, r, n, wins``: balls and wins of each season and state."""
    seasons = season_table(train).select("season", "ord")
    return train.groupBy("season", "b", "w", "r").agg(F.count("*").alias("n"), F.sum("y").alias("wins")).join(F.broadcast(seasons), "season").drop("season")


def fold_models(stats: DataFrame, half_lives: list[float] = HALF_LIVES, folds: int = FOLDS) -> DataFrame:
    """``stats`` by season, once for each fold and half-life that trains on them, with ``weight``: recency weight, of mean 1 over the balls of a model, times balls.

    A fold is a season; it trains on strictly earlier ones. Half-life 0 weighs all balls alike.
    """
    keys = ["fold", "half_life"]
    seasons = stats.groupBy("ord").agg(F.sum("n").alias("balls"))
    last = seasons.agg(F.max("ord").alias("last"))
    folded = seasons.crossJoin(F.broadcast(last)).filter(F.col("ord") > F.col("last") - folds).select(F.col("ord").alias("fold"))
    lives = F.explode(F.array(*(F.lit(float(h)) for h in half_lives)))
    pairs = seasons.crossJoin(F.broadcast(folded)).filter(F.col("ord") < F.col("fold")).withColumn("half_life", lives)  # a row a season, fold and half-life
    age = F.col("fold") - 1 - F.col("ord")
    life = F.nullif("half_life", F.lit(0.0))
    raw = F.coalesce(F.pow(F.lit(0.5), age / life), F.lit(1.0))
    group = Window.partitionBy(*keys)
    weighed = pairs.withColumn("raw", raw).withColumn("each", F.col("raw") * F.sum("balls").over(group) / F.sum(F.col("raw") * F.col("balls")).over(group))
    return stats.join(F.broadcast(weighed.select(*keys, "ord", "each")), "ord").withColumn("weight", F.col("each") * F.col("n"))


def effective_share(fits: DataFrame) -> DataFrame:
    """``fold, half_life, ess``: effective share of each model's training balls."""
    w, n = F.col("each"), F.col("n")
    return fits.groupBy("fold", "half_life").agg((F.pow(F.sum(w * n), 2) / (F.sum(w * w * n) * F.sum(n))).alias("ess"))


def ess_by_half_life(train: DataFrame) -> DataFrame:
    """Effective share of the training rows, averaged over the folds."""
    return effective_share(fold_models(season_cells(train))).groupBy("half_life").agg(F.avg("ess").alias("ess"))


def half_life_scores(train: DataFrame, half_lives: list[float] = HALF_LIVES) -> DataFrame:
    """Log loss, Brier score and effective share of each half-life, averaged over the folds.

    Balls are counted by season and cell, and by season and state, once each; models and
    scores are sums of those counts.
    """
    keys = ("fold", "half_life")
    fits = fold_models(season_cells(train), half_lives)
    r_max = winprob.greatest_r(train)
    grid = outcomes.full_grid(fits, keys).repartition(len(half_lives) * FOLDS, *keys)
    solved = winprob.solve(grid, r_max, keys)
    states = season_states(train).withColumnRenamed("ord", "fold").join(F.broadcast(solved.select("fold").distinct()), "fold").withColumn("half_life", F.explode(F.array(*(F.lit(float(h)) for h in half_lives))))
    scored = winprob.with_wp(states, solved, keys, few=False)
    p, n, wins = F.col("wp"), F.col("n"), F.col("wins")
    loss = wins * row_log_loss(p, F.lit(1)) + (n - wins) * row_log_loss(p, F.lit(0))
    square = wins * (1 - p) * (1 - p) + (n - wins) * p * p
    by = scored.groupBy(*keys).agg((F.sum(loss) / F.sum("n")).alias("log_loss"), (F.sum(square) / F.sum("n")).alias("brier"))
    return by.join(effective_share(fits), list(keys)).groupBy("half_life").agg(*(F.avg(c).alias(c) for c in ("log_loss", "brier", "ess")))


def chosen_half_life(scores: DataFrame, floor: float = ESS_FLOOR) -> DataFrame:
    """One row ``half_life``: the last in falling order (none first) whose loss improves on the last accepted and whose
    effective share reaches ``floor``; if there is none, that of least loss."""
    rank = F.when(F.col("half_life") == 0, F.lit(float("inf"))).otherwise(F.col("half_life"))
    rows = scores.agg(F.sort_array(F.collect_list(F.struct((-rank).alias("k"), "half_life", "log_loss", "ess"))).alias("rows"), F.min_by("half_life", "log_loss").alias("least"))  # one row a half-life
    start = F.struct(F.lit(None).cast("double").alias("best"), F.element_at("rows", 1)["log_loss"].alias("loss"))
    better = lambda a, x: (x["half_life"] > 0) & (x["log_loss"] < a["loss"] - 1e-9) & (x["ess"] >= floor)
    walk = F.aggregate("rows", start, lambda a, x: F.when(better(a, x), F.struct(x["half_life"].alias("best"), x["log_loss"].alias("loss"))).otherwise(a))
    return rows.select(F.coalesce(walk["best"], "least").alias("half_life"))
