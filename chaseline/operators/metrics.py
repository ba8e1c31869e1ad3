"""Scores and calibration of predictions in long form: ``model, ..., p, y``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chase
from . import outcomes, winprob

EPS = 1e-12


def row_log_loss(p: Column, y: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def scores(predictions: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Brier score, log loss and means of each group; ``weight`` names how many equal rows one stands for."""
    p, y = F.col("p"), F.col("y")
    w = F.col(weight) if weight else F.lit(1)
    mean = (lambda x: F.sum(w * x) / F.sum(F.when(x.isNotNull(), w))) if weight else F.avg
    n = F.sum(w) if weight else F.count("*")
    return predictions.groupBy(*keys).agg(mean((p - y) * (p - y)).alias("brier"), mean(row_log_loss(p, y)).alias("log_loss"), mean(p).alias("mean_pred"), mean(y.cast("double")).alias("actual"), n.alias("n"))


def state_counts(balls: DataFrame, *more: str) -> DataFrame:
    """``split, b, w, r, rrr, phase, outcome, y, more, n``: balls that no model of states tells apart, counted; as many rows as there are states, whatever the balls."""
    return balls.groupBy("split", "b", "w", "r", "rrr", "phase", "outcome", "y", *more).agg(F.count("*").alias("n"))


def reliability(predictions: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """Mean prediction and outcome of each occupied bin."""
    return predictions.groupBy(*keys, chase.probability_bin("p", bins).alias("bin")).agg(F.avg("p").alias("conf"), F.avg(F.col("y").cast("double")).alias("acc"), F.count("*").alias("n"))


def calibration_error(predictions: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    curve = reliability(predictions, keys, bins)
    return curve.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def murphy(predictions: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """Reliability, resolution and uncertainty of the binned Brier score."""
    group = Window.partitionBy(*keys)
    curve = reliability(predictions, keys, bins)
    curve = curve.withColumn("total", F.sum("n").over(group)).withColumn("mean", F.sum(F.col("n") * F.col("acc")).over(group) / F.col("total"))
    out = curve.groupBy(*keys).agg(
        F.sum(F.col("n") / F.col("total") * F.pow(F.col("conf") - F.col("acc"), 2)).alias("reliability"), F.sum(F.col("n") / F.col("total") * F.pow(F.col("acc") - F.col("mean"), 2)).alias("resolution"), F.max(F.col("mean") * (1 - F.col("mean"))).alias("uncertainty"),
    )
    return out.withColumn("brier_recon", F.col("reliability") - F.col("resolution") + F.col("uncertainty"))


def murphy_gap(parts: DataFrame, worse: str, better: str) -> DataFrame:
    """How much of two models' Brier gap is reliability, how much lost resolution."""
    side = lambda m: parts.filter(F.col("model") == m).agg(*(F.max(c).alias(c) for c in ("reliability", "resolution", "brier_recon")))
    a, b = side(worse).alias("a"), side(better).alias("b")
    both = a.crossJoin(b)  # two single rows
    gap = F.col("a.brier_recon") - F.col("b.brier_recon")
    rel = F.col("a.reliability") - F.col("b.reliability")
    return both.select(gap.alias("brier_gap"), rel.alias("reliability_gap"), (F.col("b.resolution") - F.col("a.resolution")).alias("resolution_gap"), F.try_divide(rel, gap).alias("reliability_share"))


def markov_predictions(balls: DataFrame) -> DataFrame:
    """``model, split, match_id, ball_index, phase, w, rrr, p, y`` of the base and the cell model and the constant rate."""
    train = balls.filter("split = 'train'").withColumn("weight", F.lit(1.0))
    grids = outcomes.grid_of("base", train).select(F.lit("base Markov").alias("model"), "cell_id", "p").unionByName(outcomes.grid_of("rrr", train).select(F.lit("RRR Markov").alias("model"), "cell_id", "p"))
    surface = winprob.solve(grids, winprob.greatest_r(balls), ("model",))
    columns = ["model", "split", "match_id", "ball_index", "phase", "w", "b", "r", "rrr", "p", "y"]
    models = winprob.with_wp(balls.crossJoin(F.broadcast(grids.select("model").distinct())), surface, ("model",)).withColumnRenamed("wp", "p")
    constant = balls.crossJoin(F.broadcast(train.agg(F.avg(F.col("y").cast("double")).alias("p")))).withColumn("model", F.lit("base-rate const"))
    return models.select(*columns).unionByName(constant.select(*columns))


def split_gap(predictions: DataFrame) -> DataFrame:
    """Mean prediction less mean outcome of each model, in the train split and held out, how far it widens, and both splits' scores.

    ``memoryless_share`` and ``shift_share``: size of the train gap and of the widening beside the held-out gap.
    """
    p, y, split = F.col("p"), F.col("y"), F.col("split")
    parts = {"gap": p - y, "brier": (p - y) * (p - y), "log_loss": row_log_loss(p, y)}
    by = predictions.groupBy("model").agg(*(F.avg(F.when(split == s, v)).alias(f"{k}_{s}") for k, v in parts.items() for s in ("train", "holdout")))
    by = by.withColumn("widening", F.col("gap_holdout") - F.col("gap_train"))
    share = lambda c: F.try_divide(F.abs(c), F.abs("gap_holdout"))
    return by.withColumns({"memoryless_share": share("gap_train"), "shift_share": share("widening")})


def sliced(predictions: DataFrame, by: str) -> DataFrame:
    """Scores and calibration error of each model in each value of ``by``."""
    keys = ["model", by]
    return scores(predictions, keys).join(calibration_error(predictions, keys).drop("n"), keys)


def metric_table(predictions: DataFrame) -> DataFrame:
    """Scores and calibration error of each model, ranked by log loss, ties by name."""
    table = scores(predictions, ["model"]).join(calibration_error(predictions, ["model"]).drop("n"), "model")
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.round("log_loss", 9), "model")))  # one row a model


def gate(table: DataFrame, model: str, references: list[str]) -> DataFrame:
    """``reference, metric, value, reference_value, better, all_better``: whether ``model`` beats each reference on Brier score and log loss."""
    long = table.select("model", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("brier", "log_loss")))))
    own = long.filter(F.col("model") == model).select("metric", "value")
    other = long.filter(F.col("model").isin(references)).select(F.col("model").alias("reference"), "metric", F.col("value").alias("reference_value"))
    rows = other.join(own, "metric").withColumn("better", F.col("value") < F.col("reference_value"))
    return rows.withColumn("all_better", F.min("better").over(Window.partitionBy()))  # two rows a reference


def closure(table: DataFrame, before: str, after: list[str], floor: str) -> DataFrame:
    """One row: how much of the Brier gap of ``before`` over ``floor`` the best of ``after`` closes; null without a gap.

    ``level_closed``: the like for the size of mean prediction less mean outcome.
    """
    pick = lambda m, v: F.max(F.when(F.col("model") == m, v))
    level = F.abs(F.col("mean_pred") - F.col("actual"))
    best = F.min(F.when(F.col("model").isin(after), F.col("brier")))
    row = table.agg((pick(before, F.col("brier")) - pick(floor, F.col("brier"))).alias("gap_before"), (best - pick(floor, F.col("brier"))).alias("gap_after"), pick(before, level).alias("level_before"), F.min(F.when(F.col("model").isin(after), level)).alias("level_after"))
    share = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(a))
    return row.withColumns({"closed": share("gap_before", "gap_after"), "level_closed": share("level_before", "level_after")})


def ahead_behind(predictions: DataFrame) -> DataFrame:
    """Calibration of balls ahead of and behind the required rate, with mean prediction and outcome; ``above``: share of bins whose outcome is over the prediction."""
    target = F.max("r").over(Window.partitionBy("model", "match_id"))
    marked = predictions.withColumn("target", target).withColumn("ahead", chase.ahead_of_rate("target"))
    curve = reliability(marked, ["model", "ahead"])
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    gap = F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")
    return curve.groupBy("model", "ahead").agg(F.sum("n").alias("n"), mean("conf").alias("mean_pred"), mean("acc").alias("actual"), gap.alias("ece"), F.avg((F.col("acc") > F.col("conf")).cast("double")).alias("above"))


#: How far the gap must shrink off the last seasons, and how much of it recalibration must close, to decide.
SHRINK_FLOOR, CLOSED_FLOOR = 0.25, 0.75


def recommendation(slices: DataFrame, gaps: DataFrame, splits: DataFrame, closed: DataFrame, model: str) -> DataFrame:
    """One row: the conditions on ``model``'s error and the first rule that holds, of an era adjustment, recalibration and a hidden state.

    ``slices``: ``ahead_behind``; ``gaps``: ``split_gap``; ``splits``: a column ``shrink``;
    ``closed``: ``closure``. A figure that is null, or a slice that is missing, meets no condition.
    """
    under = F.col("actual") > F.col("mean_pred")
    one = slices.filter(F.col("model") == model).agg((F.coalesce(F.bool_and(under), F.lit(False)) & (F.count_distinct("ahead") == 2)).alias("both_under"))
    shares = gaps.filter(F.col("model") == model).agg(F.max("memoryless_share").alias("memoryless_share"), F.max("shift_share").alias("shift_share"))
    shrink, close = splits.agg(F.max("shrink").alias("shrink")), closed.agg(F.max("closed").alias("closed"))
    row = one.crossJoin(shares).crossJoin(shrink).crossJoin(close)  # single rows
    holds = lambda c: F.coalesce(c, F.lit(False))
    row = row.withColumns({"shrinks": holds(F.col("shrink") > SHRINK_FLOOR), "shift_leads": holds(F.col("shift_share") >= F.col("memoryless_share")), "recalibrates": holds(F.col("closed") >= CLOSED_FLOOR)})
    rules = F.when(F.col("both_under") & F.col("shrinks") & F.col("shift_leads"), "era adjustment").when(F.col("recalibrates"), "recalibration").otherwise("hidden state")
    return row.withColumn("rule", rules)


def gap_by_slice(rows: DataFrame, keys: list[str], least: int = 150) -> DataFrame:
    """Mean value less win rate by right-closed rate slice and ``keys``, where a cell has ``least`` balls."""
    sliced = rows.withColumn("slice", chase.slice_right_closed("rrr")).filter("slice is not null")
    out = sliced.groupBy("slice", *keys).agg(F.count("*").alias("n"), F.avg("wp").alias("mean_wp"), F.avg(F.col("y").cast("double")).alias("win_rate"))
    return out.withColumn("gap", F.col("mean_wp") - F.col("win_rate")).filter(F.col("n") >= least)


def gap_shape(gaps: DataFrame) -> DataFrame:
    """Correlation of the gap with the slice's rank, weighted means, worst, first and last slice, and whether signs differ."""
    ranked = gaps.withColumn("k", F.row_number().over(Window.orderBy("slice")) - 1)  # at most nine rows
    return ranked.agg(
        F.when(F.count("*") > 2, F.corr("k", "gap")).alias("corr_gap"), (F.sum(F.col("mean_wp") * F.col("n")) / F.sum("n")).alias("agg_model"), (F.sum(F.col("win_rate") * F.col("n")) / F.sum("n")).alias("agg_emp"),
        F.min_by("slice", "gap").alias("worst_slice"), F.min_by("gap", "slice").alias("first_gap"), F.max_by("gap", "slice").alias("last_gap"), (F.bool_or(F.col("gap") > 0) & F.bool_or(F.col("gap") < 0)).alias("sign_flips"),
    )


def marginal_tail(balls_with_p: DataFrame, least: int = 150) -> DataFrame:
    """Modelled and observed boundary and wicket shares by right-closed slice."""
    p, o = F.col("p"), F.col("outcome")
    sliced = balls_with_p.withColumn("slice", chase.slice_right_closed("rrr")).filter("slice is not null")
    out = sliced.groupBy("slice").agg(F.count("*").alias("n"), F.avg(p[4] + p[6]).alias("model_boundary"), F.avg(o.isin("4", "6").cast("double")).alias("emp_boundary"), F.avg(p[7]).alias("model_wicket"), F.avg((o == "W").cast("double")).alias("emp_wicket"))
    return out.withColumns({"boundary_shortfall": F.col("emp_boundary") - F.col("model_boundary"), "wicket_shortfall": F.col("emp_wicket") - F.col("model_wicket")}).filter(F.col("n") >= least)


def marginal_distance(balls_with_p: DataFrame) -> DataFrame:
    """Total variation between modelled and observed outcome shares by left-closed slice."""
    k = range(len(chase.OUTCOMES))
    sliced = balls_with_p.withColumn("slice", chase.slice_left_closed("rrr")).withColumn("code", chase.outcome_index("outcome"))
    means = sliced.groupBy("slice").agg(F.count("*").alias("n"), *(F.avg(F.col("p")[i] - (F.col("code") == i).cast("double")).alias(f"d{i}") for i in k))
    return means.select("slice", "n", (sum((F.abs(f"d{i}") for i in k), F.lit(0.0)) * 0.5).alias("tv"), F.greatest(*(F.abs(f"d{i}") for i in k)).alias("max_abs_dev"))


def tail_summary(tail: DataFrame) -> DataFrame:
    """Greatest shortfalls of boundaries and wickets over the slices of ``marginal_tail``, either way, and those of the last slice."""
    parts = [f"{m}_shortfall" for m in ("boundary", "wicket")]
    return tail.agg(*(F.max(F.abs(c)).alias(f"max_{c}") for c in parts), *(F.max_by(c, "slice").alias(f"last_{c}") for c in parts))
