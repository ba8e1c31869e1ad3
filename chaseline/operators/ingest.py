"""Raw deliveries to the ball table, with its audits and its quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chase
from ..sources.deliveries import RAW_SCHEMA, require_columns

HOLDOUT_SEASONS = 3
CONTRACT = ["match_id", "season", "date", "ball_index", "over", "b", "w", "r", "outcome", "rrr", "phase", "striker_balls", "batter", "bowler", "bat_pos", "y", "split"]


def second_innings(raw: DataFrame) -> DataFrame:
    """Second innings with the reasons for which their match is dropped. A missing number of overs counts as not 20."""
    require_columns(raw, RAW_SCHEMA.names)
    flags = {"dls": F.coalesce(F.col("method") == "D/L", F.lit(False)), "no_result": F.coalesce(F.col("result_type") == "no result", F.lit(False)), "non_standard": ~F.col("overs").eqNullSafe(20)}
    game = Window.partitionBy("match_id")
    return raw.filter("innings = 2").withColumns({name: F.max(flag).over(game) for name, flag in flags.items()})


def deliveries(raw: DataFrame) -> DataFrame:
    """Legal balls of the kept matches with wicket flag and absorbed extras, and illegal ones that no legal ball follows.

    Runs of illegal balls go to the next legal ball of the match. The k-th legal ball and
    the illegal ones before it form group k, so one window sum gives them without a join.
    """
    kept = second_innings(raw).filter("not (dls or no_result or non_standard)")
    game = Window.partitionBy("match_id").orderBy("seq")
    fallen = F.col("team_wicket") - F.lag("team_wicket", 1, 0).over(game)
    rows = kept.withColumn("is_wicket", F.when(fallen > 1, F.raise_error(F.lit("team_wicket rose by more than one on a ball"))).otherwise(F.greatest(fallen, F.lit(0))))
    rank = F.sum("valid_ball").over(game.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("ball_no", rank + 1 - F.col("valid_ball"))
    extras = F.when(F.col("valid_ball") == 0, F.col("runs_total")).otherwise(0)
    group = Window.partitionBy("match_id", "ball_no")
    return rows.withColumns({"absorbed": F.sum(extras).over(group), "followed": F.max("valid_ball").over(group) == 1})


def season_table(balls: DataFrame) -> DataFrame:
    """``season, first_date, ord, split``: seasons by first date, ties by label; the last three are held out."""
    firsts = balls.groupBy("season").agg(F.min("date").alias("first_date"))
    order = Window.orderBy("first_date", "season")  # one row a season
    ranked = firsts.withColumn("ord", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    return ranked.select("season", "first_date", "ord", F.when(F.col("ord") >= F.col("n") - HOLDOUT_SEASONS, "holdout").otherwise("train").alias("split"))


def ball_table(raw: DataFrame) -> DataFrame:
    """The ball table: one row a legal ball, with the state before it, its outcome and the match's result."""
    legal = deliveries(raw).filter("valid_ball = 1")
    rows = legal.withColumns({"ball_index": F.col("team_balls") - 1, "w": 10 - (F.col("team_wicket") - F.col("is_wicket")), "r": F.col("runs_target") - (F.col("team_runs") - F.col("runs_total"))})
    effective = F.least(F.col("runs_total") + F.col("absorbed"), F.lit(6))
    rows = rows.withColumns(
        {
            "b": chase.BALLS - F.col("ball_index"), "over": F.floor(F.col("ball_index") / 6).cast("int"), "outcome": F.when(F.col("is_wicket") == 1, "W").otherwise(effective.cast("int").cast("string")),
            "striker_balls": F.greatest(F.col("batter_balls") - 1, F.lit(0)), "y": F.coalesce(F.col("match_won_by") == F.col("batting_team"), F.lit(False)).cast("int"),
        }
    )
    rows = rows.withColumns({"rrr": 6.0 * F.col("r") / F.col("b"), "phase": chase.phase("over"), "w": F.col("w").cast("int")})
    seasons = season_table(rows).select("season", "split")
    return rows.join(F.broadcast(seasons), "season").select(*CONTRACT)


def drop_audit(raw: DataFrame) -> DataFrame:
    """Matches in all and dropped, by reason."""
    total = raw.agg(F.count_distinct("match_id").alias("matches_total"))
    flags = second_innings(raw).groupBy("match_id").agg(*(F.max(c).alias(c) for c in ("dls", "no_result", "non_standard")))
    counts = flags.agg(*(F.count_if(c).alias(c) for c in ("dls", "no_result", "non_standard")), F.count_if(F.expr("dls or no_result or non_standard")).alias("dropped"))
    return total.crossJoin(counts)  # two single rows


def extras_audit(raw: DataFrame) -> DataFrame:
    """Runs of illegal balls folded in and lost at an innings' end, and balls whose runs were cut to six."""
    rows = deliveries(raw)
    illegal, legal = F.col("valid_ball") == 0, F.col("valid_ball") == 1
    return rows.agg(F.sum(F.when(illegal & F.col("followed"), F.col("runs_total")).otherwise(0)).alias("runs_folded_in"), F.sum(F.when(illegal & ~F.col("followed"), F.col("runs_total")).otherwise(0)).alias("runs_dropped_trailing"), F.count_if(legal & (F.col("runs_total") + F.col("absorbed") > 6)).alias("balls_capped"))


def quality_gate(balls: DataFrame, least_rows: int = 1, most_rows: int = 1 << 62) -> DataFrame:
    """``check, ok``: the ball table's invariants; the plausible number of rows is a parameter."""
    game = Window.partitionBy("match_id").orderBy("ball_index")
    falls = lambda c: (F.col(c) <= F.coalesce(F.lag(c).over(game), F.col(c))).alias(f"{c}_falls")
    spread = balls.select("match_id", "b", "w", "y", "outcome", falls("b"), falls("w"), falls("r"))
    by_match = spread.groupBy("match_id").agg(F.count("*").alias("n"), *(F.min(F.expr(e)).alias(a) for e, a in (("b_falls", "b_falls"), ("w_falls", "w_falls"), ("r_falls", "r_falls"), ("b between 1 and 120", "b_range"), ("w between 1 and 10", "w_range"))), (F.min("y") == F.max("y")).alias("y_constant"), F.count_if(F.col("outcome").isin("0", "1")).alias("quiet"), F.count_if(F.col("outcome") == "W").alias("wickets"))
    names = ["b_falls", "w_falls", "r_falls", "b_range", "w_range", "y_constant"]
    whole = by_match.agg(F.sum("n").alias("n"), F.sum("quiet").alias("quiet"), F.sum("wickets").alias("wickets"), *(F.min(c).alias(c) for c in names))
    checks = [(c, F.col(c)) for c in names] + [("row_count", F.col("n").between(least_rows, most_rows)), ("quiet_share", F.col("quiet") >= 0.5 * F.col("n")), ("wicket_rate", (F.col("wickets") > 0.01 * F.col("n")) & (F.col("wickets") < 0.10 * F.col("n")))]
    return whole.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in checks))))
