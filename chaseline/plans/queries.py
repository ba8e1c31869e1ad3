"""The named queries: each runs its operators over whole tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chase
from ..operators import dependence, era, ingest, leverage, metrics, models, outcomes, players, resample, simulate, winprob, wpa
from ..session import cut, shared_path
from ..sources import deliveries, reports, versions
from ..sources.deliveries import from_order_lines
from .oracle import LEFT_SLICE, RIGHT_SLICE, RUNS_OF, balanced_folds, bin_of, draw, isotonic, isotonic_p, logit, logit_p, model, name_key, profile, sql, surface

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The reference's sizes.
REPLICATES, PLAYER_REPLICATES, PERMUTATIONS = 1000, 2000, 200
LEAST_BALLS, SEEDS = 500, 6


def query(twin: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if twin:
            ORACLES[run.__name__] = twin
        return run

    return keep


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, so that engines that add in another order agree; -0 becomes 0."""
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


_KEPT: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, d: str) -> tuple:
    """What the source's files are just now: path, size and time of change of each, as Spark lists them."""
    rows = spark.read.format("binaryFile").load(f"{d}/lineitem.parquet").select("path", "length", "modificationTime")
    return tuple(tuple(r) for r in rows.orderBy("path").collect())


def kept(build: Query) -> Query:
    """Tables that many queries of a session share over one path, built and written once for each state of its files."""

    def get(spark: SparkSession, d: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, d, build.__name__, _state(spark, d))
        if key not in _KEPT:
            _KEPT[key] = cut(build(spark, d))
        return _KEPT[key]

    return get


def raw(spark: SparkSession, d: str) -> DataFrame:
    return from_order_lines(spark.read.parquet(f"{d}/lineitem.parquet"))


@kept
def balls(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ball_table(raw(spark, d))


def train(spark: SparkSession, d: str) -> DataFrame:
    return balls(spark, d).filter("split = 'train'")


@kept
def scored(spark: SparkSession, d: str) -> DataFrame:
    table = balls(spark, d)
    return leverage.scored(table, *leverage.era_model(table))


@kept
def predictions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.markov_predictions(balls(spark, d))


def held_out(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).filter("split = 'holdout'")


def _round(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


@query(sql(
    "SELECT split, count(*) AS n, count(DISTINCT match_id) AS matches, sum(b)::BIGINT AS sum_b, sum(w)::BIGINT AS sum_w, "
    "sum(r)::BIGINT AS sum_r, sum(y)::BIGINT AS sum_y, sum(striker_balls)::BIGINT AS sum_striker, "
    "sum(bat_pos)::BIGINT AS sum_pos, round(sum(rrr), 4) AS sum_rrr, min(season) AS first_season, max(date)::VARCHAR AS last_date "
    "FROM balls GROUP BY split"
))
def contract_summary(spark, d):
    return balls(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("matches"), *(F.sum(c).alias(a) for c, a in (("b", "sum_b"), ("w", "sum_w"), ("r", "sum_r"), ("y", "sum_y"), ("striker_balls", "sum_striker"), ("bat_pos", "sum_pos"))), F.round(F.sum("rrr"), 4).alias("sum_rrr"), F.min("season").alias("first_season"), F.max("date").cast("string").alias("last_date"))


@query(sql(
    "SELECT match_id, ball_index::BIGINT AS ball_index, season, over::BIGINT AS over, b::BIGINT AS b, w::BIGINT AS w, "
    "r::BIGINT AS r, outcome, round(rrr, 6) AS rrr, phase, striker_balls::BIGINT AS striker_balls, batter, bowler, "
    "bat_pos::BIGINT AS bat_pos, y::BIGINT AS y, split FROM balls"
))
def ball_rows(spark, d):
    return r6(balls(spark, d).drop("date"))


@query(sql(
    "SELECT (SELECT count(DISTINCT match_id) FROM raw) AS matches_total, count(*) FILTER (dls) AS dls, "
    "count(*) FILTER (no_result) AS no_result, count(*) FILTER (non_standard) AS non_standard, "
    "count(*) FILTER (dls OR no_result OR non_standard) AS dropped FROM (SELECT DISTINCT match_id, dls, no_result, non_standard "
    "FROM second)"
))
def drop_audit(spark, d):
    return ingest.drop_audit(raw(spark, d))


@query(sql(
    "SELECT (SELECT sum(absorbed)::BIGINT FROM legal) AS runs_folded_in, (SELECT sum(absorbed)::BIGINT "
    "FROM extras) - (SELECT sum(absorbed)::BIGINT FROM legal) AS runs_dropped_trailing, (SELECT count(*) FROM legal "
    "WHERE runs_total + absorbed > 6) AS balls_capped"
))
def extras_audit(spark, d):
    return ingest.extras_audit(raw(spark, d))


@query(sql(f"SELECT outcome, count(*) AS n, {_round('count(*)::DOUBLE / sum(count(*)) OVER () AS share')} FROM balls GROUP BY outcome"))
def outcome_freq(spark, d):
    counts = balls(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return r6(counts.crossJoin(F.broadcast(total)).select("outcome", "n", (F.col("n") / F.col("total")).alias("share")))


@query(sql("SELECT season, first_date::VARCHAR AS first_date, ord, split FROM seasons"))
def season_split(spark, d):
    return r6(ingest.season_table(balls(spark, d)).withColumn("first_date", F.col("first_date").cast("string")))


@query(sql("""SELECT unnest([{'check': 'b_falls', 'ok': bool_and(b <= coalesce(lb, b))}, {'check': 'w_falls', 'ok': bool_and(w <= coalesce(lw, w))}, {'check': 'r_falls', 'ok': bool_and(r <= coalesce(lr, r))}, {'check': 'b_range', 'ok': bool_and(b BETWEEN 1 AND 120)}, {'check': 'w_range', 'ok': bool_and(w BETWEEN 1 AND 10)}, {'check': 'y_constant', 'ok': bool_and(y0 = y1)}, {'check': 'row_count', 'ok': count(*) >= 1}, {'check': 'quiet_share', 'ok': avg((outcome IN ('0', '1'))::INT) >= 0.5}, {'check': 'wicket_rate', 'ok': avg((outcome = 'W')::INT) > 0.01 AND avg((outcome = 'W')::INT) < 0.10}], recursive := true)
    FROM (SELECT *, lag(b) OVER g AS lb, lag(w) OVER g AS lw, lag(r) OVER g AS lr, min(y) OVER (PARTITION BY match_id) AS y0, max(y) OVER (PARTITION BY match_id) AS y1 FROM balls WINDOW g AS (PARTITION BY match_id ORDER BY ball_index))"""))
def quality_gate(spark, d):
    return ingest.quality_gate(balls(spark, d))


@query(sql(f"SELECT k::BIGINT AS ord, {_round('base[k + 1] AS p')} FROM plain_base, range(8) t(k)"))
def base_dist(spark, d):
    return r6(outcomes.base_distribution(outcomes.with_recency(train(spark, d), None)).select(F.posexplode("base").alias("ord", "p")))


@query(sql(f"SELECT phase, w::BIGINT AS w, k::BIGINT AS ord, {_round('parent[k + 1] AS p')} FROM recent_parents, range(8) t(k)"))
def hier_parents(spark, d):
    fit = outcomes.with_recency(train(spark, d), outcomes.ERA_HALF_LIFE)
    return r6(outcomes.parents(fit, outcomes.base_distribution(fit)).select("phase", "w", F.posexplode("parent").alias("ord", "p")))


@query(sql(f"SELECT rb::BIGINT AS rrr_bin, w::BIGINT AS w, phase, k::BIGINT AS ord, {_round('cell[k + 1] AS p')} FROM recent_cells, range(8) t(k)"))
def hier_cells(spark, d):
    fit = outcomes.with_recency(train(spark, d), outcomes.ERA_HALF_LIFE)
    return r6(outcomes.cells(fit).select("rrr_bin", "w", "phase", F.posexplode("cell").alias("ord", "p")))


@query(sql(
    f"SELECT cell_id::BIGINT AS cell_id, rrr_bin::BIGINT AS rrr_bin, w::BIGINT AS w, phase, k::BIGINT AS ord, "
    f"{_round('p[k + 1] AS p')} FROM plain_grid, range(8) t(k)"
))
def cell_lookup(spark, d):
    return r6(outcomes.full_grid(outcomes.with_recency(train(spark, d), None)).select("cell_id", "rrr_bin", "w", "phase", F.posexplode("p").alias("ord", "p")))


@query(sql(f"SELECT season, count(*) AS n, {_round('avg(weight) AS weight')} FROM era GROUP BY season"))
def recency_weights(spark, d):
    return r6(outcomes.with_recency(train(spark, d), outcomes.ERA_HALF_LIFE).groupBy("season").agg(F.count("*").alias("n"), F.avg("weight").alias("weight")))


@query(sql(
    f"SELECT {_round('pow(sum(weight), 2) / (sum(weight * weight) * count(*)) AS ess')}, "
    f"{_round(f'sum({RUNS_OF} * weight) / sum(weight) AS weighted_runs')}, {_round(f'avg({RUNS_OF}) AS mean_runs')} FROM era"
))
def weighted_runs(spark, d):
    rows = outcomes.with_recency(train(spark, d), outcomes.ERA_HALF_LIFE).withColumn("x", chase.runs_of("outcome"))
    w = F.col("weight")
    return r6(rows.agg((F.pow(F.sum(w), 2) / (F.sum(w * w) * F.count("*"))).alias("ess"), (F.sum(F.col("x") * w) / F.sum(w)).alias("weighted_runs"), F.avg("x").alias("mean_runs")))


@query(sql(f"SELECT split, {_round(f'avg({RUNS_OF}) AS mean_runs')}, count(*) AS n FROM balls GROUP BY split"))
def runs_by_split(spark, d):
    return r6(balls(spark, d).groupBy("split").agg(F.avg(chase.runs_of("outcome")).alias("mean_runs"), F.count("*").alias("n")))


_FOLDS = {
    "s2": "SELECT season, row_number() OVER (ORDER BY min(date), season) - 1 AS ord FROM train GROUP BY season",
    "fits": (
        "SELECT t.* EXCLUDE (weight), fold, hl, CASE WHEN hl = 0 THEN 1.0 ELSE pow(0.5::DOUBLE, (fold - 1 - ord) / hl) END AS x "
        "FROM train t JOIN s2 USING (season) JOIN (SELECT ord AS fold FROM s2 WHERE ord > (SELECT max(ord) "
        "FROM s2) - 3) ON ord < fold, (SELECT unnest([0, 8.0, 6.0, 4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5])::DOUBLE AS hl)"
    ),
}


@query(sql((
    f"SELECT hl AS half_life, {_round('avg(e) AS ess')} FROM (SELECT hl, fold, pow(sum(x), 2) / (sum(x * x) * count(*)) AS e "
    f"FROM fits GROUP BY ALL) GROUP BY hl"
), **_FOLDS))
def ess_by_half_life(spark, d):
    return r6(era.ess_by_half_life(train(spark, d)))


@query(sql(
    f"SELECT match_id, ball_index::BIGINT AS ball_index, target::BIGINT AS target, "
    f"{_round('CASE WHEN b < 120 THEN 6.0::DOUBLE * (target - r) / (120 - b) ELSE 0.0 END AS crr', 'w / 10.0::DOUBLE AS w_frac')}, "
    f"(phase = 'powerplay')::BIGINT AS phase_powerplay, (phase = 'middle')::BIGINT AS phase_middle, "
    f"(phase = 'death')::BIGINT AS phase_death FROM (SELECT *, max(r) OVER (PARTITION BY match_id) AS target FROM balls)"
))
def features(spark, d):
    return r6(models.features(balls(spark, d)).select("match_id", "ball_index", "target", "crr", "w_frac", *(f"phase_{p}" for p in chase.PHASES)))


@query(sql(
    "SELECT (target - r) * b > r * (120 - b) AS ahead, count(*) AS n, sum(y)::BIGINT AS wins "
    "FROM (SELECT *, max(r) OVER (PARTITION BY match_id) AS target FROM balls) GROUP BY ahead"
))
def ahead_behind(spark, d):
    return models.features(balls(spark, d)).groupBy(chase.ahead_of_rate("target").alias("ahead")).agg(F.count("*").alias("n"), F.sum("y").alias("wins"))


@query(sql(f"SELECT b::BIGINT AS b, w::BIGINT AS w, r::BIGINT AS r, {_round('wp')} FROM wp_recent"))
def wp_surface(spark, d):
    return r6(leverage.era_model(balls(spark, d))[1])


@query(sql((
    "SELECT count(*) AS states, count(*) FILTER (abs(implied - wp) > 1e-9) AS failures "
    "FROM (SELECT b, w, r, any_value(wp) AS wp, sum(prob * next_wp) AS implied FROM next GROUP BY ALL)"
).replace("GROUP BY ALL", "GROUP BY b, w, r")))
def wp_consistency(spark, d):
    table = balls(spark, d)
    grid, surface = leverage.era_model(table)
    states = winprob.with_wp(outcomes.with_distribution(table.select("b", "w", "r", "rrr", "phase").dropDuplicates(["b", "w", "r"]), grid), surface)
    bad = winprob.inconsistent(states, surface).agg(F.count("*").alias("failures"))
    return states.agg(F.count("*").alias("states")).crossJoin(bad)


@query(sql(f"SELECT match_id, ball_index::BIGINT AS ball_index, {_round('wp', 'li')} FROM scored"))
def ball_wp(spark, d):
    return r6(scored(spark, d).select("match_id", "ball_index", "wp", "li"))


@query(sql(f"SELECT phase, {_round('avg(li) AS mean_li')}, count(*) AS n FROM scored GROUP BY phase"))
def leverage_by_phase(spark, d):
    return r6(leverage.leverage_by(scored(spark, d), "phase"))


@query(sql(f"SELECT over::BIGINT AS over, {_round('avg(li) AS mean_li')}, count(*) AS n FROM scored GROUP BY over"))
def leverage_by_over(spark, d):
    return r6(leverage.leverage_by(scored(spark, d), "over"))


@query(sql(
    f"(SELECT 'top' AS kind, match_id, ball_index::BIGINT AS ball_index, {_round('li')} FROM scored "
    f"ORDER BY round(li, 9) DESC, match_id, ball_index LIMIT 15) UNION ALL (SELECT 'bottom', match_id, ball_index::BIGINT, "
    f"{_round('li')} FROM scored WHERE b >= 6 ORDER BY round(li, 9), match_id, ball_index LIMIT 10)"
))
def top_leverage(spark, d):
    rows = scored(spark, d).withColumn("li", F.round("li", 9))
    top = leverage.top_states(rows).withColumn("kind", F.lit("top"))
    return r6(top.unionByName(leverage.top_states(rows, 10, 6, True).withColumn("kind", F.lit("bottom"))).select("kind", "match_id", "ball_index", "li"))


@query(sql(
    f"SELECT coalesce(bucket, -1)::BIGINT AS bucket, count(*) AS n, "
    f"{_round('avg(wp) AS mean_from', 'avg(wp_after - wp) AS mean_signed_change')} FROM (SELECT *, {bin_of('wp', 10)} AS bucket "
    f"FROM steps) GROUP BY GROUPING SETS ((bucket), ())"
))
def martingale_drift(spark, d):
    return r6(leverage.martingale_drift(scored(spark, d)))


@query(sql(
    f"SELECT {_round('sum(wpa_bat) AS total_bat', 'sum(wpa_bowl) AS total_bowl', 'sum(wpa_bat_dd) AS total_bat_dd', '(SELECT sum(y - wp) FROM credited WHERE ball_index = 0) AS telescoped')} "
    f"FROM credited"
))
def wpa_totals(spark, d):
    return r6(wpa.totals(wpa.per_ball(scored(spark, d))))


def _player_sql(who: str, side: str) -> str:
    names = [f"sum(wpa_{side}) AS total_wpa", f"sum(wpa_{side}_dd) AS total_wpa_dd", f"100 * avg(wpa_{side}_dd) AS wpa_dd_per100", "avg(li) AS mean_li", f"avg(wpa_{side}_dd) FILTER (li >= 2) AS wpa_high_dd", f"avg(wpa_{side}_dd) FILTER (li < 2) AS wpa_low_dd"]
    return sql((
        f"SELECT {who} AS player, count(*) AS balls, {_round(*names)}, count(*) FILTER (li >= 2) AS n_high FROM credited "
        f"GROUP BY {who} HAVING count(*) >= {LEAST_BALLS}"
    ))


@query(_player_sql("batter", "bat"))
def batter_wpa(spark, d):
    return r6(wpa.by_player(wpa.per_ball(scored(spark, d)), "batter", "bat", LEAST_BALLS))


@query(_player_sql("bowler", "bowl"))
def bowler_wpa(spark, d):
    return r6(wpa.by_player(wpa.per_ball(scored(spark, d)), "bowler", "bowl", LEAST_BALLS))


@query(sql(
    f"SELECT * EXCLUDE (mean9), row_number() OVER (ORDER BY mean9 DESC, player) AS rank "
    f"FROM (SELECT batter AS player, count(*) AS balls, "
    f"{_round('avg(li) AS mean_li', 'median(li) AS median_li', 'median(bat_pos) AS median_pos')}, "
    f"round(avg((phase = 'death')::INT), 6) + 0.0 AS death_share, round(avg(li), 9) AS mean9 FROM scored GROUP BY batter "
    f"HAVING count(*) >= {LEAST_BALLS})"
))
def player_leverage(spark, d):
    return r6(players.player_leverage(scored(spark, d), "batter", LEAST_BALLS))


def _leverage_table(who: str) -> str:
    """A common table in the form of ``players.player_leverage``."""
    means = _round("avg(li) AS mean_li", "median(li) AS median_li", "median(bat_pos) AS median_pos", "avg((phase = 'death')::INT) AS death_share")
    return f"""
        SELECT * EXCLUDE (mean9), row_number() OVER (ORDER BY mean9 DESC, player) AS rank
        FROM (SELECT {who} AS player, count(*) AS balls, {means}, round(avg(li), 9) AS mean9 FROM scored GROUP BY {who} HAVING count(*) >= {LEAST_BALLS})
    """


@query(sql(_leverage_table("bowler")))
def bowler_leverage(spark, d):
    return r6(players.player_leverage(scored(spark, d), "bowler", LEAST_BALLS))


_LISTED = """
    SELECT '{who}' AS side, list, place, player, balls, mean_li, median_li, median_pos, death_share, rank
    FROM (SELECT *, unnest([{{'list': 'top', 'place': rank, 'most': 20}}, {{'list': 'bottom', 'place': count(*) OVER () - rank + 1, 'most': 10}}], recursive := true) FROM {who}_table)
    WHERE place <= most
"""


@query(sql(" UNION ALL ".join(_LISTED.format(who=who) for who in ("batter", "bowler")), **{f"{who}_table": _leverage_table(who) for who in ("batter", "bowler")}))
def leverage_lists(spark, d):
    """The twenty players of most and the ten of least leverage, batters and bowlers."""
    tables = ((who, players.player_leverage(scored(spark, d), who, LEAST_BALLS)) for who in ("batter", "bowler"))
    return r6(reduce(DataFrame.unionByName, (players.leverage_lists(table).withColumn("side", F.lit(who)) for who, table in tables)))


_POSITIONS = "SELECT bat_pos AS x, round_even(avg(li), 3) AS y FROM scored WHERE bat_pos IS NOT NULL GROUP BY bat_pos"


@query(sql(" UNION ALL ".join(f"SELECT '{scope}' AS scope, {_round('corr(x, y) AS correlation')}, count(*) AS positions FROM positions WHERE {where}" for scope, where in (("1-7", "x <= 7"), ("all", "true"))), positions=_POSITIONS))
def position_correlations(spark, d):
    return r6(players.position_correlations(players.by_position(scored(spark, d))))


@query(sql(
    f"SELECT bat_pos::BIGINT AS bat_pos, {_round('avg(li) AS mean_li')}, count(*) AS n, round(avg((phase = 'death')::INT), "
    f"6) + 0.0 AS death_share FROM scored GROUP BY bat_pos"
))
def position_profile(spark, d):
    return r6(players.by_position(scored(spark, d)))


def _corr_sql() -> str:
    side = lambda who: (
        f"SELECT '{who}' AS side, {_round('corr(x, y) AS correlation')}, count(*) AS players "
        f"FROM (SELECT round_even(avg(li), 3) AS x, round_even(avg((phase = 'death')::INT), 3) AS y FROM scored GROUP BY {who} "
        f"HAVING count(*) >= {LEAST_BALLS})"
    )
    return sql(f"{side('batter')} UNION ALL {side('bowler')}")


@query(_corr_sql())
def leverage_correlations(spark, d):
    return r6(players.leverage_correlations(scored(spark, d), LEAST_BALLS))


_LL = "-(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))"


@query(sql(
    f"SELECT model, {_round('avg(pow(p - y, 2)) AS brier', f'avg({_LL}) AS log_loss', 'avg(p) AS mean_pred', 'avg(y) AS actual')}, "
    f"count(*) AS n FROM held GROUP BY model"
))
def brier_logloss(spark, d):
    return r6(metrics.scores(held_out(spark, d), ["model"]))


@query(sql(f"SELECT model, {_round('sum(n * abs(conf - acc)) / sum(n) AS ece')}, sum(n)::BIGINT AS n FROM curve GROUP BY model"))
def ece(spark, d):
    return r6(metrics.calibration_error(held_out(spark, d), ["model"]))


@query(sql(
    f"SELECT model, phase, {_round('sum(n * abs(conf - acc)) / sum(n) AS ece')}, sum(n)::BIGINT AS n "
    f"FROM (SELECT model, phase, {bin_of('p', 15)} AS bin, avg(p) AS conf, avg(y) AS acc, count(*) AS n FROM held GROUP BY ALL) "
    f"GROUP BY model, phase"
))
def ece_by_phase(spark, d):
    return r6(metrics.calibration_error(held_out(spark, d), ["model", "phase"]))


def _sliced_sql(by: str) -> str:
    curve = (
        f"SELECT model, {by}, sum(n * abs(conf - acc)) / sum(n) AS ece "
        f"FROM (SELECT model, {by}, {bin_of('p', 15)} AS bin, avg(p) AS conf, avg(y) AS acc, count(*) AS n FROM held GROUP BY ALL) "
        f"GROUP BY model, {by}"
    )
    return (
        f"SELECT model, {by}, {_round('brier', 'log_loss', 'mean_pred', 'actual')}, n, {_round('ece')} "
        f"FROM (SELECT model, {by}, avg(pow(p - y, 2)) AS brier, avg({_LL}) AS log_loss, avg(p) AS mean_pred, avg(y) AS actual, "
        f"count(*) AS n FROM held GROUP BY model, {by}) JOIN ({curve}) USING (model, {by})"
    )


@query(sql(_sliced_sql("phase")))
def scores_by_phase(spark, d):
    return r6(metrics.sliced(held_out(spark, d), "phase"))


@query(sql(f"SELECT * REPLACE (w::BIGINT AS w) FROM ({_sliced_sql('w')})"))
def scores_by_wickets(spark, d):
    return r6(metrics.sliced(held_out(spark, d), "w"))


@query(sql(f"SELECT model, bin::BIGINT AS bin, {_round('conf', 'acc')}, n FROM curve"))
def reliability(spark, d):
    return r6(metrics.reliability(held_out(spark, d), ["model"]))


_MURPHY = {"m": "SELECT *, sum(n) OVER q AS total, sum(n * acc) OVER q / sum(n) OVER q AS mean FROM curve WINDOW q AS (PARTITION BY model)", "parts": (
    "SELECT model, sum(n / total * pow(conf - acc, 2)) AS reliability, sum(n / total * pow(acc - mean, 2)) AS resolution, "
    "max(mean * (1 - mean)) AS uncertainty FROM m GROUP BY model"
)}


@query(sql((
    f"SELECT model, {_round('reliability', 'resolution', 'uncertainty', 'reliability - resolution + uncertainty AS brier_recon')} "
    f"FROM parts"
), **_MURPHY))
def murphy(spark, d):
    return r6(metrics.murphy(held_out(spark, d), ["model"]))


@query(sql((
    f"SELECT {_round('a.reliability - a.resolution - b.reliability + b.resolution AS brier_gap', 'a.reliability - b.reliability AS reliability_gap', 'b.resolution - a.resolution AS resolution_gap', '(a.reliability - b.reliability) / (a.reliability - a.resolution - b.reliability + b.resolution) AS reliability_share')} "
    f"FROM parts a, parts b WHERE a.model = 'base Markov' AND b.model = 'RRR Markov'"
), **_MURPHY))
def murphy_gap(spark, d):
    return r6(metrics.murphy_gap(metrics.murphy(held_out(spark, d), ["model"]), "base Markov", "RRR Markov"))


def _gap_sql() -> str:
    parts = {"gap": "p - y", "brier": "pow(p - y, 2)", "log_loss": _LL}
    means = [f"{k}_{x}" for k in parts for x in ("train", "holdout")]
    inner = ", ".join(f"avg({v}) FILTER (split = '{x}') AS {k}_{x}" for k, v in parts.items() for x in ("train", "holdout"))
    return (
        f"SELECT model, {_round(*means, 'gap_holdout - gap_train AS widening', 'abs(gap_train) / nullif(abs(gap_holdout), 0) AS memoryless_share', 'abs(gap_holdout - gap_train) / nullif(abs(gap_holdout), 0) AS shift_share')} "
        f"FROM (SELECT model, {inner} FROM predictions GROUP BY model)"
    )


@query(sql(_gap_sql()))
def split_gap(spark, d):
    return r6(metrics.split_gap(predictions(spark, d)))


_SLICES = f"""
    SELECT model, ahead, sum(n)::BIGINT AS n, sum(n * conf) / sum(n) AS mean_pred, sum(n * acc) / sum(n) AS actual,
        sum(n * abs(conf - acc)) / sum(n) AS ece, avg((acc > conf)::INT) AS above
    FROM (
        SELECT model, (target - r) * b > r * (120 - b) AS ahead, {bin_of('p', 15)} AS bin, avg(p) AS conf, avg(y) AS acc, count(*) AS n
        FROM (SELECT *, max(r) OVER (PARTITION BY model, match_id) AS target FROM held) GROUP BY ALL
    ) GROUP BY model, ahead
"""


@query(sql(f"SELECT model, ahead, n, {_round('mean_pred', 'actual', 'ece', 'above')} FROM slices", slices=_SLICES))
def ahead_calibration(spark, d):
    return r6(metrics.ahead_behind(held_out(spark, d)))


_GAP = (
    f"SELECT slice, count(*) AS n, avg(wp) AS mean_wp, avg(y) AS win_rate, avg(wp) - avg(y) AS gap "
    f"FROM (SELECT *, {RIGHT_SLICE} AS slice FROM scored WHERE split = 'train') WHERE slice IS NOT NULL GROUP BY slice "
    f"HAVING count(*) >= 150"
)


@query(sql(f"SELECT slice::BIGINT AS slice, n, {_round('mean_wp', 'win_rate', 'gap')} FROM gaps", gaps=_GAP))
def gap_by_rrr(spark, d):
    return r6(metrics.gap_by_slice(scored(spark, d).filter("split = 'train'"), []))


@query(sql((
    f"SELECT {_round('CASE WHEN count(*) > 2 THEN corr(k, gap) END AS corr_gap', 'sum(mean_wp * n) / sum(n) AS agg_model', 'sum(win_rate * n) / sum(n) AS agg_emp')}, "
    f"arg_min(slice, gap)::BIGINT AS worst_slice, {_round('arg_min(gap, slice) AS first_gap', 'arg_max(gap, slice) AS last_gap')}, "
    f"bool_or(gap > 0) AND bool_or(gap < 0) AS sign_flips FROM (SELECT *, row_number() OVER (ORDER BY slice) - 1 AS k FROM gaps)"
), gaps=_GAP))
def gap_shape(spark, d):
    return r6(metrics.gap_shape(metrics.gap_by_slice(scored(spark, d).filter("split = 'train'"), [])))


@query(sql(
    f"SELECT slice::BIGINT AS slice, w_group, count(*) AS n, "
    f"{_round('avg(wp) AS mean_wp', 'avg(y) AS win_rate', 'avg(wp) - avg(y) AS gap')} "
    f"FROM (SELECT *, {RIGHT_SLICE} AS slice, CASE WHEN w >= 7 THEN '7-10 in hand' WHEN w >= 4 THEN '4-6 in hand' ELSE '1-3 in hand' END AS w_group "
    f"FROM scored WHERE split = 'train') WHERE slice IS NOT NULL GROUP BY slice, w_group HAVING count(*) >= 150"
))
def gap_by_rrr_wickets(spark, d):
    rows = scored(spark, d).filter("split = 'train'").withColumn("w_group", chase.wicket_group("w"))
    return r6(metrics.gap_by_slice(rows, ["w_group"]))


_WITH_P = "SELECT c.*, g.p FROM coded c JOIN plain_grid g USING (cell_id) WHERE split = 'train'"


def _with_p(spark, d):
    fit = outcomes.with_recency(train(spark, d), None)
    return outcomes.with_distribution(fit, outcomes.full_grid(fit))


@query(sql((
    f"SELECT slice::BIGINT AS slice, n, {_round('mb AS model_boundary', 'eb AS emp_boundary', 'mw AS model_wicket', 'ew AS emp_wicket', 'eb - mb AS boundary_shortfall', 'ew - mw AS wicket_shortfall')} "
    f"FROM (SELECT {RIGHT_SLICE} AS slice, count(*) AS n, avg(p[5] + p[7]) AS mb, avg((outcome IN ('4', '6'))::INT) AS eb, "
    f"avg(p[8]) AS mw, avg((outcome = 'W')::INT) AS ew FROM wp_rows GROUP BY ALL) WHERE slice IS NOT NULL AND n >= 150"
), wp_rows=_WITH_P))
def marginal_tail(spark, d):
    return r6(metrics.marginal_tail(_with_p(spark, d)))


@query(sql((
    f"SELECT {_round('max(abs(bs)) AS max_boundary_shortfall', 'max(abs(ws)) AS max_wicket_shortfall', 'arg_max(bs, slice) AS last_boundary_shortfall', 'arg_max(ws, slice) AS last_wicket_shortfall')} "
    f"FROM (SELECT {RIGHT_SLICE} AS slice, count(*) AS n, avg((outcome IN ('4', '6'))::INT) - avg(p[5] + p[7]) AS bs, "
    f"avg((outcome = 'W')::INT) - avg(p[8]) AS ws FROM wp_rows GROUP BY ALL) WHERE slice IS NOT NULL AND n >= 150"
), wp_rows=_WITH_P))
def tail_summary(spark, d):
    return r6(metrics.tail_summary(metrics.marginal_tail(_with_p(spark, d))))


_DEV = ", ".join(f"abs(avg(p[{k + 1}] - (outcome = '{o}')::INT)) AS d{k}" for k, o in enumerate(chase.OUTCOMES))


@query(sql((
    f"SELECT slice::BIGINT AS slice, n, {_round('0.5 * (d0 + d1 + d2 + d3 + d4 + d5 + d6 + d7) AS tv', 'greatest(d0, d1, d2, d3, d4, d5, d6, d7) AS max_abs_dev')} "
    f"FROM (SELECT {LEFT_SLICE} AS slice, count(*) AS n, {_DEV} FROM wp_rows GROUP BY ALL)"
).replace("GROUP BY ALL", "GROUP BY slice"), wp_rows=_WITH_P))
def marginal_tv(spark, d):
    return r6(metrics.marginal_distance(_with_p(spark, d)))


@query(sql(
    f"SELECT {_round('corr(runs, later) AS lag1')}, count(*) AS n_pairs "
    f"FROM (SELECT runs, lead(runs) OVER (PARTITION BY match_id, part ORDER BY ball_index) AS later FROM resid) "
    f"WHERE later IS NOT NULL"
))
def partnership_lag1(spark, d):
    return r6(leverage.partnership_lag1(train(spark, d)))


@query(sql(f"SELECT series, variant, scope, lag::BIGINT AS lag, {_round('r')}, n FROM (SELECT * FROM prof)", prof=profile("resid")))
def lag_profile(spark, d):
    rows = cut(leverage.residuals(train(spark, d)))
    return r6(reduce(DataFrame.unionByName, (dependence.lag_profile(rows, v).withColumn("series", F.lit(v)) for v in dependence.SERIES)))


def _icc_sql(value: str, keys: str, name: str) -> str:
    g = f"(SELECT count(*)::DOUBLE AS n, avg({value}) AS m, var_pop({value}) * count(*) AS ss FROM resid GROUP BY {keys})"
    return (
        f"SELECT '{name}' AS series, {_round('(msb - msw) / (msb + (n0 - 1) * msw) AS icc')}, k AS groups "
        f"FROM (SELECT k, (q - total * grand * grand) / (k - 1) AS msb, ssw / (total - k) AS msw, (total - n2 / total) / (k - 1) AS n0 "
        f"FROM (SELECT count(*) AS k, sum(n) AS total, sum(n * m) / sum(n) AS grand, sum(n * m * m) AS q, sum(ss) AS ssw, "
        f"sum(n * n) AS n2 FROM {g}))"
    )


_ICC = [("runs", ["match_id"], "runs by innings"), ("runs", ["match_id", "part"], "runs by partnership"), ("wkt", ["match_id"], "wickets by innings")]


@query(sql(" UNION ALL ".join(_icc_sql(v, ", ".join(k), n) for v, k, n in _ICC)))
def icc(spark, d):
    rows = leverage.residuals(train(spark, d))
    parts = [dependence.icc(rows, v, k).select(F.lit(n).alias("series"), "icc", "groups") for v, k, n in _ICC]
    return r6(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_SHUFFLE = {
    "copies": (
        f"SELECT rep, match_id, ball_index, part, runs, wkt, row_number() OVER (PARTITION BY rep, match_id "
        f"ORDER BY ball_index) AS k, row_number() OVER (PARTITION BY rep, match_id ORDER BY h, ball_index) AS d "
        f"FROM (SELECT *, {draw('h', 'match_id', 'rep', 'ball_index')} FROM resid, range({PERMUTATIONS}) t(rep))"
    ),
    "mixed": (
        "SELECT a.rep, a.match_id, a.ball_index, a.part, b.runs, b.wkt FROM copies a "
        "JOIN copies b ON a.rep = b.rep AND a.match_id = b.match_id AND a.k = b.d"
    ),
    "nulls": profile("mixed", "rep"),
    "seen": profile("resid"),
    "banded": (
        "SELECT series, variant, scope, s.lag, r, n, null_mean, null_lo, null_hi, "
        "CASE WHEN r > null_hi THEN 'above' WHEN r < null_lo THEN 'below' ELSE 'inside' END AS flag FROM seen s "
        "JOIN (SELECT series, variant, scope, lag, avg(r) AS null_mean, quantile_cont(r, 0.025) AS null_lo, quantile_cont(r, "
        "0.975) AS null_hi FROM nulls GROUP BY ALL) USING (series, variant, scope, lag)"
    ),
}


@kept
def profile_with_null(spark: SparkSession, d: str) -> DataFrame:
    return dependence.permutation_null(leverage.residuals(train(spark, d)), PERMUTATIONS)


@query(sql((
    f"SELECT series, variant, scope, lag::BIGINT AS lag, {_round('r')}, n, {_round('null_mean', 'null_lo', 'null_hi')}, flag "
    f"FROM banded"
), **_SHUFFLE))
def perm_null(spark, d):
    return r6(profile_with_null(spark, d))


_AT = "FILTER (variant = '{}' AND scope = '{}' AND lag = {})".format
_VERDICT = {
    "groups": " UNION ALL ".join(_icc_sql(v, ", ".join(k), n) for v, k, n in _ICC),
    "answers": (
        f"SELECT bool_or(flag = 'above') {_AT('state', 'innings', 1)} AS beyond_innings, "
        f"bool_or(flag = 'above') {_AT('state+innings', 'innings', 1)} AS survives_innings, "
        f"bool_or(flag = 'above') {_AT('state+partnership', 'partnership', 1)} AS survives_partnership, "
        f"max(r) {_AT('state', 'innings', 1)} AS lag1, max(null_mean) {_AT('state', 'innings', 1)} AS null_centre, "
        f"max(r - null_mean) {_AT('state', 'innings', 1)} AS excess_lag1, "
        f"avg(r - null_mean) FILTER (variant = 'state' AND scope = 'innings' AND lag IN (20, 30)) AS excess_tail FROM banded "
        f"WHERE series = 'runs'"
    ),
}


@query(sql((
    f"SELECT beyond_innings, survives_innings, survives_partnership, "
    f"{_round('lag1', 'null_centre', 'excess_lag1', 'excess_tail', 'CASE WHEN lag1 > 0 THEN least(greatest(null_centre / lag1, 0.0), 1.0) END AS share')}, "
    f"excess_lag1 > 0 AND excess_tail < 0.5 * excess_lag1 AS decays, "
    f"CASE WHEN NOT beyond_innings THEN 'heterogeneity-only' WHEN survives_partnership THEN 'sequential' ELSE 'partnership-latent' END AS label, "
    f"(SELECT icc FROM groups WHERE series = 'runs by innings') AS icc_innings, (SELECT icc FROM groups "
    f"WHERE series = 'runs by partnership') AS icc_partnership FROM answers"
), **_SHUFFLE, **_VERDICT))
def dependence_verdict(spark, d):
    rows = cut(leverage.residuals(train(spark, d)))
    parts = [dependence.icc(rows, "runs", keys).select(F.lit(scope).alias("scope"), "icc") for scope, (keys, _) in dependence.SCOPES.items()]
    return r6(dependence.dependence_verdict(profile_with_null(spark, d), parts[0].unionByName(parts[1])))


#: Named pairs of models; the second is better if the difference of log loss is below 0.
_MARKOV_PAIRS = [("base Markov", "RRR Markov"), ("RRR Markov", "RRR Markov (era)")]
_ERA_HELD = (
    "SELECT model, match_id, ball_index, p, y FROM held UNION ALL SELECT 'RRR Markov (era)', match_id, ball_index, wp, y "
    "FROM scored WHERE split = 'holdout'"
)
_BOOT = {
    "with_era": _ERA_HELD,
    "deltas": " UNION ALL ".join((
        f"SELECT '{a} / {b}' AS pair, match_id, v.ll - u.ll AS delta FROM (SELECT match_id, ball_index, {_LL} AS ll FROM with_era "
        f"WHERE model = '{a}') u JOIN (SELECT match_id, ball_index, {_LL} AS ll FROM with_era "
        f"WHERE model = '{b}') v USING (match_id, ball_index)"
    ) for a, b in _MARKOV_PAIRS),
    "sums": (
        "SELECT pair, match_id, sum(delta) AS s, count(*) AS c, row_number() OVER (PARTITION BY pair "
        "ORDER BY match_id) - 1 AS k, count(*) OVER (PARTITION BY pair) AS m FROM deltas GROUP BY pair, match_id"
    ),
    "slots": (
        f"SELECT pair, m, rep, h FROM (SELECT pair, m, rep, {draw('h', '0', name_key('pair'), 'rep', 'k')} "
        f"FROM sums, range({REPLICATES}) z(rep))"
    ),
    "boot": "SELECT x.pair, rep, sum(t.s) / sum(t.c) AS mean FROM slots x JOIN sums t ON x.pair = t.pair AND t.k = x.h % x.m GROUP BY ALL",
}


def _deltas(held: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``pair, match_id, delta``: log loss of the second model less that of the first, ball by ball."""
    rows = held.withColumn("ll", metrics.row_log_loss(F.col("p"), F.col("y")))
    wide = rows.groupBy("match_id", "ball_index").agg(*(F.max(F.when(F.col("model") == m, F.col("ll"))).alias(m) for m in sorted({m for pair in pairs for m in pair})))
    entries = F.array(*(F.struct(F.lit(f"{a} / {b}").alias("pair"), (F.col(f"`{b}`") - F.col(f"`{a}`")).alias("delta")) for a, b in pairs))
    return wide.select("match_id", F.inline(entries))


@kept
def held_with_era(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of the Markov models, the constant and the recency-weighted model."""
    era_rows = scored(spark, d).filter("split = 'holdout'").select(F.lit("RRR Markov (era)").alias("model"), "split", "match_id", "ball_index", "phase", "w", "b", "r", "rrr", F.col("wp").alias("p"), "y")
    return held_out(spark, d).unionByName(era_rows)


@query(sql((
    f"SELECT pair, {_round('lo AS ci_lo', 'hi AS ci_hi', 'point')}, "
    f"CASE WHEN hi < 0 THEN 'yes' WHEN lo <= 0 THEN 'no' ELSE 'worse' END AS verdict "
    f"FROM (SELECT pair, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM boot GROUP BY pair) "
    f"JOIN (SELECT pair, sum(s) / sum(c) AS point FROM sums GROUP BY pair) USING (pair)"
), **_BOOT))
def cluster_bootstrap(spark, d):
    return r6(resample.loss_difference(_deltas(held_with_era(spark, d), _MARKOV_PAIRS), ["pair"], REPLICATES))


_SIDES = {"batter": "bat", "bowler": "bowl"}
_PLAYER_BOOT = {
    "psums": " UNION ALL ".join((
        f"SELECT '{who}' AS side, {who} AS player, match_id, count(*) AS c, sum(li) AS s_li, sum(wpa_{x}_dd) AS s_dd, "
        f"sum(CASE WHEN li >= 2 THEN wpa_{x}_dd ELSE 0 END) AS s_hi, count(*) FILTER (li >= 2) AS c_hi FROM credited GROUP BY ALL"
    ) for who, x in _SIDES.items()),
    "pnum": (
        f"SELECT *, row_number() OVER (PARTITION BY side, player ORDER BY match_id) - 1 AS k, count(*) OVER (PARTITION BY side, "
        f"player) AS m FROM (SELECT *, sum(c) OVER (PARTITION BY side, player) AS balls FROM psums) WHERE balls >= {LEAST_BALLS}"
    ),
    "pslots": (
        f"SELECT side, player, balls, m, rep, h FROM (SELECT side, player, balls, m, rep, "
        f"{draw('h', '0', name_key('side', 'player', 'balls::BIGINT'), 'rep', 'k')} FROM pnum, range({PLAYER_REPLICATES}) z(rep))"
    ),
    "pboot": (
        "SELECT x.side, x.player, x.balls, rep, sum(s_li) / sum(c) AS li, x.balls * sum(s_dd) / sum(c) AS total, "
        "sum(s_hi) / nullif(sum(c_hi), 0) - (sum(s_dd) - sum(s_hi)) / nullif(sum(c) - sum(c_hi), 0) AS split FROM pslots x "
        "JOIN pnum t ON x.side = t.side AND x.player = t.player AND x.h % x.m = t.k GROUP BY x.side, x.player, x.balls, rep"
    ),
    "pci": "SELECT side, player, max(balls)::BIGINT AS balls, " + ", ".join(f"quantile_cont({n}, {q}) AS {n}_{e}" for n in ("li", "total", "split") for q, e in ((0.025, "lo"), (0.975, "hi"))) + ", count(*) FILTER (split IS NULL) AS degenerate FROM pboot GROUP BY side, player",
    "ppoints": (
        "SELECT side, player, sum(s_li) / sum(c) AS li, sum(s_dd) AS total, sum(s_hi) / nullif(sum(c_hi), "
        "0) - (sum(s_dd) - sum(s_hi)) / nullif(sum(c) - sum(c_hi), 0) AS split FROM pnum GROUP BY side, player"
    ),
    "pranks": " UNION ALL ".join((
        f"SELECT side, '{m}' AS measure, player, {m} AS point, row_number() OVER (PARTITION BY side "
        f"ORDER BY round({m}, 9) DESC, player) AS rank, count(*) OVER (PARTITION BY side) AS n FROM ppoints WHERE {m} IS NOT NULL"
    ) for m in ("li", "total")),
    "plong": "SELECT side, player, rep, unnest([{'measure': 'li', 'x': li}, {'measure': 'total', 'x': total}], recursive := true) FROM pboot",
}


def _differences(name: str, pairs: str, keys: str) -> dict[str, str]:
    """Common tables ``name``: ``pairs (side, measure, player, other, point, other_point, keys)`` with intervals."""
    both = (
        f"SELECT q.*, a.x - b.x AS delta FROM {name}_pairs q "
        f"JOIN plong a ON a.side = q.side AND a.measure = q.measure AND a.player = q.player "
        f"JOIN plong b ON b.side = q.side AND b.measure = q.measure AND b.player = q.other AND b.rep = a.rep"
    )
    return {f"{name}_pairs": pairs, name: (
        f"SELECT *, lo > 0 OR hi < 0 AS separated FROM (SELECT side, measure, {keys}, player, other, max(point - other_point) AS diff, "
        f"quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM ({both}) GROUP BY ALL)"
    )}


_ADJACENT = _differences("adj", (
    "SELECT u.side, u.measure, u.rank, u.player, v.player AS other, u.point, v.point AS other_point FROM pranks u "
    "JOIN pranks v ON v.side = u.side AND v.measure = u.measure AND v.rank = u.rank + 1"
), "rank")
_SPAN = _differences("spans", (
    "SELECT u.side, u.measure, kind, u.player, v.player AS other, u.point, v.point AS other_point FROM pranks u "
    "JOIN (SELECT *, unnest([{'kind': 'span', 'at': least(n, 10)}, {'kind': 'anchor', 'at': n}], recursive := true) "
    "FROM pranks) v ON v.side = u.side AND v.measure = u.measure AND v.rank = v.at WHERE u.rank = 1"
), "kind")


@kept
def player_sums(spark: SparkSession, d: str) -> DataFrame:
    return resample.player_sums(wpa.per_ball(scored(spark, d)), _SIDES, LEAST_BALLS)


@kept
def player_boot(spark: SparkSession, d: str) -> DataFrame:
    return resample.replicates_of(player_sums(spark, d), PLAYER_REPLICATES)


@kept
def player_points(spark: SparkSession, d: str) -> DataFrame:
    return resample.points_of(player_sums(spark, d))


def _adjacent(spark: SparkSession, d: str) -> DataFrame:
    boot, points = player_boot(spark, d), player_points(spark, d)
    return resample.adjacent_differences(boot, points, "li").unionByName(resample.adjacent_differences(boot, points, "total"))


@query(sql((
    f"SELECT side, player, balls, {_round(*(f'{m}_{e}' for m in ('li', 'total', 'split') for e in ('lo', 'hi')))}, degenerate "
    f"FROM pci"
), **_PLAYER_BOOT))
def player_ci(spark, d):
    return r6(resample.player_intervals(player_boot(spark, d)))


@query(sql(f"SELECT side, measure, rank, player, other, {_round('diff', 'lo AS diff_lo', 'hi AS diff_hi')}, separated FROM adj", **_PLAYER_BOOT, **_ADJACENT))
def adjacent_diff(spark, d):
    return r6(_adjacent(spark, d))


@query(sql(f"SELECT side, measure, kind, player, other, {_round('diff', 'lo AS diff_lo', 'hi AS diff_hi')}, separated FROM spans", **_PLAYER_BOOT, **_SPAN))
def span_diff(spark, d):
    boot, points = player_boot(spark, d), player_points(spark, d)
    return r6(resample.span_differences(boot, points, "li").unionByName(resample.span_differences(boot, points, "total")))


@query(sql((
    "SELECT s.side, splits, splits_significant, totals_significant, separated_li, separated_total "
    "FROM (SELECT side, count(*) AS splits, count(*) FILTER (split_lo > 0 OR split_hi < 0) AS splits_significant FROM pci "
    "JOIN ppoints p USING (side, player) WHERE p.split IS NOT NULL GROUP BY side) s "
    "JOIN (SELECT side, count(*) FILTER (total_lo > 0 OR total_hi < 0) AS totals_significant FROM pci "
    "JOIN pranks USING (side, player) WHERE measure = 'total' AND rank <= 10 GROUP BY side) t USING (side) "
    "JOIN (SELECT side, count(*) FILTER (separated AND measure = 'li') AS separated_li, "
    "count(*) FILTER (separated AND measure = 'total') AS separated_total FROM adj WHERE rank < 10 GROUP BY side) a USING (side)"
), **_PLAYER_BOOT, **_ADJACENT))
def significance_counts(spark, d):
    return resample.significance_counts(resample.player_intervals(player_boot(spark, d)), player_points(spark, d), _adjacent(spark, d))


def _top_sql() -> str:
    columns = _round("total_wpa_dd", "wpa_high_dd", "wpa_low_dd")
    table = lambda who, x: (
        f"(SELECT {who} AS player, count(*) AS balls, count(*) FILTER (li >= 2) AS n_high, sum(wpa_{x}) AS total_wpa, "
        f"sum(wpa_{x}_dd) AS total_wpa_dd, avg(wpa_{x}_dd) FILTER (li >= 2) AS wpa_high_dd, "
        f"avg(wpa_{x}_dd) FILTER (li < 2) AS wpa_low_dd FROM credited GROUP BY {who} HAVING count(*) >= {LEAST_BALLS})"
    )
    one = lambda who, x, name, by, where: (
        f"(SELECT '{who}' AS side, '{name}' AS list, row_number() OVER (ORDER BY round({by}, 9) DESC, player) AS rank, player, balls, "
        f"n_high, {columns} FROM {table(who, x)} WHERE {where} QUALIFY rank <= 20)"
    )
    return " UNION ALL ".join(one(who, x, *of) for who, x in _SIDES.items() for of in (("total", "total_wpa_dd", "true"), ("clutch", "wpa_high_dd", "n_high >= 100")))


@query(sql(_top_sql()))
def top_wpa(spark, d):
    credited = wpa.per_ball(scored(spark, d))
    return r6(reduce(DataFrame.unionByName, (wpa.top_lists(wpa.by_player(credited, who, side, LEAST_BALLS)).withColumn("side", F.lit(who)) for who, side in _SIDES.items())))


@query(sql(" UNION ALL ".join((
    f"(SELECT '{who}' AS side, {who} AS player, {_round(f'sum(wpa_{x}) AS total_wpa', f'sum(wpa_{x}_dd) AS total_wpa_dd')} "
    f"FROM credited GROUP BY {who} HAVING count(*) >= {LEAST_BALLS} "
    f"ORDER BY round(sum(wpa_{x}) - sum(wpa_{x}_dd), 9) {way}, {who} LIMIT 1)"
) for who, x, way in (("batter", "bat", "DESC"), ("bowler", "bowl", "ASC")))))
def wpa_inversions(spark, d):
    credited = wpa.per_ball(scored(spark, d))
    return r6(wpa.inversions(*(wpa.by_player(credited, who, side, LEAST_BALLS) for who, side in _SIDES.items())))


@query(sql(
    f"SELECT match_id, ball_index::BIGINT AS ball_index, slice::BIGINT AS slice FROM (SELECT *, {LEFT_SLICE} AS slice FROM balls "
    f"WHERE split = 'train') QUALIFY row_number() OVER (PARTITION BY slice "
    f"ORDER BY md5('0|' || match_id || '|' || ball_index), match_id, ball_index) <= 220"
))
def stratified_sample(spark, d):
    rows = train(spark, d).withColumn("slice", chase.slice_left_closed("rrr"))
    return r6(resample.stratified_sample(rows, "slice").select("match_id", "ball_index", "slice"))


_CELLS = "SELECT cell_id::BIGINT AS cell, row_number() OVER (ORDER BY match_id, ball_index) - 1 AS pos FROM coded WHERE split = 'train'"


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """``cell, pos``: each training ball's cell and its place among all of them."""
    rows = train(spark, d).select("match_id", "ball_index", chase.cell_id(chase.rrr_bin("rrr"), "w", chase.phase_index("phase")).cast("long").alias("cell"))
    return resample.before(rows, [], ["match_id", "ball_index"], F.lit(1)).select("cell", F.col("before").alias("pos"))


@query(sql("SELECT cell, count(*) AS positions, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM placed GROUP BY cell", placed=_CELLS))
def cell_index(spark, d):
    return _positions(spark, d).groupBy("cell").agg(F.count("*").alias("positions"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(sql("SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY pos) - 1 AS k, pos FROM placed", placed=_CELLS))
def cell_positions(spark, d):
    """The inverted index as rows: the k-th position of each cell. A cell's list is never gathered."""
    return resample.before(_positions(spark, d), ["cell"], ["pos"], F.lit(1)).select("cell", F.col("before").alias("k"), "pos")


def _fold_tables() -> dict[str, str]:
    """``hl_scores (half_life, log_loss, brier, ess)`` by one recursive solution of all folds' models."""
    keyed = model("hl", "hl_fit", "fold, hl")
    return {
        **_FOLDS,
        "hl_fit": "SELECT *, x * (count(*) OVER k / sum(x) OVER k) AS weight FROM fits WINDOW k AS (PARTITION BY fold, hl)",
        **keyed,
        **surface("hl_wp", "hl_list", "fold, hl"),
        "hl_valid": (
            "SELECT fold, hl, y, wp AS p FROM (SELECT train.*, ord AS fold FROM train JOIN s2 USING (season)) v "
            "JOIN hl_wp USING (fold, b, w, r)"
        ),
        "hl_scores": (
            f"SELECT hl AS half_life, avg(ll) AS log_loss, avg(br) AS brier, avg(e) AS ess "
            f"FROM (SELECT fold, hl, avg({_LL}) AS ll, avg(pow(p - y, 2)) AS br FROM hl_valid GROUP BY ALL) "
            f"JOIN (SELECT fold, hl, pow(sum(weight), 2) / (sum(weight * weight) * count(*)) AS e FROM hl_fit "
            f"GROUP BY ALL) USING (fold, hl) GROUP BY hl"
        ),
    }


@kept
def half_lives(spark: SparkSession, d: str) -> DataFrame:
    return era.half_life_scores(train(spark, d))


@query(sql(f"SELECT half_life, {_round('log_loss', 'brier', 'ess')} FROM hl_scores", **_fold_tables()))
def half_life_cv(spark, d):
    return r6(half_lives(spark, d))


_WALK = {
    "hl_ranked": "SELECT *, row_number() OVER (ORDER BY CASE WHEN half_life = 0 THEN 1e9 ELSE half_life END DESC) AS k FROM hl_scores",
    "walk": (
        "SELECT k, NULL::DOUBLE AS best, log_loss AS loss FROM hl_ranked WHERE k = 1 "
        "UNION ALL SELECT r.k, CASE WHEN r.log_loss < w.loss - 1e-9 AND r.ess >= 0.15 THEN r.half_life ELSE w.best END, "
        "CASE WHEN r.log_loss < w.loss - 1e-9 AND r.ess >= 0.15 THEN r.log_loss ELSE w.loss END FROM walk w "
        "JOIN hl_ranked r ON r.k = w.k + 1"
    ),
}


@query(sql((
    "SELECT coalesce((SELECT arg_max(best, k) FROM walk WHERE k = (SELECT max(k) "
    "FROM walk)), (SELECT arg_min(half_life, log_loss) FROM hl_scores)) AS half_life"
), **_fold_tables(), **_WALK))
def half_life_choice(spark, d):
    return era.chosen_half_life(half_lives(spark, d))


def _fit_and_held(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    table = cut(models.features(balls(spark, d)))
    return table.filter("split = 'train'"), table.filter("split = 'holdout'")


_COLUMNS = ["model", "split", "match_id", "ball_index", "phase", "w", "b", "r", "rrr", "p", "y"]


def _named(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("model", F.lit(name)).select(*_COLUMNS)


@kept
def logits(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of the logistic models."""
    fit, held = _fit_and_held(spark, d)
    return _named(models.logistic(fit, held, ["rrr"]), "logit rrr").unionByName(_named(models.logistic(fit, held, models.FULL, True), "logit full"))


@kept
def boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of boosted trees on three nested sets of features, each row with the report of its model's fit."""
    fit, held = _fit_and_held(spark, d)
    predicted, report = models.boosted(fit, held, models.NESTED)
    return predicted.join(F.broadcast(report), "model")  # a row a model


#: Features, both logistic fits and the held-out predictions of all models but the trees.
_LOGITS = {
    "feat": """
        SELECT *, CASE WHEN b < 120 THEN 6.0::DOUBLE * (target - r) / (120 - b) ELSE 0.0 END AS crr, w / 10.0::DOUBLE AS w_frac,
            (phase = 'powerplay')::INT AS phase_powerplay, (phase = 'middle')::INT AS phase_middle, (phase = 'death')::INT AS phase_death
        FROM (SELECT *, max(r) OVER (PARTITION BY match_id) AS target FROM balls)
    """,
    "feat_train": "SELECT * FROM feat WHERE split = 'train'",
    **logit("one", "feat_train", ["rrr"]),
    **logit("full", "feat_train", models.FULL, True),
    "simple": f"""
        {_ERA_HELD}
        UNION ALL SELECT 'logit rrr', match_id, ball_index, {logit_p(["rrr"])}, y FROM feat, one_fit WHERE split = 'holdout'
        UNION ALL SELECT 'logit full', match_id, ball_index, {logit_p(models.FULL)}, y FROM feat, full_fit WHERE split = 'holdout'
    """,
}


def _scores_sql(table: str) -> str:
    """Scores of each model of ``table (model, p, y)``, as a query."""
    return (
        f"SELECT model, avg(pow(p - y, 2)) AS brier, avg({_LL}) AS log_loss, avg(p) AS mean_pred, avg(y) AS actual, count(*) AS n "
        f"FROM {table} GROUP BY model"
    )


def _logit_sql(name: str) -> str:
    return sql(f"SELECT model, {_round('brier', 'log_loss', 'mean_pred', 'actual')}, n FROM ({_scores_sql('simple')}) WHERE model = '{name}'", **_LOGITS)


@query(_logit_sql("logit rrr"))
def logit_rrr(spark, d):
    return r6(metrics.scores(logits(spark, d).filter("model = 'logit rrr'"), ["model"]))


@query(_logit_sql("logit full"))
def logit_full(spark, d):
    return r6(metrics.scores(logits(spark, d).filter("model = 'logit full'"), ["model"]))


@query()
def gbt_nested(spark, d):
    """Held-out scores of the boosted trees, with the best round, the rounds made, and the log loss on the training and on the stopping season."""
    trees = boosted_trees(spark, d)
    fits = trees.groupBy("model").agg(*(F.first(c).alias(c) for c in ("best_round", "rounds", "train_log_loss", "valid_log_loss")))
    return r6(metrics.scores(trees, ["model"]).join(fits, "model"))


def _simple_models(spark: SparkSession, d: str) -> DataFrame:
    return held_with_era(spark, d).unionByName(logits(spark, d))


def _every_model(spark: SparkSession, d: str) -> DataFrame:
    return _simple_models(spark, d).unionByName(boosted_trees(spark, d).select(*_COLUMNS))


#: As the reference pairs its models.
_PAIRS = [("RRR Markov", "GBT (b,w,r)"), ("GBT (b,w,r)", "GBT (b,w,r)+striker"), ("GBT (b,w,r)+striker", "GBT (full)"), ("RRR Markov", "GBT (full)"), ("RRR Markov", "RRR Markov (era)")]


@query()
def model_comparisons(spark, d):
    return r6(resample.loss_difference(_deltas(_every_model(spark, d), _PAIRS), ["pair"], REPLICATES))


@query()
def model_table(spark, d):
    return r6(metrics.metric_table(_every_model(spark, d)))


@query(sql((
    f"SELECT model, {_round('brier', 'log_loss', 'mean_pred', 'actual')}, n, {_round('ece')}, "
    f"row_number() OVER (ORDER BY round(log_loss, 9), model) AS rank "
    f"FROM (SELECT model, avg(pow(p - y, 2)) AS brier, avg({_LL}) AS log_loss, avg(p) AS mean_pred, avg(y) AS actual, "
    f"count(*) AS n FROM with_era GROUP BY model) JOIN (SELECT model, sum(n * abs(conf - acc)) / sum(n) AS ece "
    f"FROM (SELECT model, {bin_of('p', 15)} AS bin, avg(p) AS conf, avg(y) AS acc, count(*) AS n FROM with_era GROUP BY ALL) "
    f"GROUP BY model) USING (model)"
), with_era=_ERA_HELD))
def markov_table(spark, d):
    return r6(metrics.metric_table(held_with_era(spark, d)))


_GATE = f"""
    SELECT o.model AS reference, o.metric, o.x AS reference_value, own.x AS value, own.x < o.x AS better, bool_and(own.x < o.x) OVER () AS all_better
    FROM (UNPIVOT (SELECT model, brier, log_loss FROM table_of) ON brier, log_loss INTO NAME metric VALUE x) o
    JOIN (UNPIVOT (SELECT model, brier, log_loss FROM table_of) ON brier, log_loss INTO NAME metric VALUE x) own ON own.metric = o.metric AND own.model = 'RRR Markov'
    WHERE o.model IN ('base-rate const', 'logit rrr')
"""


@query(sql(f"SELECT reference, metric, {_round('value', 'reference_value')}, better, all_better FROM ({_GATE})", **_LOGITS, table_of=_scores_sql("simple")))
def gate_verdict(spark, d):
    """Whether the cell model beats the constant rate and the one-feature logistic."""
    return r6(metrics.gate(metrics.metric_table(_simple_models(spark, d)), "RRR Markov", ["base-rate const", "logit rrr"]))


def _closure_sql(table: str, before: str, after: list[str], floor: str) -> str:
    """A query in the form of ``metrics.closure`` over scores by model."""
    names = ", ".join(f"'{m}'" for m in after)
    pick = lambda m, v: f"max({v}) FILTER (model = '{m}')"
    level = "abs(mean_pred - actual)"
    row = f"""
        SELECT {pick(before, "brier")} - {pick(floor, "brier")} AS gap_before, min(brier) FILTER (model IN ({names})) - {pick(floor, "brier")} AS gap_after,
            {pick(before, level)} AS level_before, min({level}) FILTER (model IN ({names})) AS level_after
        FROM {table}
    """
    return (
        f"SELECT *, (gap_before - gap_after) / nullif(gap_before, 0) AS closed, (level_before - level_after) / nullif(level_before, "
        f"0) AS level_closed FROM ({row})"
    )


_CLOSURE_COLUMNS = _round("gap_before", "gap_after", "level_before", "level_after", "closed", "level_closed")


def _state_models(counts: DataFrame, surfaces: dict[str, DataFrame]) -> DataFrame:
    """``model, p, y, n``: held-out ``counts`` (see ``metrics.state_counts``) by the cell model and the one-feature logistic, both fitted on the training ones, and by other ``surfaces``."""
    fit, held = counts.filter("split = 'train'"), counts.filter("split = 'holdout'")
    own = winprob.solve(outcomes.full_grid(fit.withColumn("weight", F.col("n").cast("double"))), winprob.greatest_r(counts))
    parts = [winprob.with_wp(held, found).select(F.lit(m).alias("model"), F.col("wp").alias("p"), "y", "n") for m, found in ({"RRR Markov": own} | surfaces).items()]
    parts.append(models.logistic(fit, held, ["rrr"], weight="n").select(F.lit("logit rrr").alias("model"), "p", "y", "n"))
    return reduce(DataFrame.unionByName, parts)


@query(sql(f"SELECT {_CLOSURE_COLUMNS} FROM ({_closure_sql('table_of', 'RRR Markov', ['RRR Markov (era)'], 'logit rrr')})", **_LOGITS, table_of=_scores_sql("simple")))
def era_closure(spark, d):
    """How much of the cell model's gap to the one-feature logistic recency weights close."""
    table = balls(spark, d)
    found = _state_models(cut(metrics.state_counts(table)), {"RRR Markov (era)": leverage.era_model(table)[1]})
    return r6(metrics.closure(metrics.scores(found, ["model"], "n"), "RRR Markov", ["RRR Markov (era)"], "logit rrr"))


def _split_score(spark: SparkSession, table: DataFrame, name: str) -> DataFrame:
    """Brier scores of the cell model and the one-feature logistic on one split."""
    both = metrics.scores(_state_models(cut(metrics.state_counts(table)), {}), ["model"], "n")
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("brier")))
    return both.agg(pick("RRR Markov").alias("markov_brier"), pick("logit rrr").alias("logit_brier"), F.max("n").alias("n")).select(F.lit(name).alias("split"), "markov_brier", "logit_brier", (F.col("markov_brier") - F.col("logit_brier")).alias("gap"), "n")


def _split_tables() -> dict[str, str]:
    """``split_rows``: both models' scores under each split, with the cell model and the logistic fitted anew."""
    other = "SELECT * EXCLUDE (split), CASE WHEN {} THEN 'holdout' ELSE 'train' END AS split FROM {}".format
    splits = {
        "last seasons": ("sp_last", "SELECT * FROM balls"),
        "matches": ("sp_fold", other("fold = 0", "balls JOIN match_folds USING (match_id)")),
        "middle season": ("sp_mid", other("season = (SELECT season FROM seasons WHERE ord = (SELECT count(*) // 2 FROM seasons))", "balls")),
    }
    tables, rows = balanced_folds("match_folds", "balls"), []
    for label, (name, text) in splits.items():
        tables |= {name: text, f"{name}_train": f"SELECT *, 1.0::DOUBLE AS weight FROM {name} WHERE split = 'train'"}
        tables |= model(f"{name}_cell", f"{name}_train") | surface(f"{name}_wp", f"{name}_cell_list") | logit(f"{name}_lr", f"{name}_train", ["rrr"])
        held = f"SELECT y, wp, {logit_p(['rrr'])} AS p FROM {name} JOIN {name}_wp USING (b, w, r), {name}_lr_fit WHERE split = 'holdout'"
        rows.append((
            f"SELECT '{label}' AS split, avg(pow(wp - y, 2)) AS markov_brier, avg(pow(p - y, 2)) AS logit_brier, avg(pow(wp - y, "
            f"2)) - avg(pow(p - y, 2)) AS gap, count(*) AS n FROM ({held})"
        ))
    first, others = "max(gap) FILTER (split = 'last seasons') OVER ()", "avg(gap) FILTER (split <> 'last seasons') OVER ()"
    return tables | {"split_rows": f"SELECT *, ({first} - {others}) / nullif({first}, 0) AS shrink FROM ({' UNION ALL '.join(rows)})"}


@kept
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    table = balls(spark, d)
    middle = ingest.season_table(table).select("season", "ord").orderBy("ord").collect()  # a row a season
    splits = {"last seasons": table, "matches": models.with_fold_out(table), "middle season": models.with_season_out(table, middle[len(middle) // 2]["season"])}
    rows = cut(reduce(DataFrame.unionByName, (_split_score(spark, t, n) for n, t in splits.items())))
    first, others = F.max(F.when(F.col("split") == "last seasons", F.col("gap"))), F.avg(F.when(F.col("split") != "last seasons", F.col("gap")))
    return rows.crossJoin(rows.agg(F.try_divide(first - others, first).alias("shrink")))  # one row


@query(sql(f"SELECT split, {_round('markov_brier', 'logit_brier', 'gap', 'shrink')}, n FROM split_rows", **_split_tables()))
def split_robustness(spark, d):
    """The cell model's Brier gap to the logistic held out by last seasons, by whole matches and by the middle one of all seasons."""
    return r6(split_rows(spark, d))


@query(sql("SELECT match_id, fold::BIGINT AS fold FROM match_folds", **balanced_folds("match_folds", "balls")))
def grouped_folds(spark, d):
    """The fold of each match."""
    return r6(models.grouped_fold(balls(spark, d)).groupBy("match_id").agg(F.max("fold").alias("fold")))


@kept
def recalibrated(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of the surface fitted without the last training season, raw and recalibrated on that season, and of the logistic fitted likewise; ``n`` balls a row."""
    table = balls(spark, d)
    seasons = ingest.season_table(table.filter("split = 'train'")).agg(F.max_by("season", "ord").alias("last"))
    marked = cut(metrics.state_counts(table.crossJoin(F.broadcast(seasons)).withColumn("held", F.col("season") == F.col("last")), "held"))
    fit = marked.filter("split = 'train' and not held").withColumn("weight", F.col("n").cast("double"))
    rows = winprob.with_wp(marked, winprob.solve(outcomes.full_grid(fit), winprob.greatest_r(marked)))
    calibration, score = rows.filter("held"), rows.filter("split = 'holdout'")
    parts = [f(calibration, score, weight="n").select(F.lit(m).alias("model"), "p", "y", "n") for m, f in (("isotonic", models.isotonic), ("platt", models.platt))]
    parts += [score.select(F.lit("raw").alias("model"), F.col("wp").alias("p"), "y", "n"), models.logistic(fit, score, ["rrr"], weight="n").select(F.lit("logit rrr").alias("model"), "p", "y", "n")]
    return reduce(DataFrame.unionByName, parts)


_LAST_TRAINED = "(SELECT arg_max(season, ord) FROM seasons WHERE split = 'train')"
_RECAL = {
    "rc_train": f"SELECT *, 1.0::DOUBLE AS weight FROM balls WHERE split = 'train' AND season <> {_LAST_TRAINED}",
    **model("rc_cell", "rc_train"),
    **surface("rc_wp", "rc_cell_list"),
    "rc_rows": "SELECT * FROM balls JOIN rc_wp USING (b, w, r)",
    "rc_cal": f"SELECT wp AS p, wp, y FROM rc_rows WHERE split = 'train' AND season = {_LAST_TRAINED}",
    **isotonic("rc_iso", "rc_cal"),
    **logit("rc_platt", "rc_cal", ["wp"]),
    **logit("rc_lr", "rc_train", ["rrr"]),
    "rc_held": "SELECT rrr, wp, y FROM rc_rows WHERE split = 'holdout'",
    "recal": f"""
        SELECT 'raw' AS model, wp AS p, y FROM rc_held
        UNION ALL SELECT 'isotonic', iso, y FROM ({isotonic_p("rc_iso", "SELECT wp, y FROM rc_held")})
        UNION ALL SELECT 'platt', {logit_p(["wp"])}, y FROM rc_held, rc_platt_fit
        UNION ALL SELECT 'logit rrr', {logit_p(["rrr"])}, y FROM rc_held, rc_lr_fit
    """,
}


@query(sql(f"SELECT model, {_round('brier', 'log_loss', 'mean_pred', 'actual')}, n FROM ({_scores_sql('recal')})", **_RECAL))
def isotonic_platt(spark, d):
    return r6(metrics.scores(recalibrated(spark, d), ["model"], "n"))


def _recal_closure(spark: SparkSession, d: str) -> DataFrame:
    return metrics.closure(metrics.scores(recalibrated(spark, d), ["model"], "n"), "raw", ["isotonic", "platt"], "logit rrr")


_RECAL_CLOSED = {"recal_scores": _scores_sql("recal"), "recal_closed": _closure_sql("recal_scores", "raw", ["isotonic", "platt"], "logit rrr")}


@query(sql(f"SELECT {_CLOSURE_COLUMNS} FROM recal_closed", **_RECAL, **_RECAL_CLOSED))
def recalibration_closure(spark, d):
    """How much of the raw surface's gap to the logistic recalibration closes."""
    return r6(_recal_closure(spark, d))


_RULES = {
    "gap_shares": (
        "SELECT abs(t) / nullif(abs(h), 0) AS memoryless_share, abs(h - t) / nullif(abs(h), 0) AS shift_share "
        "FROM (SELECT avg(p - y) FILTER (split = 'train') AS t, avg(p - y) FILTER (split = 'holdout') AS h FROM predictions "
        "WHERE model = 'RRR Markov')"
    ),
    "conditions": f"""
        SELECT coalesce((SELECT bool_and(actual > mean_pred) AND count(*) = 2 FROM slices WHERE model = 'RRR Markov'), false) AS both_under, memoryless_share, shift_share,
            (SELECT max(shrink) FROM split_rows) AS shrink, (SELECT closed FROM recal_closed) AS closed
        FROM gap_shares
    """,
    "judged": (
        f"SELECT *, coalesce(shrink > {metrics.SHRINK_FLOOR}, false) AS shrinks, coalesce(shift_share >= memoryless_share, "
        f"false) AS shift_leads, coalesce(closed >= {metrics.CLOSED_FLOOR}, false) AS recalibrates FROM conditions"
    ),
}


@query(
    sql(
        f"""SELECT both_under, {_round('memoryless_share', 'shift_share', 'shrink', 'closed')}, shrinks, shift_leads, recalibrates,
            CASE WHEN both_under AND shrinks AND shift_leads THEN 'era adjustment' WHEN recalibrates THEN 'recalibration' ELSE 'hidden state' END AS rule FROM judged""",
        **_split_tables(), **_RECAL, **_RECAL_CLOSED, slices=_SLICES, **_RULES,
    )
)
def recommendation(spark, d):
    """What the diagnostics of the cell model say to do next, by the first rule that holds."""
    slices, gaps = metrics.ahead_behind(held_out(spark, d)), metrics.split_gap(predictions(spark, d))
    return r6(metrics.recommendation(slices, gaps, split_rows(spark, d), _recal_closure(spark, d), "RRR Markov"))


#: Cells of the raw deliveries spoilt for the audit below: in every match of the first kind a word for the runs, of the second no date.
_SPOILT_RUNS, _SPOILT_DATE = 37, 31
_NULLS = {"runs_total": f"match_id % {_SPOILT_RUNS} = 0", "date": f"match_id % {_SPOILT_DATE} = 0", "result_type": "result_type IS NULL", "method": "method IS NULL", "overs": "overs IS NULL"}


@kept
def spoilt_csv(spark: SparkSession, d: str) -> DataFrame:
    """A scan of the raw deliveries written as CSV with some cells spoilt."""
    rows = raw(spark, d)
    text = rows.select(*(F.col(c).cast("string").alias(c) for c in reversed(rows.columns)))
    text = text.withColumn("runs_total", F.when(F.col("match_id").cast("long") % _SPOILT_RUNS == 0, "many").otherwise(F.col("runs_total")))
    text = text.withColumn("date", F.when(F.col("match_id").cast("long") % _SPOILT_DATE == 0, "someday").otherwise(F.col("date")))
    path = shared_path(spark, "csv")
    text.write.option("header", True).csv(path)
    return deliveries.scan_csv(spark, path)


_LACKING = ", ".join(f"count(*) FILTER (bad AND {_NULLS.get(c, 'false')}) AS null_{c}" for c in (f.name for f in deliveries.RAW_SCHEMA))


@query(sql((
    f"SELECT count(*) AS n, count(*) FILTER (bad) AS rejected, {_LACKING} "
    f"FROM (SELECT *, {_NULLS['runs_total']} OR {_NULLS['date']} AS bad FROM raw_rows)"
), raw_rows=(
    "SELECT * EXCLUDE (result_type), coalesce(result_type, "
    "CASE WHEN max(team_runs) OVER (PARTITION BY match_id) = runs_target - 1 THEN 'tie' END) AS result_type FROM raw"
)))
def csv_audit(spark, d):
    """How many lines of a CSV a typed scan rejects, and which cells they lack."""
    return deliveries.rejected(spoilt_csv(spark, d))


@query(sql(f"SELECT split, count(*) AS n, {_round('avg(li) AS mean_li', 'avg(wp) AS mean_wp')}, count(DISTINCT match_id) AS matches FROM scored GROUP BY split"))
def scored_version(spark, d):
    """The ball table written as a version, and leverage and win probability appended as the next, which is read back."""
    root = shared_path(spark, "balls")
    versions.write_version(balls(spark, d), root, ("split",))
    added = scored(spark, d).select("match_id", "ball_index", "li", "wp")
    versions.append_columns(spark, root, lambda now: now.join(added, ["match_id", "ball_index"]), ("split",))
    now = versions.read_version(spark, root)
    return r6(now.groupBy("split").agg(F.count("*").alias("n"), F.avg("li").alias("mean_li"), F.avg("wp").alias("mean_wp"), F.count_distinct("match_id").alias("matches")))


@query(sql(
    "SELECT player, balls::INT AS balls, mean_li, rank::INT AS rank FROM top_table WHERE rank <= 20",
    top_table=_leverage_table("batter"),
))
def leaderboard_file(spark, d):
    """The first twenty batters, from the CSV file that the board was written to."""
    path = shared_path(spark, "board")
    reports.write_leaderboard(r6(players.player_leverage(scored(spark, d), "batter", LEAST_BALLS)), path)
    return spark.read.schema("player string, balls int, mean_li double, median_li double, median_pos double, death_share double, rank int").option("header", True).csv(path).select("player", "balls", "mean_li", "rank")


@query(sql("SELECT phase, round(avg(li), 4) AS mean_li, count(*) AS n FROM scored GROUP BY phase"))
def report_table(spark, d):
    """A table read back from the report in which it was written, behind its heading."""
    path = shared_path(spark, "report")
    table = leverage.leverage_by(scored(spark, d), "phase").select("phase", "mean_li", "n")
    text = f"# Report\n\n## Other\n\n| a |\n|---|\n| 1 |\n\n## Leverage by phase\n\n{reports.markdown(table)}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    rows = reports.read_markdown_table(spark, path, "Leverage by phase", 3)
    return rows.select(F.col("c0").alias("phase"), F.col("c1").cast("double").alias("mean_li"), F.col("c2").cast("long").alias("n"))


#: Parts of names: of one player, of several, of none.
_NAME_PARTS = ("P12", "p1", "x")


@query(sql(" UNION ALL ".join(
    f"SELECT '{part}' AS part, player, rank FROM lookup_table WHERE contains(lower(player), '{part.lower()}') QUALIFY count(*) OVER () = 1" for part in _NAME_PARTS
), lookup_table=_leverage_table("batter")))
def player_lookup(spark, d):
    """The one batter whose name holds a part, if there is one."""
    table = r6(players.player_leverage(scored(spark, d), "batter", LEAST_BALLS))
    return reduce(DataFrame.unionByName, (players.find_player(table, part).select(F.lit(part).alias("part"), "player", "rank") for part in _NAME_PARTS))


@kept
def simulated(spark: SparkSession, d: str) -> DataFrame:
    """Every mode at every seed; a seed drives the states sampled and the draws, as in the reference."""
    table = train(spark, d)
    grid = outcomes.full_grid(outcomes.with_recency(table, None))
    return simulate.simulate(simulate.seeded_states(table, SEEDS), table, grid, SEEDS)


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    exact = train(spark, d).groupBy(chase.slice_left_closed("rrr").alias("slice")).agg(F.avg(F.col("y").cast("double")).alias("win_rate"))
    return simulate.gaps(simulated(spark, d), exact)


@query()
def block_sim(spark, d):
    """Gap of each mode's simulated win rates, over the seeds."""
    return r6(simulate.over_seeds(_gaps(spark, d)))


@query()
def block_claims(spark, d):
    """What the gaps say about block lengths, over the seeds."""
    return r6(simulate.claims(_gaps(spark, d)))


@query()
def block_fidelity(spark, d):
    return r6(simulate.fidelity(simulated(spark, d)))
