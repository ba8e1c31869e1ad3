"""States, ingest traps and the exact dynamic programme on literal frames."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chaseline.functions import chase
from chaseline.operators import ingest, leverage, outcomes, winprob
from chaseline.sources.deliveries import RAW_SCHEMA, require_columns

#: Hand-made distributions over 0..6, W.
HAND = [0.31, 0.39, 0.065, 0.005, 0.12, 0.001, 0.058, 0.051]
COIN = [0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5]


def grid(spark, p):
    cells = [(chase.RRR_BINS * 0 + (rb * 11 + w) * 3 + ph, p) for rb in range(6) for w in range(1, 11) for ph in range(3)]
    return spark.createDataFrame(cells, "cell_id int, p array<double>")


def ball(match=1, seq=0, **more):
    base = dict(match_id=match, seq=seq, innings=2, over=0, date=dt.date(2020, 1, 1), season="2020", batting_team="A", bowling_team="B", valid_ball=1, runs_total=1, team_runs=seq + 1, team_balls=seq + 1, team_wicket=0, runs_target=50, match_won_by="A", result_type=None, method=None, overs=20, batter_balls=1, batter="x", bowler="y", bat_pos=1)
    return Row(**base | more)


def raw(spark, rows):
    return spark.createDataFrame([[r[f] for f in RAW_SCHEMA.names] for r in rows], RAW_SCHEMA)


def test_terminal_table(spark):
    rows = [(10, 5, 0, 1.0), (10, 5, -3, 1.0), (10, 0, 20, 0.0), (0, 5, 5, 0.0), (0, 5, 1, 0.5), (10, 5, 20, None)]
    df = spark.createDataFrame(rows, "b int, w int, r int, want double")
    assert df.filter(~chase.terminal("b", "w", "r").eqNullSafe(F.col("want"))).count() == 0


def test_surface_is_consistent_and_monotone(spark):
    wp = {(x.b, x.w, x.r): x.wp for x in winprob.solve(grid(spark, HAND), 60).filter("b <= 40").collect()}
    for b, w, r in [(1, 1, 1), (17, 3, 20), (40, 10, 55), (30, 7, 1)]:
        want = 0.0
        for k, p in enumerate(HAND):
            nb, nw, nr = b - 1, w - (k == 7), r - (0 if k == 7 else k)
            end = 1.0 if nr <= 0 else 0.0 if nw == 0 else (0.5 if nr == 1 else 0.0) if nb == 0 else None
            want += p * (wp[nb, nw, nr] if end is None else end)
        assert abs(wp[b, w, r] - want) < 1e-12
    assert all(wp[20, 5, r] >= wp[20, 5, r + 1] - 1e-12 for r in range(1, 59))
    assert all(wp[20, w, 30] <= wp[20, w + 1, 30] + 1e-12 for w in range(1, 10))


def test_swing_closed_form(spark):
    g = grid(spark, COIN)
    surface = winprob.solve(g, 5)
    state = surface.filter("b = 1 and w = 1 and r = 1").crossJoin(g.limit(1).select("p"))
    assert abs(leverage.swings(state, surface).first()["swing"] - 0.5) < 1e-12


def test_missing_overs_drop_the_match_and_null_reasons_do_not(spark):
    rows = [ball(1), ball(2, overs=None), ball(3, method="D/L"), ball(4, result_type="no result"), ball(5, innings=1, method="D/L"), ball(5)]
    kept = {r.match_id for r in ingest.ball_table(raw(spark, rows)).collect()}
    assert kept == {1, 5}
    audit = ingest.drop_audit(raw(spark, rows)).first()
    assert (audit.dls, audit.no_result, audit.non_standard, audit.dropped, audit.matches_total) == (1, 1, 1, 3, 5)


def test_extras_go_to_the_next_legal_ball(spark):
    rows = [ball(1, 0, runs_total=5, valid_ball=0, team_runs=5, team_balls=0), ball(1, 1, runs_total=4, team_runs=9, team_balls=1), ball(1, 2, runs_total=2, valid_ball=0, team_runs=11, team_balls=1)]
    out = ingest.ball_table(raw(spark, rows)).collect()
    assert [(r.outcome, r.r, r.b, r.w) for r in out] == [("6", 45, 120, 10)]
    audit = ingest.extras_audit(raw(spark, rows)).first()
    assert (audit.runs_folded_in, audit.runs_dropped_trailing, audit.balls_capped) == (5, 2, 1)


def test_unknown_winner_counts_as_lost_and_wickets_come_from_deltas(spark):
    rows = [ball(1, 0, match_won_by=None), ball(1, 1, match_won_by=None, team_wicket=1)]
    out = ingest.ball_table(raw(spark, rows)).orderBy("ball_index").collect()
    assert [(r.y, r.outcome, r.w) for r in out] == [(0, "1", 10), (0, "W", 10)]
    with pytest.raises(Exception, match="team_wicket"):
        ingest.ball_table(raw(spark, [ball(1, 0, team_wicket=2)])).collect()


def test_missing_columns_are_named():
    class Frame:
        columns = ["a"]

    with pytest.raises(ValueError, match="b, c"):
        require_columns(Frame(), ["a", "b", "c"])


def test_slices_differ_at_edges(spark):
    df = spark.createDataFrame([(6.0,), (40.0,), (41.0,)], "x double")
    got = df.select(chase.slice_right_closed("x").alias("r"), chase.slice_left_closed("x").alias("l")).collect()
    assert [(g.r, g.l) for g in got] == [(0, 1), (8, 8), (None, 8)]


def test_grid_rows_sum_to_one_and_unit_weights_change_nothing(spark):
    rows = [("s1", dt.date(2020, 1, 1), o, 7.0, "middle", 5) for o in "0011246W"] + [("s2", dt.date(2021, 1, 1), "1", 7.0, "middle", 5)] * 4
    train = spark.createDataFrame(rows, "season string, date date, outcome string, rrr double, phase string, w int")
    g = outcomes.full_grid(outcomes.with_recency(train, None))
    assert g.count() == 180
    assert g.filter(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    weights = {r.season: r.w for r in outcomes.with_recency(train, 1.0).groupBy("season").agg(F.first("weight").alias("w")).collect()}
    assert abs(weights["s2"] / weights["s1"] - 2) < 1e-9
    assert abs((8 * weights["s1"] + 4 * weights["s2"]) / 12 - 1) < 1e-9
