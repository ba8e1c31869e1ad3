"""Dependence, resampling, simulation and streaming on made sequences."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chaseline.functions import chase
from chaseline.functions.draws import mixed, name_key, with_draw
from chaseline.operators import dependence, era, metrics, models, outcomes, players, resample, simulate
from chaseline.plans import queries
from chaseline.sources import deliveries, reports
from chaseline.streaming import live


def sequences(kind, groups=200, length=60, seed=3):
    dice = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        x = dice.normal(size=length)
        if kind == "effect":
            x = x + dice.normal() * 0.5
        if kind == "ar":
            for i in range(1, length):
                x[i] += 0.5 * x[i - 1]
        rows += [(g, i, 0, float(v)) for i, v in enumerate(x)]
    return pd.DataFrame(rows, columns=["match_id", "ball_index", "part", "runs"])


def lag1(spark, kind, variant):
    rows = dependence.lag_profile(spark.createDataFrame(sequences(kind))).filter(f"scope = 'innings' and lag = 1 and variant = '{variant}'")
    return rows.first()["r"]


def test_profiles_tell_effects_from_serial_dependence(spark):
    assert abs(lag1(spark, "iid", "state")) < 0.03
    assert lag1(spark, "effect", "state") > 0.15 and abs(lag1(spark, "effect", "state+innings")) < 0.05
    assert lag1(spark, "ar", "state+innings") > 0.4


def test_icc_of_a_random_effect(spark):
    got = dependence.icc(spark.createDataFrame(sequences("effect", 400)), "runs", ["match_id"]).first()["icc"]
    assert abs(got - 0.2) < 0.04


def test_bootstrap_of_a_constant_has_no_width_and_finds_a_shift(spark):
    same = spark.createDataFrame([("m", g, 0.25) for g in range(30) for _ in range(4)], "model string, match_id long, delta double")
    row = resample.loss_difference(same, ["model"], 50).first()
    assert (row.point, row.ci_lo, row.ci_hi, row.verdict) == (0.25, 0.25, 0.25, "worse")
    dice = np.random.default_rng(1)
    shift = spark.createDataFrame([("m", g, float(-1 + 0.1 * dice.normal())) for g in range(50)], "model string, match_id long, delta double")
    assert resample.loss_difference(shift, ["model"], 100).first().verdict == "yes"


def made_pool(codes):
    innings = [np.array(x) for x in codes]
    donors = pd.DataFrame([(i, k, 100 + 60 * i) for i, x in enumerate(innings) for k in range(len(x))], columns=["row", "ball", "cell"])
    return simulate.pool_of(innings, [np.full(len(x), 100 + 60 * i) for i, x in enumerate(innings)], donors, np.eye(8)[np.full(198, 1)])


def ends(pool, state, mode, block, sims=20):
    return simulate.continuations(pool, *(np.array([x]) for x in state), np.array([5]), mode, block, sims)


def test_simulation_of_certain_wickets_and_of_certain_sixes():
    for code, want in ((7, 0.0), (6, 1.0)):
        pool = made_pool([[code] * 2, [code] * 2])
        for mode in ("block", "scattered"):
            value, tally = ends(pool, (10, 2, 30), mode, 3)
            assert value[0] == want and tally.sum() == tally[0, code] == 20 * (2 if code == 7 else 5)
    assert ends(pool, (3, 1, 4), "model", 1)[0][0] == 0.5  # three singles: a tie
    assert ends(pool, (3, 1, 3), "model", 1)[0][0] == 1.0
    assert np.isnan(ends(simulate.pool_of([], [], pd.DataFrame({"row": [], "ball": [], "cell": []}, dtype=int), np.full((198, 8), 1 / 8)), (3, 1, 3), "block", 3)[0][0])


def test_blocks_equal_a_walk_ball_by_ball():
    dice = np.random.default_rng(4)
    for _ in range(200):
        b, w, r = int(dice.integers(1, 30)), int(dice.integers(1, 4)), int(dice.integers(1, 40))
        codes = dice.integers(0, 8, size=int(dice.integers(1, 40)))
        row = np.append(codes, [-1] * int(dice.integers(0, 3))).astype(np.int8)
        got = [x[0] for x in simulate.fold(*(np.array([x], dtype=np.int16) for x in (b, w, r)), row[None])]
        taken, value = 0, np.nan
        for code in codes:
            b, w, r, taken = b - 1, w - (code == 7), r - (code if code < 7 else 0), taken + 1
            if r <= 0 or w == 0 or b == 0:
                value = 1.0 if r <= 0 else 0.5 if w > 0 and r == 1 else 0.0
                break
        assert got[:3] == [b, w, r] and got[4].sum() == taken and (got[3] == value or np.isnan(value) and np.isnan(got[3]))


def test_donors_are_uniform_over_their_cell_and_balls_of_it():
    pool = made_pool([[0, 1, 2, 3], [4, 4]])
    row, ball = pool.donors(np.full(40000, 100), simulate.hashed(np.arange(40000), 1))
    assert (row == 0).all() and np.abs(np.bincount(ball) / 40000 - 0.25).max() < 0.01
    row, _ = pool.donors(np.full(10, 197), simulate.hashed(np.arange(10), 1))  # no ball: the nearest cell's
    assert (row == 1).all()


def test_gathered_pool_is_bounded_and_in_place(spark):
    balls = spark.createDataFrame([(m, i, "4" if i % 2 else "W", 120 - i, 10, 100, 6.0, "powerplay") for m in range(40) for i in range(20)], "match_id long, ball_index int, outcome string, b int, w int, r int, rrr double, phase string")
    grid = spark.createDataFrame([(0, [1.0] + [0.0] * 7)], "cell_id int, p array<double>")
    whole, some = (simulate.gather_pool(balls, grid, 0, most) for most in (10000, 50))
    assert len(whole.row) == 800 and len(some.row) == 50 and some.codes.shape[0] <= 40
    assert set(map(tuple, whole.codes[:, :20].tolist())) == {(7, 4) * 10}
    cell = (1 * 11 + 10) * 3
    assert (whole.starts[:, cell] == 0).all() and (whole.starts[:, cell + 1] == 20).all() and (whole.size == 800).all()


def test_live_credit(spark, tmp_path):
    rows = [(1, i, "x", wp, dt.datetime(2024, 1, 1, 0, i)) for i, wp in enumerate((0.5, 0.6, 0.4))]
    spark.createDataFrame(rows, "match_id long, ball_index int, batter string, wp double, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("match_id long, ball_index int, batter string, wp double, ts timestamp").parquet(str(tmp_path / "in"))
    run = live.credited_stream(stream).writeStream.format("memory").queryName("credit").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = sorted((r.ball_index, round(r.wpa, 6)) for r in spark.table("credit").collect())
    assert got == [(0, 0.1), (1, -0.2)]


def test_markdown_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "name string, x double")
    path = tmp_path / "r.md"
    path.write_text("# One\n\ntext\n\n## Two\n\n" + reports.markdown(table, 1) + "\n## Three\n\n| z |\n|---|\n| 9 |\n")
    got = reports.read_markdown_table(spark, str(path), "Two", 2).orderBy("row").collect()
    assert [(r.c0, r.c1) for r in got] == [("a", "1.5"), ("b", "2.0")]


def test_queries_have_the_sizes_of_the_reference():
    assert (queries.REPLICATES, queries.PLAYER_REPLICATES, queries.PERMUTATIONS, queries.LEAST_BALLS, queries.SEEDS) == (1000, 2000, 200, 500, 6)
    assert (simulate.STATES, simulate.SIMS) == (220, 400)


def test_shuffles_equal_a_plain_version(spark):
    """Runs and wickets move together, within innings; the profile of each replicate equals that of plain rows."""
    table = sequences("iid", 6, 40)
    table["part"], table["wkt"] = table["ball_index"] // 15, table["runs"] * 2
    got = {(r.series, r.rep, r.variant, r.scope, r.lag): r.r for r in dependence.null_profiles(spark.createDataFrame(table), 3).collect()}
    for rep in range(3):
        moved = []
        for match, own in table.groupby("match_id"):
            keys = [int(mixed(mixed(mixed(0, match), rep), k)) for k in own["ball_index"]]
            moved.append(own.assign(runs=own["runs"].to_numpy()[np.lexsort((own["ball_index"], keys))]))
        for row in dependence.lag_profile(spark.createDataFrame(pd.concat(moved))).collect():
            want = got["runs", rep, row.variant, row.scope, row.lag]
            assert (row.r is None and want is None) or abs(row.r - want) < 1e-9
            assert got["wkt", rep, row.variant, row.scope, row.lag] == want or abs(got["wkt", rep, row.variant, row.scope, row.lag] - want) < 1e-9


def test_draws_are_even_and_the_same_in_every_engine(spark):
    rows = spark.range(20000).withColumn("m", F.lit(10).cast("long"))
    got = [r.k for r in with_draw(rows, "k", F.col("m"), F.lit(3), F.col("id")).orderBy("id").collect()]
    assert got == (mixed(mixed(0, 3), np.arange(20000)) % 10).tolist()
    assert np.abs(np.bincount(got) / 20000 - 0.1).max() < 0.01


def test_large_groups_are_drawn_from_by_a_join_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(g, m, float(m * m % 7)) for g in ("a", "b") for m in range(40)], "g string, match_id long, s double")
    show = lambda: sorted((r.g, r.rep, r.s) for r in resample.replicates(rows, ["g"], ["s"], 7).collect())
    whole = show()
    monkeypatch.setattr(resample, "MOST_IN_ARRAY", 10)
    assert show() == whole and len(whole) == 14


def test_slots_of_a_bootstrap_are_counted_in_tasks(spark, monkeypatch):
    """As rows, the slots of large groups were taken for a small table and sent to the driver."""
    values = [None if m == 3 else float(m % 11) for m in range(300)]
    rows = spark.createDataFrame([("a", m, v, m) for m, v in enumerate(values)] + [("b", 0, None, 1)], "g string, match_id long, s double, c long")
    key = rows.select("g", name_key("g").alias("key")).filter("g = 'a'").first().key
    for most in (1000, 70):
        monkeypatch.setattr(resample, "MOST_IN_ARRAY", most)
        boot = resample.replicates(rows, ["g"], ["s", "c"], 9)
        assert "slot" not in boot._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.g, r.rep): (r.s, r.c) for r in boot.collect()}
        for rep in range(9):
            drawn = mixed(mixed(mixed(mixed(0, 0), key), rep), np.arange(300)) % 300
            assert got["a", rep] == (sum(values[k] or 0.0 for k in drawn), drawn.sum()) and got["b", rep] == (None, 1)


def test_player_sums_are_found_once_for_both_sides(spark, sf, monkeypatch):
    """Replicates and points of both sides come from one plan of the credited balls; there were three, each run for both sides."""
    passes, per_ball = [], queries.wpa.per_ball
    monkeypatch.setattr(queries.wpa, "per_ball", lambda rows: passes.append(1) or per_ball(rows))
    monkeypatch.setattr(queries, "_KEPT", {})
    monkeypatch.setattr(queries, "LEAST_BALLS", 60)
    monkeypatch.setattr(queries, "PLAYER_REPLICATES", 20)
    got = {r.side: r for r in queries.QUERIES["significance_counts"](spark, sf).collect()}
    assert len(passes) == 1 and set(got) == {"batter", "bowler"}
    credited = per_ball(queries.scored(spark, sf))
    both = queries.player_sums(spark, sf)
    for who, side in queries._SIDES.items():
        want = {r.player: r for r in credited.groupBy(F.col(who).alias("player")).agg(F.count("*").alias("n"), F.sum(f"wpa_{side}_dd").alias("dd"), F.avg("li").alias("li")).filter("n >= 60").collect()}
        points = {r.player: r for r in resample.points_of(both).filter(F.col("side") == who).collect()}
        assert points.keys() == want.keys() and got[who].splits <= len(points)
        assert all(r.balls == want[p].n and abs(r.total - want[p].dd) < 1e-9 and abs(r.li - want[p].li) < 1e-9 for p, r in points.items())


def test_a_match_drawn_more_often_than_a_byte_holds(monkeypatch):
    def same(state, part, out, spare):
        out[:] = 7
        return out

    monkeypatch.setattr(resample, "mixed32", same)
    for low, held in ((0, 1000), (5, 10)):
        counts = resample._counts(np.array([1, 2], dtype=np.uint32), 1000, low, held)
        assert counts.sum(axis=1).tolist() == [1000, 1000] and counts[:, 7 - low].tolist() == [1000, 1000]


def test_more_order_lines_are_dealt_to_more_tasks(spark, sf, monkeypatch):
    """A task that sorts the lines has at most so many of them, whatever the session's number of shuffle partitions."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    whole = deliveries.from_order_lines(lines)
    monkeypatch.setattr(deliveries, "ROWS_A_TASK", 100)
    dealt = deliveries.from_order_lines(lines)
    assert dealt.rdd.getNumPartitions() == -(-lines.count() // 100)
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_donor_innings_come_to_the_driver_as_bytes(spark):
    rows = spark.createDataFrame([(m, k, (m + k) % 8, 197 - k) for m in (1, 2) for k in reversed(range(120))], "match_id long, ball_index int, code int, cell int")
    got = {r.match_id: r for r in simulate.packed_innings(rows).collect()}
    for m in (1, 2):
        assert list(got[m].ball_index) == list(range(120)) and list(got[m].code) == [(m + k) % 8 for k in range(120)] and list(got[m].cell) == [197 - k for k in range(120)]


def test_running_sums_across_ranges(spark):
    rows = spark.createDataFrame([(k % 3, k, k % 5) for k in range(500)], "g int, k int, v int")
    got = {(r.g, r.k): r.before for r in resample.before(rows, ["g"], ["k"], F.col("v")).collect()}
    sums = [0, 0, 0]
    for k in range(500):
        assert got[k % 3, k] == sums[k % 3]
        sums[k % 3] += k % 5


def test_players_apart_and_alike(spark):
    """Two players whose credit differs clearly are told apart; span, anchor and counts say so."""
    dice = np.random.default_rng(2)
    rows = [(m, p, float(1 + (p == "a") + 0.1 * dice.normal()), float((p == "a") + 0.1 * dice.normal())) for m in range(30) for p in ("a", "b", None) for _ in range(10)]
    credited = spark.createDataFrame(rows, "match_id long, batter string, li double, wpa_bat_dd double")
    boot, points = resample.player_replicates(credited, "batter", "bat", 50, 100).cache(), resample.player_points(credited, "batter", "bat", 100)
    near = resample.adjacent_differences(boot, points, "li").unionByName(resample.adjacent_differences(boot, points, "total"))
    assert [(r.rank, r.player, r.other, r.separated) for r in near.collect()] == [(1, "a", "b", True)] * 2
    assert {(r.kind, r.player, r.other) for r in resample.span_differences(boot, points, "li").collect()} == {("span", "a", "b"), ("anchor", "a", "b")}
    row = resample.significance_counts(resample.player_intervals(boot), points, near).first()
    assert (row.splits, row.totals_significant, row.separated_li, row.separated_total) == (1, 1, 1, 1)  # b has no high-leverage balls


def test_gate_and_closure(spark):
    table = spark.createDataFrame([("m", 0.2, 0.5, 0.6, 0.5), ("low", 0.1, 0.3, 0.5, 0.5), ("mid", 0.15, 0.4, 0.55, 0.5), ("bad", 0.3, 0.4, 0.5, 0.5)], "model string, brier double, log_loss double, mean_pred double, actual double")
    got = {(r.reference, r.metric): r.better for r in metrics.gate(table, "m", ["low", "bad"]).collect()}
    assert got == {("low", "brier"): False, ("low", "log_loss"): False, ("bad", "brier"): True, ("bad", "log_loss"): False}
    row = metrics.closure(table, "m", ["mid"], "low").first()
    assert abs(row.closed - 0.5) < 1e-9 and abs(row.level_closed - 0.5) < 1e-9


def test_splits_and_models_by_name(spark):
    balls = spark.createDataFrame([(m, str(2000 + m % 3)) for m in range(50) for _ in range(2)], "match_id long, season string")
    assert {r.season for r in models.with_season_out(balls, "2001").filter("split = 'holdout'").collect()} == {"2001"}
    folds = models.with_fold_out(balls).groupBy("match_id").agg(F.count_distinct("split").alias("n"))
    assert folds.filter("n > 1").count() == 0 and 0 < models.with_fold_out(balls).filter("split = 'holdout'").count() < 40
    with pytest.raises(ValueError, match="unknown model"):
        outcomes.grid_of("other", balls)


def test_half_life_walk_and_fallback(spark):
    show = lambda rows: era.chosen_half_life(spark.createDataFrame(rows, "half_life double, log_loss double, ess double")).first()[0]
    assert show([(0.0, 0.5, 1.0), (8.0, 0.4, 0.9), (4.0, 0.45, 0.6), (1.0, 0.3, 0.1), (2.0, 0.39, 0.3)]) == 2.0
    assert show([(0.0, 0.5, 1.0), (8.0, 0.6, 0.9)]) == 0.0
    assert era.HALF_LIVES == [0, 8.0, 6.0, 4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5]


def test_tables_and_reports_are_written(spark, tmp_path):
    balls = spark.createDataFrame([(1, "train"), (2, "holdout")], "match_id long, split string")
    reports.write_ball_table(balls, str(tmp_path / "balls"))
    assert spark.read.parquet(str(tmp_path / "balls")).filter("split = 'train'").count() == 1
    board = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "player string, rank int")
    reports.write_leaderboard(board, str(tmp_path / "top"), 2)
    assert [r.player for r in spark.read.option("header", True).csv(str(tmp_path / "top")).collect()] == ["a", "b"]
    labels = spark.createDataFrame([("block_20", "6..8.5"), ("other", "10..12")], "label string, range string")
    low, high = reports.bounds("range")
    assert [tuple(r) for r in labels.select(reports.block_length("label"), low, high).collect()] == [(20, 6.0, 8.5), (None, 10.0, 12.0)]
    found = players.find_player(spark.createDataFrame([("Ann B",), ("Bob",), ("bobby",)], "player string"), "ANN").collect()
    assert [r.player for r in found] == ["Ann B"] and players.find_player(spark.createDataFrame([("Bob",), ("bobby",)], "player string"), "bob").count() == 0


def test_csv_is_read_with_declared_types(spark, tmp_path):
    names = [f.name for f in deliveries.RAW_SCHEMA]
    path = tmp_path / "raw.csv"
    values = {"match_id": "7", "date": "2020-01-02", "season": "2019/20", "method": "", "overs": ""}
    path.write_text(",".join(["extra", *reversed(names)]) + "\n" + ",".join(["z", *(values.get(n, "1") for n in reversed(names))]) + "\n")
    row = deliveries.read_csv(spark, str(path)).first()
    assert (row.match_id, row.date, row.season, row.method, row.overs) == (7, dt.date(2020, 1, 2), "2019/20", None, None)
    path.write_text("match_id\n1\n")
    with pytest.raises(ValueError, match="missing columns: bat_pos"):
        deliveries.read_csv(spark, str(path))


def test_boosting_stops_before_its_limit(spark):
    dice = np.random.default_rng(1)
    rows = [(k, 0, float(x), int(dice.random() < 0.5), str(2000 + k % 3)) for k, x in enumerate(dice.random(300))]
    table = spark.createDataFrame(rows, "match_id long, ball_index int, x double, y int, season string")
    scored, report = models.boosted(table, table, {"m": ["x"]}, patience=5)
    assert scored.filter("p between 0 and 1").count() == 300 and report.first().rounds < 100


def test_live_windows(spark, tmp_path):
    spark.createDataFrame([(1, 4, dt.datetime(2024, 1, 1, 0, 1)), (1, 2, dt.datetime(2024, 1, 1, 0, 2)), (1, 1, dt.datetime(2024, 1, 1, 0, 20))], "match_id long, runs int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("match_id long, runs int, ts timestamp").parquet(str(tmp_path / "in"))
    run = live.runs_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.runs, r.balls) for r in spark.table("windows").collect()) == [(1, 1), (6, 2)]


def test_next_state(spark):
    rows = spark.createDataFrame([(10, 5, 20, "W"), (10, 5, 20, "4")], "b int, w int, r int, outcome string")
    assert [tuple(r) for r in rows.select(*(c.alias(n) for n, c in chase.transition("outcome").items())).collect()] == [(9, 4, 20), (9, 5, 16)]


def test_claims_about_block_lengths(spark):
    gaps = {("block", 1): [0.5, 0.6], ("block", 20): [0.2, 0.3], ("block", 40): [0.3, 0.2], ("scattered", 20): [0.4, 0.5]}
    rows = [(seed, mode, block, gap) for (mode, block), own in gaps.items() for seed, gap in enumerate(own)]
    row = simulate.claims(spark.createDataFrame(rows, "seed int, mode string, block int, mean_gap double")).first()
    assert (row.best_block, row.seeds, row.seeds_in_order, row.separated, row.resolved) == (20, 2, 1, True, False)
    assert abs(row.closed - 6 / 11) < 1e-9 and abs(row.scattered_share - 1 / 3) < 1e-9


def test_each_seed_samples_states_of_its_own(spark):
    balls = spark.createDataFrame([(m, i, 120 - i, 10, 100, 6.0 + m % 3) for m in range(40) for i in range(20)], "match_id long, ball_index int, b int, w int, r int, rrr double")
    got = {}
    for r in simulate.seeded_states(balls, 2, 5).collect():
        got.setdefault(r.seed, set()).add((r.match_id, r.ball_index))
    assert set(got) == {0, 1} and got[0] != got[1]


def test_permutation_null_reads_the_innings_once(spark, monkeypatch):
    """The observed profile comes from the pass that shuffles, not from scans of its own, and is that of ``lag_profile``."""
    rows = spark.createDataFrame(pd.DataFrame([{"match_id": m, "ball_index": i, "part": i // 9, "runs": float((m * 7 + i * i) % 5), "wkt": float((m + i) % 3 == 0)} for m in range(6) for i in range(40 + m)]))
    want = {(v, r.variant, r.scope, r.lag): (r.r, r.n) for v in dependence.SERIES for r in dependence.lag_profile(rows, v).collect()}
    monkeypatch.setattr(dependence, "lag_profile", None)
    got = {(r.series, r.variant, r.scope, r.lag): (r.r, r.n) for r in dependence.permutation_null(rows, 2).collect()}
    assert got.keys() == want.keys()
    for key, (r, n) in want.items():
        assert got[key][1] == n and (r == got[key][0] or abs(r - got[key][0]) < 1e-9), key
