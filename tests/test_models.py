"""Fitted models, folds, guarded lookups, versions of tables and typed scans, against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chaseline.operators import boosting, era, metrics, models, outcomes, players, winprob
from chaseline.plans.queries import ORACLES
from chaseline.sources import deliveries, versions
from chaseline.streaming import live


def labelled(seed, n, weights=(1.5, -1.0, 0.0)):
    dice = np.random.default_rng(seed)
    x = dice.normal(size=(n, len(weights))).round(2)
    y = (dice.random(n) < 1 / (1 + np.exp(-x @ np.array(weights)))).astype(int)
    return x, y


def plain_boosting(x, y, held, key, columns, rounds, patience, m=0):
    """Trees by a scan of every node, feature and bin, on bin numbers ``x``."""
    mean = y[~held].mean()
    margin = np.full(len(y), np.log(mean / (1 - mean)))
    losses, best = [], margin
    for t in range(rounds):
        dice = np.random.default_rng([boosting.SEED, m, t])
        picked = sorted(columns[k] for k in dice.permutation(len(columns))[: max(1, int(boosting.FEATURE_SHARE * len(columns)))])
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * boosting.UNIT) / boosting.UNIT, np.rint(p * (1 - p) * boosting.UNIT) / boosting.UNIT
        use = ~held & boosting._drawn(key, m, t)

        def grow(rows, depth):
            total_g, total_h = g[rows & use].sum(), h[rows & use].sum()
            leaf = -boosting.STEP * total_g / (total_h + boosting.SHRINK)
            found = (1e-6, None)
            for f in picked if depth < boosting.DEPTH else []:
                for b in range(boosting.BINS - 1):
                    left = rows & use & (x[:, f] <= b)
                    lg, lh = g[left].sum(), h[left].sum()
                    if min(lh, total_h - lh) >= boosting.LEAST_CURVATURE:
                        gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                        if gain > found[0] + 1e-12:
                            found = (gain, (f, b))
            if found[1] is None:
                margin[rows] += leaf
                return
            f, b = found[1]
            grow(rows & (x[:, f] <= b), depth + 1)
            grow(rows & (x[:, f] > b), depth + 1)

        grow(np.ones(len(y), bool), 0)
        losses.append(boosting._loss(margin, y)[held].mean())
        if losses[-1] <= min(losses):
            best = margin.copy()
        if t - int(np.argmin(losses)) >= patience:
            break
    return 1 / (1 + np.exp(-best)), losses


def test_boosting_equals_a_plain_version(spark):
    x, y = labelled(3, 700)
    x = np.floor(x * 3)
    rows = [(k, *map(float, v), int(t), bool(k % 4 == 0)) for k, (v, t) in enumerate(zip(x, y))]
    table = spark.createDataFrame(rows, "k long, a double, b double, c double, y int, held boolean").repartition(3)
    names = ["a", "b", "c"]
    bounds = boosting.edges(table.filter("not held"), names)
    fitted = boosting.fit(table, names, [names, ["a"]], bounds, ["k"], rounds=8, patience=5)
    key = np.array([r[0] for r in table.select(F.xxhash64("k"), "k").orderBy("k").select("xxhash64(k)").collect()])
    codes = np.stack([np.searchsorted(bounds[i], x[:, i], side="left") for i in range(3)], axis=1)
    held = np.array([r[-1] for r in rows])
    for m, columns in enumerate(([0, 1, 2], [0])):
        want, losses = plain_boosting(codes, y, held, key, columns, 8, 5, m)
        got = boosting.predict(table, names, {"m": fitted[m]}, bounds, ["k"]).orderBy("k").collect()
        assert np.allclose([r.p for r in got], want, atol=1e-6)
        assert np.allclose(fitted[m].held_losses, losses, atol=1e-6)


def shifted(spark):
    """The season held apart differs in one feature, so its loss falls, pauses and falls again."""
    dice = np.random.default_rng(11)
    rows = []
    for k in range(1500):
        a, b = (int(v) for v in dice.integers(0, 12, 2))
        last = k % 3 == 0
        p = 1 / (1 + math.exp(-(0.5 * (a - 6) + 0.25 * (b - 6) * (0.2 if last else 1))))
        rows.append((k, k, "2001" if last else "2000", float(a), float(b), int(dice.random() < p)))
    return spark.createDataFrame(rows, "match_id long, ball_index long, season string, a double, b double, y int")


def test_a_wait_of_fifty_rounds_beats_the_first_pause(spark):
    table = shifted(spark)
    best = {patience: models.boosted(table, table, {"m": ["a", "b"]}, rounds=75, patience=patience)[1].first() for patience in (1, 50)}
    assert best[1].rounds < best[50].rounds
    assert best[50].valid_log_loss < best[1].valid_log_loss - 1e-6
    assert best[50].rounds in (75, best[50].best_round + 51)


def test_levels_read_what_a_round_found_once():
    """Margins, gradients and drawn rows are found at a round's start; a level's sums come from those alone."""
    dice = np.random.default_rng(5)
    x, y, held, key = dice.integers(0, 5, (1000, 2)).astype(np.uint8), dice.integers(0, 2, 1000).astype(float), dice.random(1000) < 0.2, dice.integers(0, 1 << 40, 1000)
    old, tree = boosting._stump(), boosting._stump()
    old.feature[0], old.bin[0], old.value[1], old.value[2] = 0, 2, -0.3, 0.4
    tree.feature[0], tree.bin[0] = 1, 1
    block = boosting.Block(key, y, held, x, np.full((1000, 1), 0.1), np.zeros((1000, 1)))
    started = list(boosting._started({0: old}, False, [0], 3)([block]))
    (sums,) = boosting._level({0: (tree, [0, 1])}, 1, [5, 5])(boosting._slim(started))
    margin = 0.1 + np.where(x[:, 0] > 2, 0.4, -0.3)
    p, use = 1 / (1 + np.exp(-margin)), ~held & boosting._drawn(key, 0, 3)
    for got, v in zip(sums[0, 1], (p - y, p * (1 - p)), strict=True):
        want = [np.rint(v[use & ((x[:, 1] > 1) == node) & (x[:, f] == b)] * boosting.UNIT).sum() for node in (0, 1) for f in (0, 1) for b in range(5)]
        assert got.tolist() == want


def test_a_round_of_few_combinations_is_one_job(spark):
    """Sums by combination of bins hold what all levels need; a job a level took five a round."""
    x, y = labelled(7, 600)
    table = spark.createDataFrame([(k, *map(float, np.floor(v * 2)), int(t), k % 4 == 0) for k, (v, t) in enumerate(zip(x, y))], "k long, a double, b double, c double, y int, held boolean")
    bounds = boosting.edges(table.filter("not held"), ["a", "b", "c"])
    spark.sparkContext.setJobGroup("one job a round", "")
    fitted = boosting.fit(table, ["a", "b", "c"], [["a", "b", "c"]], bounds, ["k"], rounds=19, patience=50)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one job a round"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(fitted[0].trees) == 19 and any(t.feature[3] >= 0 or t.feature[4] >= 0 for t in fitted[0].trees)
    assert jobs < 2 * 19


def test_trees_of_combinations_and_of_levels_are_equal(spark, monkeypatch):
    """Both ways, over one and several tasks and blocks, and with more rows of one cell than a block holds."""
    rows = [(k, float(k * k % 7), float(k % 5 if k % 2 else 0), int((k * k % 7 > 2) ^ (k % 11 == 0)), k % 6 == 0) for k in range(3000)]
    table = spark.createDataFrame(rows, "k long, a double, b double, y int, held boolean")
    bounds = boosting.edges(table.filter("not held"), ["a", "b"])
    fit = lambda: [(t.feature.tolist(), t.bin.tolist(), t.value.tolist()) for m in boosting.fit(table, ["a", "b"], [["a", "b"], ["b"]], bounds, ["k"], rounds=12) for t in m.trees]
    want = fit()
    monkeypatch.setattr(boosting, "MOST_JOINT", 0)
    assert fit() == want
    monkeypatch.setattr(boosting, "ROWS_A_TASK", 500)
    assert fit() == want


def test_equal_rows_are_one_cell():
    batch = pa.RecordBatch.from_pydict({"key": [5, 6, 7, 8], "y": [1, 0, 1, 1], "held": [False, False, False, True], "x": [b"ab", b"ab", b"ab", b"ab"]})
    (row,) = next(boosting._blocks(2)(iter([batch.slice(0, 3), batch.slice(3)]))).to_pylist()
    (block,) = boosting._first_blocks(2, 0.5, 1)([row])
    assert block.y.tolist() == [0, 1, 1] and block.held.tolist() == [False, False, True] and block.begins.tolist() == [0, 1, 3, 4]
    assert block.key.tolist() == [6, 5, 7, 8] and block.x.tolist() == [[97, 98]] * 3 and (block.margins == 0.5).all()


def test_boosting_of_odd_tables(spark):
    schema = "match_id long, ball_index long, season string, a double, y int"
    same = spark.createDataFrame([(k, k, "s", 1.0, k % 2) for k in range(20)], schema)
    assert {round(r.p, 6) for r in models.boosted(same, same, {"m": ["a"]}, rounds=3)[0].collect()} == {0.5}
    gaps = spark.createDataFrame([(k, k, f"s{k % 2}", None if k % 5 == 0 else float(k % 7), int(k % 5 == 0)) for k in range(3000)], schema)
    scored = models.boosted(gaps, gaps, {"m": ["a"]}, rounds=8, patience=8)[0].collect()
    assert len(scored) == 3000 and min(r.p for r in scored if r.y == 1) > max(r.p for r in scored if r.y == 0)  # nulls have a bin of their own


def newton(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), np.array([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * beta)
    return beta


def test_logistic_equals_newtons_method(spark):
    x, y = labelled(1, 400)
    table = spark.createDataFrame([(*map(float, v), int(t)) for v, t in zip(x, y)], "a double, b double, c double, y int")
    terms = [F.col(c) for c in "abc"]
    assert np.allclose(models.logistic_weights(table, terms), newton(x, y), atol=1e-8)
    got = [r.p for r in models.logistic(table, table, ["a", "b", "c"], standardize=True).collect()]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = 1 / (1 + np.exp(-np.column_stack([np.ones(len(z)), z]) @ newton(z, y)))
    assert np.allclose(sorted(got), sorted(want), atol=1e-7)


def test_logistic_of_separable_constant_and_no_rows(spark):
    schema = "a double, y int"
    apart = spark.createDataFrame([(float(k), int(k >= 50)) for k in range(100)], schema)
    beta = models.logistic_weights(apart, [F.col("a")])
    assert np.isfinite(beta).all() and 0 < beta[1] < 10
    flat = spark.createDataFrame([(2.0, k % 2) for k in range(10)], schema)
    assert [round(r.p, 6) for r in models.logistic(flat, flat, ["a"], standardize=True).limit(1).collect()] == [0.5]
    assert models.logistic_weights(apart.limit(0), [F.col("a")]).tolist() == [0.0, 0.0]
    for label, p in ((1, 1.0), (0, 0.0)):
        one = apart.withColumn("y", F.lit(label))
        assert [round(r.p, 9) for r in models.logistic(one, one, ["a"]).select("p").distinct().collect()] == [p]


def pooled(points):
    """Pool adjacent violators as a stack fold over sorted distinct predictions: (first x, last x, mean) of each block."""
    sums = {}
    for x, y in points:
        s, n = sums.get(x, (0, 0))
        sums[x] = (s + y, n + 1)
    stack = []
    for x in sorted(sums):
        stack.append([x, x, *sums[x]])
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            _, last, s, n = stack.pop()
            stack[-1][1:] = [last, stack[-1][2] + s, stack[-1][3] + n]
    return [(a, b, s / n) for a, b, s, n in stack]


def test_isotonic_equals_a_stack_fold_on_ties_and_plateaus(spark):
    dice = random.Random(2)
    points = [(round(dice.random(), 1 if k % 2 else 3), int(dice.random() < 0.5)) for k in range(300)] + [(0.5, 1)] * 20 + [(0.25, 0)] * 20
    table = spark.createDataFrame([(x, y) for x, y in points], "wp double, y int")
    at = [0.0, 0.05, 0.25, 0.26, 0.5, 0.77, 1.0] + [x for x, _ in points[:50]]
    blocks = pooled(points)
    xs, vs = [x for a, b, _ in blocks for x in (a, b)], [v for *_, v in blocks for _ in (0, 1)]
    want = np.interp(at, xs, vs)
    got = {r.wp: r.p for r in models.isotonic(table, spark.createDataFrame([(x,) for x in at], "wp double")).collect()}
    assert np.allclose([got[x] for x in at], want, atol=1e-9)


def greedy(sizes, folds):
    loads, out = [0] * folds, {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fold = min(range(folds), key=lambda f: (loads[f], f))
        loads[fold] += size
        out[name] = fold
    return out, loads


@pytest.mark.parametrize("seed,folds", [(0, 5), (1, 2), (2, 7), (3, 1), (4, 5)])
def test_folds_equal_a_greedy_deal_and_are_balanced(spark, seed, folds):
    dice = random.Random(seed)
    sizes = {k: dice.choice((1, 2, 3, 40, dice.randint(1, 60))) for k in range(dice.randint(1, 90))}
    rows = [(k, j) for k, n in sizes.items() for j in range(n)]
    got = models.grouped_fold(spark.createDataFrame(rows, "match_id long, j long"), folds).collect()
    want, loads = greedy(sizes, folds)
    assert {(r.match_id, r.fold) for r in got} == set(want.items()) and len(got) == len(rows)
    assert max(loads) - min(loads) <= max(sizes.values())


def test_folds_of_many_equal_groups_of_null_groups_and_of_none(spark):
    schema = "match_id long, j long"
    even = models.grouped_fold(spark.createDataFrame([(k, 0) for k in range(1003)], schema)).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in even) == [200, 200, 201, 201, 201]
    with_null = models.grouped_fold(spark.createDataFrame([(None, 0), (None, 1), (1, 0)], schema)).collect()
    assert len(with_null) == 3 and {r.fold for r in with_null if r.match_id is None} == {0}
    assert models.grouped_fold(spark.createDataFrame([], schema)).count() == 0


def test_states_are_looked_up_ended_live_and_beyond(spark):
    surface = spark.createDataFrame([(10, 5, 20, 0.25)], "b int, w int, r int, wp double")
    schema = "b int, w int, r int"
    rows = [(10, 5, 20), (10, 5, 0), (10, 5, -3), (10, 0, 20), (0, 5, 5), (0, 5, 1), (None, 5, 20)]
    got = {(r.b, r.w, r.r): r.wp for r in winprob.with_wp(spark.createDataFrame(rows, schema), surface).collect()}
    assert got == dict(zip(rows, [0.25, 1.0, 1.0, 0.0, 0.0, 0.5, None]))
    for beyond in ((10, 5, 21), (121, 5, 20)):
        with pytest.raises(Exception, match=f"no win probability for the state b = {beyond[0]}, w = 5, r = {beyond[2]}"):
            winprob.with_wp(spark.createDataFrame([beyond], schema), surface).collect()


def test_a_stream_of_states_is_looked_up_alike(spark, tmp_path):
    surface = spark.createDataFrame([(10, 5, 20, 0.25)], "b int, w int, r int, wp double")
    schema = "match_id long, ball_index int, batter string, b int, w int, r int, ts timestamp"
    when = dt.datetime(2024, 1, 1)

    def run(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "in"))
        stream = live.scored_stream(spark.readStream.schema(schema).parquet(str(tmp_path / name / "in")), surface)
        query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.ball_index, r.wp) for r in spark.table(name).collect())

    assert run("known", [(1, 0, "a", 10, 5, 20, when), (1, 1, "a", 9, 5, 0, when), (1, 2, "a", 0, 5, 1, when)]) == [(0, 0.25), (1, 1.0), (2, 0.5)]
    with pytest.raises(Exception, match="no win probability"):
        run("unknown", [(1, 0, "a", 10, 5, 99, when)])


def test_versions_survive_a_failed_write(spark, tmp_path):
    root = str(tmp_path / "balls")
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, root)
    rows = spark.createDataFrame([(1, "train"), (2, "holdout")], "match_id long, split string")
    first = versions.write_version(rows, root, ("split",))
    fails = rows.withColumn("li", F.when(F.col("match_id") == 2, F.raise_error(F.lit("cut off")).cast("double")).otherwise(F.lit(1.0)))
    with pytest.raises(Exception, match="cut off"):
        versions.write_version(fails, root)
    assert versions.current_version(spark, root) == first
    assert sorted(versions.read_version(spark, root).columns) == ["match_id", "split"]
    second = versions.append_columns(spark, root, lambda now: now.withColumn("li", F.col("match_id") * 0.5), ("split",))
    assert second > first and sorted((r.match_id, r.li) for r in versions.read_version(spark, root).collect()) == [(1, 0.5), (2, 1.0)]
    assert versions.read_version(spark, root, first).columns == ["match_id", "split"]
    with pytest.raises(ValueError, match="would be lost: split"):
        versions.append_columns(spark, root, lambda now: now.drop("split"))
    assert versions.current_version(spark, root) == second


def test_bad_cells_are_told_from_sound_lines(spark, tmp_path):
    names = [f.name for f in deliveries.RAW_SCHEMA]
    line = lambda **other: ",".join(["z", *({**dict.fromkeys(names, "1"), "match_id": "7", "date": "2020-01-02", **other}[n] for n in reversed(names))])
    path = tmp_path / "raw.csv"
    path.write_text("\n".join([",".join(["extra", *reversed(names)]), line(), line(runs_total="many", match_id="8"), line(date="someday", match_id="9"), line(overs="", method=""), "z,1"]) + "\n")
    scanned = deliveries.scan_csv(spark, str(path))
    assert sorted(r.match_id for r in deliveries.read_csv(spark, str(path)).collect()) == [7, 7]
    audit = deliveries.rejected(scanned).first()
    assert (audit.n, audit.rejected, audit.null_runs_total, audit.null_date, audit.null_method) == (5, 3, 2, 2, 1)
    assert {r.match_id for r in scanned.filter("_rejected like '%many%'").collect()} == {8}


def made_balls(spark, seed=5, n=3000):
    dice = random.Random(seed)
    rows = []
    for k in range(n):
        b, r = dice.randint(1, 120), dice.randint(1, 60)
        season = dice.randint(0, 5)
        rows.append((k // 100, k % 100, f"s{9 - season}", dt.date(2000 + season, 1, 1), b, dice.randint(1, 10), r, 6.0 * r / b, dice.choice(("powerplay", "middle", "death")), dice.choice("012346W"), dice.randint(0, 1)))
    return spark.createDataFrame(rows, "match_id long, ball_index int, season string, date date, b int, w int, r int, rrr double, phase string, outcome string, y int")


def test_half_life_scores_equal_models_fitted_on_balls(spark):
    balls = made_balls(spark)
    lives = [0, 2.0, 0.5]
    got = {r.half_life: (r.log_loss, r.brier, r.ess) for r in era.half_life_scores(balls, lives).collect()}
    for life in lives:
        parts = []
        for fold in (3, 4, 5):
            fit = outcomes.with_recency(balls.filter(F.year("date") < 2000 + fold), life or None)
            valid = balls.filter(F.year("date") == 2000 + fold)
            rows = winprob.with_wp(valid, winprob.solve(outcomes.full_grid(fit), winprob.greatest_r(balls)))
            w = F.col("weight")
            ess = fit.agg(F.pow(F.sum(w), 2) / (F.sum(w * w) * F.count("*"))).first()[0]
            score = rows.agg(F.avg(metrics.row_log_loss(F.col("wp"), F.col("y"))), F.avg(F.pow(F.col("wp") - F.col("y"), 2))).first()
            parts.append((score[0], score[1], ess))
        assert np.allclose(got[life], np.mean(parts, axis=0), atol=1e-9)


def test_half_life_models_cost_no_copies_of_balls(spark):
    stats = era.season_cells(made_balls(spark))
    assert stats.agg(F.sum("n")).first()[0] == 3000
    fits = era.fold_models(stats)
    assert fits.count() <= 3 * len(era.HALF_LIVES) * stats.count()
    means = fits.groupBy("fold", "half_life").agg((F.sum("weight") / F.sum("n")).alias("m")).collect()
    assert len(means) == 30 and all(abs(r.m - 1) < 1e-9 for r in means)


def test_cells_parents_and_base_come_from_one_scan(spark, tmp_path):
    path = str(tmp_path / "balls")
    made_balls(spark).withColumn("weight", F.lit(1.0)).write.parquet(path)
    fit = spark.read.parquet(path)
    found = outcomes.cells(fit)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    parents = {(r.phase, r.w): r.parent for r in outcomes.parents(fit, outcomes.base_distribution(fit)).collect()}
    base = outcomes.base_distribution(fit).first()[0]
    for r in found.collect():
        assert np.allclose(r.parent, parents[r.phase, r.w]) and np.allclose(r.base, base)


def rule(spark, under, shrink, shares, closed):
    slices = spark.createDataFrame([("m", ahead, 0.5, 0.6 if up else 0.4) for ahead, up in under], "model string, ahead boolean, mean_pred double, actual double")
    gaps = spark.createDataFrame([("m", *shares)], "model string, memoryless_share double, shift_share double")
    row = metrics.recommendation(slices, gaps, spark.createDataFrame([(shrink,)], "shrink double"), spark.createDataFrame([(closed,)], "closed double"), "m").first()
    return row.rule


def test_the_first_rule_that_holds_is_chosen(spark):
    both, one = [(True, True), (False, True)], [(True, True), (False, False)]
    assert rule(spark, both, 0.3, (0.4, 0.6), 0.9) == "era adjustment"
    assert rule(spark, both, 0.3, (0.5, 0.5), 0.1) == "era adjustment"
    assert rule(spark, one, 0.3, (0.4, 0.6), 0.75) == "recalibration"
    assert rule(spark, both, 0.25, (0.4, 0.6), 0.8) == "recalibration"
    assert rule(spark, both, 0.3, (0.6, 0.4), 0.7) == "hidden state"
    assert rule(spark, both[:1], 0.3, (0.4, 0.6), None) == "hidden state"
    assert rule(spark, both, None, (0.4, 0.6), None) == "hidden state"


def test_lists_of_few_players_and_positions(spark):
    table = spark.createDataFrame([(f"p{k}", k) for k in range(1, 6)], "player string, rank int")
    got = players.leverage_lists(table, 2, 4).collect()
    assert [(r.place, r.player) for r in sorted(got, key=lambda r: (r["list"], r.place)) if r["list"] == "top"] == [(1, "p1"), (2, "p2")]
    assert [(r.place, r.player) for r in sorted(got, key=lambda r: (r["list"], r.place)) if r["list"] == "bottom"] == [(1, "p5"), (2, "p4"), (3, "p3"), (4, "p2")]
    profile = spark.createDataFrame([(k, float(k if k <= 7 else -k)) for k in range(1, 12)] + [(None, 9.0)], "bat_pos int, mean_li double")
    found = {r.scope: (r.correlation, r.positions) for r in players.position_correlations(profile).collect()}
    assert found["1-7"] == (pytest.approx(1.0), 7) and found["all"][0] < 0 and found["all"][1] == 11


def test_fitted_models_have_twins():
    assert {"logit_rrr", "logit_full", "gate_verdict", "era_closure", "isotonic_platt", "recalibration_closure", "split_robustness", "recommendation", "grouped_folds", "csv_audit"} <= set(ORACLES)


def test_counted_rows_give_the_fit_and_scores_of_the_rows_themselves(spark):
    rows = [(float(x % 5), int((x * x) % 7 < 3)) for x in range(60)]
    whole = spark.createDataFrame(rows, "rrr double, y int")
    counted = whole.groupBy("rrr", "y").count().withColumnRenamed("count", "n")
    beta = [models.logistic_weights(whole, [F.col("rrr")]), models.logistic_weights(counted, [F.col("rrr")], "n")]
    assert abs(beta[0] - beta[1]).max() < 1e-9
    p = (F.col("rrr") / 5 + 0.1).alias("p")
    one, two = metrics.scores(whole.select(p, "y"), []).first(), metrics.scores(counted.select(p, "y", "n"), [], "n").first()
    assert one["n"] == two["n"] == 60 and all(abs(one[c] - two[c]) < 1e-12 for c in ("brier", "log_loss", "mean_pred", "actual"))
