"""Each query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from chaseline.plans.queries import ORACLES, QUERIES

FAST = ["contract_summary", "drop_audit", "extras_audit", "outcome_freq", "season_split", "quality_gate", "base_dist", "hier_cells", "cell_lookup", "weighted_runs", "ess_by_half_life", "features", "leverage_by_phase", "wpa_totals", "martingale_drift", "brier_logloss", "ece", "murphy_gap", "ahead_calibration", "gap_by_rrr", "marginal_tv", "lag_profile", "icc", "cluster_bootstrap", "stratified_sample", "cell_index", "cell_positions", "perm_null", "dependence_verdict", "split_gap", "tail_summary", "scores_by_phase", "scores_by_wickets", "markov_table", "leverage_lists", "position_correlations", "logit_full", "gate_verdict", "grouped_folds", "isotonic_platt", "recommendation", "csv_audit", "half_life_cv"]


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: repr(round(float(x), 5) + 0.0) if isinstance(x, float) and not math.isnan(x) else repr(x)
    return sorted(tuple(show(row[i]) for i in order) for row in rows), sorted(names)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_twin(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    twin = con.execute(ORACLES[name])
    names = [x[0] for x in twin.description]
    df = QUERIES[name](spark, sf)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(twin.fetchall(), names)
