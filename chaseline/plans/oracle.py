"""SQL twins of the queries, for an independent engine. ``sql(final)`` puts the needed common tables before ``final``."""

from __future__ import annotations

import re

from ..functions.draws import FIRST, MASK, SECOND, STEP
from ..operators.models import ONE_LABEL

_CASE_PHASE = "CASE WHEN over < 6 THEN 'powerplay' WHEN over < 15 THEN 'middle' ELSE 'death' END"
_RUNS = "CASE WHEN outcome = 'W' THEN 0.0::DOUBLE ELSE outcome::DOUBLE END"
_RB = "((x >= 6)::INT + (x >= 8)::INT + (x >= 10)::INT + (x >= 12)::INT + (x >= 15)::INT)"
_RIGHT = "CASE WHEN rrr < 0 THEN NULL WHEN rrr <= 6 THEN 0 WHEN rrr <= 8 THEN 1 WHEN rrr <= 10 THEN 2 WHEN rrr <= 12 THEN 3 WHEN rrr <= 14 THEN 4 WHEN rrr <= 16 THEN 5 WHEN rrr <= 18 THEN 6 WHEN rrr <= 22 THEN 7 WHEN rrr <= 40 THEN 8 END"
_LEFT = (
    "greatest(least((rrr >= 0)::INT + (rrr >= 6)::INT + (rrr >= 8)::INT + (rrr >= 10)::INT + (rrr >= 12)::INT + (rrr >= 14)::INT + (rrr >= 16)::INT + (rrr >= 18)::INT + (rrr >= 22)::INT + (rrr >= 40)::INT - 1, "
    "8), 0)"
)
_O = ["0", "1", "2", "3", "4", "5", "6", "W"]


def bin_of(p: str, bins: int) -> str:
    return "(" + " + ".join(f"({p} >= {i}::DOUBLE / {bins})::INT" for i in range(1, bins)) + ")"


def counts(weight: str = "weight") -> str:
    return "[" + ", ".join(f"sum(CASE WHEN outcome = '{o}' THEN {weight} ELSE 0 END)::DOUBLE" for o in _O) + "]"


_LAYER = " + ".join(
    ["0.0::DOUBLE", *(f"cells[cell + 1][{k + 1}] * (CASE WHEN r <= {k} THEN 1.0 ELSE layer[i + 1 - {k}] END)" for k in range(7)), "cells[cell + 1][8] * (CASE WHEN w = 1 THEN 0.0 ELSE layer[i + 1 - rm] END)"]
)


def _layer() -> str:
    x = "(6.0::DOUBLE * (i % rm + 1) / (b + 1))"
    cell = f"(({_RB.replace('x', x)}) * 11 + (i // rm + 1)) * 3 + (CASE WHEN (119 - b) // 6 < 6 THEN 0 WHEN (119 - b) // 6 < 15 THEN 1 ELSE 2 END)"
    body = re.sub(r"\bcell\b", f"({cell})", _LAYER)
    body = re.sub(r"\br\b", "(i % rm + 1)", body)
    return re.sub(r"\bw\b", "(i // rm + 1)", body)


def surface(name: str, cells: str, keys: str = "") -> dict[str, str]:
    """Common tables that solve ``cells (cells list)``, a row a model, into ``name (b, w, r, wp)``; ``keys`` name the models."""
    more = f"{keys}, " if keys else ""
    joined = f"{name}_layers, rmax, {cells}" if not keys else f"{name}_layers JOIN {cells} USING ({keys}), rmax"
    first = (
        f"SELECT {more}0 AS b, list_transform(range(10 * rm), lambda i: CASE WHEN i % rm = 0 THEN 0.5::DOUBLE ELSE 0.0 END) AS layer "
        f"FROM rmax"
    ) + (f", {cells}" if keys else "")
    return {
        f"{name}_layers": f"{first} UNION ALL SELECT {more}b + 1, list_transform(range(10 * rm), lambda i: {_layer()}) FROM {joined} WHERE b < 120",
        name: (
            f"SELECT {more}b, (i // rm + 1)::INT AS w, (i % rm + 1)::INT AS r, layer[i + 1] AS wp "
            f"FROM (SELECT {more}b, layer, rm, unnest(range(10 * rm)) AS i FROM {name}_layers, rmax WHERE b > 0)"
        ),
    }


def model(name: str, weighted: str, keys: str = "") -> dict[str, str]:
    """Common tables of a cell model fitted on ``weighted``: base, parents, cells, the whole grid and its list; one for each value of ``keys``."""
    shrunk = "list_transform(list_zip(c, p), lambda z: (z[1] + 10 * z[2]) / (list_sum(c) + 10))"
    more, by = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    base = f"JOIN {name}_base USING ({keys})" if keys else f", {name}_base"
    grid = "SELECT * FROM range(6) t(rb), range(1, 11) u(w), (VALUES (0, 'powerplay'), (1, 'middle'), (2, 'death')) v(ph, phase)" + (f", {name}_base" if keys else "")
    return {
        f"{name}_base": (
            f"SELECT {more}list_transform(f, lambda z: z / list_sum(f)) AS base "
            f"FROM (SELECT {more}list_transform({counts()}, lambda z: z + 0.5) AS f FROM {weighted} {by})"
        ),
        f"{name}_parents": (
            f"SELECT {more}phase, w, {shrunk} AS parent FROM (SELECT {more}phase, w, c, base AS p "
            f"FROM (SELECT {more}phase, w, {counts()} AS c FROM {weighted} GROUP BY ALL) {base})"
        ),
        f"{name}_cells": (
            f"SELECT {more}rb, w, phase, {shrunk} AS cell FROM (SELECT {''.join(f'k.{x}, ' for x in keys.split(', ') if x)}k.rb, k.w, "
            f"k.phase, k.c, q.parent AS p FROM (SELECT {more}{_RB.replace('x', 'rrr')} AS rb, w, phase, {counts()} AS c FROM {weighted} "
            f"GROUP BY ALL) k JOIN {name}_parents q USING ({more}phase, w))"
        ),
        f"{name}_grid": (
            f"SELECT {more}(rb * 11 + w) * 3 + ph AS cell_id, rb AS rrr_bin, w, phase, coalesce(cell, parent, base) AS p FROM ({grid}) g "
            f"LEFT JOIN {name}_parents USING ({more}phase, w) LEFT JOIN {name}_cells USING ({more}rb, w, phase)"
        ) + ("" if keys else f", {name}_base"),
        f"{name}_list": f"SELECT list(p ORDER BY id) AS cells FROM (SELECT id, p FROM range(198) t(id) LEFT JOIN {name}_grid ON cell_id = id)" if not keys else (
            f"SELECT {more}list(p ORDER BY id) AS cells FROM (SELECT {more}id, p FROM (SELECT * FROM range(198) t(id), (SELECT {keys} "
            f"FROM {name}_base)) LEFT JOIN (SELECT {more}cell_id AS id, p FROM {name}_grid) USING ({more}id)) GROUP BY {keys}"
        ),
    }


COMMON: dict[str, str] = {
    "numbered": (
        "SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, "
        "l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS rn FROM lineitem"
    ),
    "chunks": "SELECT *, l_suppkey * 1000 + rn // 150 AS match_id, rn % 150 AS seq FROM numbered",
    "flagged": """SELECT *, CASE WHEN l_tax >= 0.075 AND l_discount >= 0.05 THEN 0 ELSE 1 END AS valid_ball, (l_quantity >= 49)::INT AS wicket, l_partkey % 44 AS player,
        CASE WHEN l_quantity <= 15 THEN 0 WHEN l_quantity <= 34 THEN 1 WHEN l_quantity <= 38 THEN 2 WHEN l_quantity <= 39 THEN 3 WHEN l_quantity <= 45 THEN 4 WHEN l_quantity <= 48 THEN 6 ELSE 0 END AS runs_total,
        min(l_shipdate) OVER (PARTITION BY match_id)::DATE AS date, 125 + (match_id * 37) % 90 AS runs_target FROM chunks QUALIFY count(*) OVER (PARTITION BY match_id) = 150""",
    "running": (
        "SELECT *, sum(runs_total) OVER g AS team_runs, sum(valid_ball) OVER g AS team_balls, sum(wicket) OVER g AS team_wicket, "
        "count(*) OVER (PARTITION BY match_id, player ORDER BY seq) AS batter_balls FROM flagged WINDOW g AS (PARTITION BY match_id "
        "ORDER BY seq)"
    ),
    "raw": """SELECT match_id, seq, CASE WHEN match_id % 29 = 0 THEN 1 ELSE 2 END AS innings, date, year(date)::VARCHAR AS season, valid_ball, runs_total, team_runs, team_balls, team_wicket, runs_target,
        max(team_runs) OVER (PARTITION BY match_id) >= runs_target AS won, CASE WHEN match_id % 43 = 0 THEN 'no result' END AS result_type, CASE WHEN match_id % 41 = 0 THEN 'D/L' END AS method,
        CASE WHEN match_id % 47 = 0 THEN 18 WHEN match_id % 53 = 0 THEN NULL ELSE 20 END AS overs, batter_balls, 'P' || player AS batter, 'B' || (l_orderkey % 30) AS bowler, 1 + player % 11 AS bat_pos
        FROM running WHERE team_balls - valid_ball < 120 AND team_wicket - wicket < 10 AND team_runs - runs_total < runs_target""",
    "second": (
        "SELECT *, coalesce(method = 'D/L', false) AS dls, coalesce(result_type = 'no result', false) AS no_result, overs IS DISTINCT "
        "FROM 20 AS non_standard FROM raw WHERE innings = 2"
    ),
    "ranked": (
        "SELECT *, team_wicket - lag(team_wicket, 1, 0) OVER g AS is_wicket, sum(valid_ball) OVER g AS legal_rank FROM second "
        "WHERE NOT (dls OR no_result OR non_standard) WINDOW g AS (PARTITION BY match_id ORDER BY seq)"
    ),
    "extras": "SELECT match_id, legal_rank + 1 AS legal_rank, sum(runs_total) AS absorbed FROM ranked WHERE valid_ball = 0 GROUP BY ALL",
    "legal": "SELECT r.*, coalesce(absorbed, 0) AS absorbed FROM ranked r LEFT JOIN extras USING (match_id, legal_rank) WHERE valid_ball = 1",
    "states": """SELECT match_id, season, date, (team_balls - 1)::INT AS ball_index, ((team_balls - 1) // 6)::INT AS over, (121 - team_balls)::INT AS b, (10 - (team_wicket - is_wicket))::INT AS w, (runs_target - (team_runs - runs_total))::INT AS r,
        CASE WHEN is_wicket = 1 THEN 'W' ELSE least(runs_total + absorbed, 6)::INT::VARCHAR END AS outcome, greatest(batter_balls - 1, 0) AS striker_balls, batter, bowler, bat_pos, won::INT AS y FROM legal""",
    "seasons": (
        "SELECT season, ord, CASE WHEN ord >= count(*) OVER () - 3 THEN 'holdout' ELSE 'train' END AS split, first_date "
        "FROM (SELECT season, min(date) AS first_date, row_number() OVER (ORDER BY min(date), season) - 1 AS ord FROM states "
        "GROUP BY season)"
    ),
    "balls": f"SELECT s.*, 6.0::DOUBLE * r / b AS rrr, {_CASE_PHASE} AS phase, split FROM states s JOIN seasons USING (season)",
    "rmax": "SELECT max(r)::INT + 1 AS rm FROM balls",
    "train": "SELECT *, 1.0::DOUBLE AS weight FROM balls WHERE split = 'train'",
    "ages": (
        "SELECT season, count(*) AS n, pow(0.5::DOUBLE, (row_number() OVER (ORDER BY min(date) DESC, "
        "season DESC) - 1) / 0.75::DOUBLE) AS raw FROM train GROUP BY season"
    ),
    "era": "SELECT t.* EXCLUDE (weight), raw * ((SELECT sum(n) / sum(raw * n) FROM ages)) AS weight FROM train t JOIN ages USING (season)",
    **model("plain", "train"),
    **model("recent", "era"),
    "flat_list": "SELECT list_transform(range(198), lambda i: base) AS cells FROM plain_base",
    **surface("wp_recent", "recent_list"),
    **surface("wp_plain", "plain_list"),
    **surface("wp_flat", "flat_list"),
    "coded": (
        f"SELECT *, ({_RB.replace('x', 'rrr')} * 11 + w) * 3 + CASE phase WHEN 'powerplay' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END AS cell_id "
        f"FROM balls"
    ),
    "states_wp": (
        "SELECT DISTINCT c.b, c.w, c.r, g.p, s.wp FROM coded c JOIN recent_grid g USING (cell_id) "
        "JOIN wp_recent s ON (c.b, c.w, c.r) = (s.b, s.w, s.r)"
    ),
    "moves": (
        "SELECT b, w, r, wp, k, p[k + 1] AS prob, b - 1 AS nb, w - (k = 7)::INT AS nw, r - CASE WHEN k = 7 THEN 0 ELSE k END AS nr "
        "FROM states_wp, range(8) t(k)"
    ),
    "next": (
        "SELECT m.*, CASE WHEN nr <= 0 THEN 1.0 WHEN nw = 0 THEN 0.0 WHEN nb = 0 AND nr = 1 THEN 0.5 WHEN nb = 0 THEN 0.0 ELSE s.wp END AS next_wp "
        "FROM moves m LEFT JOIN wp_recent s ON (nb, nw, nr) = (s.b, s.w, s.r)"
    ),
    "swings": "SELECT b, w, r, sum(prob * abs(next_wp - wp)) AS swing FROM next GROUP BY ALL",
    "scored": (
        "SELECT q.*, s.wp, swing / avg(swing) OVER () AS li FROM balls q JOIN wp_recent s ON (q.b, q.w, q.r) = (s.b, s.w, s.r) "
        "JOIN swings z ON (q.b, q.w, q.r) = (z.b, z.w, z.r)"
    ),
    "steps": "SELECT *, coalesce(lead(wp) OVER (PARTITION BY match_id ORDER BY ball_index), y::DOUBLE) AS wp_after FROM scored",
    "moved": "SELECT *, wp_after - wp AS wpa_bat, floor(least(greatest(wp, 0), 1) / 0.02::DOUBLE) AS drift_bin FROM steps",
    "credited": (
        "SELECT *, -wpa_bat AS wpa_bowl, wpa_bat - avg(wpa_bat) OVER (PARTITION BY drift_bin) AS wpa_bat_dd, "
        "-(wpa_bat - avg(wpa_bat) OVER (PARTITION BY drift_bin)) AS wpa_bowl_dd FROM moved"
    ),
    "predictions": """SELECT model, split, match_id, ball_index, phase, w, r, b, rrr, wp AS p, y FROM (SELECT 'base Markov' AS model, * FROM wp_flat UNION ALL SELECT 'RRR Markov', * FROM wp_plain) s JOIN balls USING (b, w, r)
        UNION ALL SELECT 'base-rate const', split, match_id, ball_index, phase, w, r, b, rrr, (SELECT avg(y) FROM train), y FROM balls""",
    "held": "SELECT * FROM predictions WHERE split = 'holdout'",
    "curve": f"SELECT model, {bin_of('p', 15)} AS bin, avg(p) AS conf, avg(y) AS acc, count(*) AS n FROM held GROUP BY ALL",
    "xs": (
        f"SELECT match_id, ball_index, phase, w, {_RUNS} AS x, (outcome = 'W')::INT AS k, "
        f"coalesce(sum((outcome = 'W')::INT) OVER (PARTITION BY match_id "
        f"ORDER BY ball_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS part FROM balls WHERE split = 'train'"
    ),
    "resid": (
        "SELECT match_id, ball_index, part, x - avg(x) OVER (PARTITION BY phase, w) AS runs, k - avg(k) OVER (PARTITION BY phase, "
        "w) AS wkt FROM xs"
    ),
}


def needed(text: str) -> list[str]:
    """Common tables that ``text`` refers to, directly or not, in order of definition."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"[a-z_]\w*", todo.pop()))
        for name in words & set(COMMON) - found:
            found.add(name)
            todo.append(COMMON[name])
    return [name for name in COMMON if name in found]


def sql(final: str, **more: str) -> str:
    """``final`` with the common tables it needs; ``more`` defines tables of its own."""
    names = needed(" ".join([final, *more.values()]))
    kind = lambda name, text: "" if re.search(rf"(FROM|JOIN) {name}\b", text) else "MATERIALIZED "  # noqa: E731  recursive tables name themselves
    tables = [f"{name} AS {kind(name, text)}({text})" for name, text in ({n: COMMON[n] for n in names} | more).items()]
    return f"WITH RECURSIVE {', '.join(tables)} {final}" if tables else final


def profile(source: str, keys: str = "", values: tuple[str, ...] = ("runs", "wkt")) -> str:
    """A lag profile of each series of ``source`` in long form; all lags of a variant and scope in one pass."""
    more = f"{keys}, " if keys else ""
    parts = []
    for value in values:
        for variant, by in (("state", None), ("state+innings", "match_id"), ("state+partnership", "match_id, part")):
            x = value if by is None else f"{value} - avg({value}) OVER (PARTITION BY {more}{by})"
            for scope, group, lags in (("innings", "match_id", (1, 2, 3, 5, 10, 20, 30)), ("partnership", "match_id, part", (1, 2, 3, 5, 10))):
                leads = ", ".join(f"lead(x, {k}) OVER g AS l{k}" for k in lags)
                rows = ", ".join(f"{{'lag': {k}, 'r': CASE WHEN count(l{k}) >= 30 THEN corr(x, l{k}) END, 'n': count(l{k})}}" for k in lags)
                parts.append((
                    f"SELECT {more}'{value}' AS series, '{variant}' AS variant, '{scope}' AS scope, unnest([{rows}], recursive := true) "
                    f"FROM (SELECT {more}x, {leads} FROM (SELECT {more}match_id, part, ball_index, {x} AS x FROM {source}) "
                    f"WINDOW g AS (PARTITION BY {more}{group} ORDER BY ball_index)) {f'GROUP BY {keys}' if keys else ''}"
                ))
    return " UNION ALL ".join(parts)


def draw(name: str, *parts: str) -> str:
    """Columns whose last, ``name``, is the state of ``functions.draws.mixed`` after all parts, from state 0."""
    steps, h = [], "0::BIGINT"
    for i, part in enumerate(parts):
        a, b, c, d = (f"{name}_{i}{k}" for k in "abcd")
        steps += [f"(({h} + ({part})::BIGINT * {STEP} + 1) & {MASK}) AS {a}", f"((xor({a}, {a} >> 16) * {FIRST}) & {MASK}) AS {b}", f"((xor({b}, {b} >> 15) * {SECOND}) & {MASK}) AS {c}", f"xor({c}, {c} >> 16) AS {d}"]
        h = d
    return ", ".join([*steps, f"{h} AS {name}"])


def name_key(*names: str) -> str:
    """The number of names, as ``functions.draws.name_key`` has it."""
    text = " || '|' || ".join(names)
    return f"('0x' || substr(md5({text}), 1, 7))::BIGINT"


RIGHT_SLICE, LEFT_SLICE, RUNS_OF = _RIGHT, _LEFT, _RUNS


#: Newton steps of a logistic twin, from zero.
NEWTON_STEPS = 14


def _solved(source: str, k: int) -> str:
    """A query of ``b, m``: the k x (k + 1) system ``m`` of ``source`` reduced to the unit matrix by Gauss and Jordan, a pivot a level."""
    text = source
    for i in range(1, k + 1):
        lead = f"SELECT b, m, list_transform(m[{i}], lambda v: v / m[{i}][{i}]) AS lead_row FROM ({text})"
        others = f"list_transform(range(1, {k + 2}), lambda j: m[i][j] - m[i][{i}] * lead_row[j])"
        text = f"SELECT b, list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = {i} THEN lead_row ELSE {others} END) AS m FROM ({lead})"
    return text


def logit(name: str, source: str, features: list[str], standardize: bool = False) -> dict[str, str]:
    """Common tables that fit an L2 logistic of C = 1 on ``source (y, features)`` by Newton's method.

    ``{name}_fit (coef, mu, sd)`` has the intercept and coefficients, which are those of
    ``(feature - mu) / sd``; ``logit_p`` turns it into probabilities.
    """
    k = len(features) + 1
    pick = (lambda f: f"[{', '.join(f(x) for x in features)}]::DOUBLE[]") if standardize else None
    scale = f"SELECT {pick(lambda x: f'avg({x})')} AS mu, {pick(lambda x: f'coalesce(nullif(stddev_pop({x}), 0), 1)')} AS sd FROM {source}" if pick else f"SELECT {[0.0] * (k - 1)}::DOUBLE[] AS mu, {[1.0] * (k - 1)}::DOUBLE[] AS sd"
    tables = {f"{name}_scale": scale, f"{name}_x": f"SELECT y, {_row(features)} AS x FROM {source}, {name}_scale", f"{name}_b0": f"SELECT {[0.0] * k}::DOUBLE[] AS b"}
    for t in range(1, NEWTON_STEPS + 1):
        gram = lambda i, j: f"sum(p * (1 - p) * x[{i}] * x[{j}])" + (" + 1" if i == j > 1 else "")
        side = lambda i: f"sum((y - p) * x[{i}])" + (f" - any_value(b)[{i}]" if i > 1 else "")
        system = ", ".join(f"[{', '.join([*(gram(min(i, j), max(i, j)) for j in range(1, k + 1)), side(i)])}]" for i in range(1, k + 1))
        rows = f"SELECT y, x, b, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM {name}_x, {name}_b{t - 1}"
        sums = f"SELECT any_value(b) AS b, [{system}]::DOUBLE[][] AS m FROM ({rows})"
        tables[f"{name}_m{t}"] = sums
        tables[f"{name}_b{t}"] = (
            f"SELECT list_transform(range(1, {k + 1}), lambda i: b[i] + m[i][{k + 1}])::DOUBLE[] AS b "
            f"FROM ({_solved(f'SELECT * FROM {name}_m{t}', k)})"
        )
    certain = f"list_transform(range({k}), lambda i: CASE WHEN i > 0 THEN 0.0 WHEN y1 = 1 THEN {ONE_LABEL} ELSE -{ONE_LABEL} END)::DOUBLE[]"
    labels = f"(SELECT min(y) AS y0, max(y) AS y1 FROM {source})"
    tables[f"{name}_fit"] = f"SELECT CASE WHEN y0 = y1 THEN {certain} ELSE b END AS coef, mu, sd FROM {name}_b{NEWTON_STEPS}, {name}_scale, {labels}"
    return tables


def _row(features: list[str]) -> str:
    return f"[1.0, {', '.join(f'({x} - mu[{i}]) / sd[{i}]' for i, x in enumerate(features, 1))}]::DOUBLE[]"


def logit_p(features: list[str]) -> str:
    """The probability of a row of the features beside ``coef, mu, sd``."""
    return f"1 / (1 + exp(-list_dot_product({_row(features)}, coef)))"


def isotonic(name: str, points: str) -> dict[str, str]:
    """Common tables of the isotonic fit of ``points (p, y)``: ``{name}_blocks (x, v)``, both ends of each block with its mean, in order.

    Blocks are found from the right: of all stretches that end where a block must end, the
    block is the one of the greatest mean, the longest of equals.
    """
    return {
        f"{name}_sorted": (
            f"SELECT p, row_number() OVER (ORDER BY p) AS k, sum(s) OVER (ORDER BY p) AS c, sum(n) OVER (ORDER BY p) AS m, s, n "
            f"FROM (SELECT p, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n FROM {points} GROUP BY p)"
        ),
        f"{name}_walk": f"""SELECT max(k) + 1 AS first, NULL::BIGINT AS last, NULL::DOUBLE AS v FROM {name}_sorted UNION ALL
            (SELECT arg_min(q.k, (-round((e.c - q.c + q.s) / (e.m - q.m + q.n), 12), q.k)), w.first - 1, max((e.c - q.c + q.s) / (e.m - q.m + q.n))
            FROM {name}_walk w JOIN {name}_sorted e ON e.k = w.first - 1 JOIN {name}_sorted q ON q.k < w.first GROUP BY w.first)""",
        f"{name}_blocks": f"SELECT p AS x, v FROM {name}_walk JOIN {name}_sorted ON k = first OR k = last WHERE last IS NOT NULL",
    }


def isotonic_p(name: str, rows: str) -> str:
    """``rows`` with ``iso``: the fit at ``wp``, linear between blocks and constant beyond them."""
    low = f"(SELECT r.*, lo.x AS x0, lo.v AS v0 FROM ({rows}) r ASOF LEFT JOIN {name}_blocks lo ON r.wp >= lo.x)"
    both = f"(SELECT r.*, hi.x AS x1, hi.v AS v1 FROM {low} r ASOF LEFT JOIN {name}_blocks hi ON r.wp <= hi.x)"
    between = "CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL OR x1 = x0 THEN v0 ELSE v0 + (v1 - v0) * (wp - x0) / (x1 - x0) END"
    return f"SELECT *, {between} AS iso FROM {both}"


def balanced_folds(name: str, source: str, folds: int = 5) -> dict[str, str]:
    """Common tables that deal whole matches, largest first, to the fold of the fewest rows: ``{name} (match_id, fold)``."""
    zeros = f"{[0] * folds}::BIGINT[]"
    least = "list_position(loads, list_min(loads))"
    return {
        f"{name}_groups": (
            f"SELECT match_id, size, row_number() OVER (ORDER BY size DESC, match_id) AS k FROM (SELECT match_id, count(*) AS size "
            f"FROM {source} GROUP BY match_id)"
        ),
        f"{name}_walk": f"""SELECT 0::BIGINT AS k, NULL::BIGINT AS match_id, NULL::INT AS fold, {zeros} AS loads UNION ALL
            SELECT g.k, g.match_id, ({least} - 1)::INT, list_transform(loads, lambda x, i: CASE WHEN i = {least} THEN x + g.size ELSE x END) FROM {name}_walk w JOIN {name}_groups g ON g.k = w.k + 1""",
        name: f"SELECT match_id, fold FROM {name}_walk WHERE k > 0",
    }
