"""Monte-Carlo continuations of chases, from the outcome model or from stretches of real innings.

Three modes continue a state until the chase ends: ``model`` draws each ball from the
outcome model; ``block K`` takes the next K balls of a real innings, from a ball that was
bowled in the present cell; ``scattered K`` draws each ball from balls of the present cell
in one real innings, and takes another innings every K balls.

Every draw is a hash of seed, mode, state, path and ball. Donor balls are gathered once a
seed: all of a cell, or MOST_DONORS of it drawn uniformly where it has more, so that their
number is bounded whatever the data and each draw is uniform over the whole cell. They and
the innings that they stand in (at most 120 balls each) are what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chase

BLOCKS, SCATTERED_K, SIMS, STATES = [1, 3, 8, 20, 40, 80, 120], 20, 400, 220
#: Donor balls of a cell and seed; 180 cells are possible.
MOST_DONORS = 1024
CELLS = chase.RRR_BINS * 33
#: Outcomes that a task folds at once.
FOLDED = 1 << 19
_RUNS = np.array([0, 1, 2, 3, 4, 5, 6, 0, 0], dtype=np.int16)  # the last: no ball
_NAMES = ["model", "block", "scattered"]


def _cell() -> Column:
    return chase.cell_id(chase.rrr_bin("rrr"), "w", chase.phase_index("phase"))


def cells_of(b: np.ndarray, w: np.ndarray, r: np.ndarray) -> np.ndarray:
    over = (chase.BALLS - b) // 6
    stage = (over >= 6).astype(np.int16) + (over >= 15)
    rate = np.searchsorted(chase.RRR_EDGES, 6.0 * r / b, side="right")
    return (rate * 11 + w) * 3 + stage


def hashed(key: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """64 bits that depend on the key and all parts."""
    x = key.astype(np.uint64)
    for part in parts:
        x = x + np.uint64(0x9E3779B97F4A7C15) * (np.atleast_1d(part).astype(np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return x


def _below(dice: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (dice % np.maximum(n, 1).astype(np.uint64)).astype(np.int64)


@dataclass
class Pool:
    """Donor balls by cell, their innings as rows of ``codes`` (-1 behind the end), and the model's distributions.

    ``row`` and ``ball`` place each donor; those of cell c are ``first[c]`` and the
    ``size[c]`` ones from there. A cell without balls has those of the nearest one that has.
    ``order`` has the balls of each innings by cell, ``starts`` where each cell's begin.
    """

    codes: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    row: np.ndarray
    ball: np.ndarray
    first: np.ndarray
    size: np.ndarray
    shares: np.ndarray

    def donors(self, cells: np.ndarray, dice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.first[cells] + _below(dice, self.size[cells])
        return self.row[k], self.ball[k]


def pool_of(innings: list[np.ndarray], cells: list[np.ndarray], donors: pd.DataFrame, shares: np.ndarray) -> Pool:
    """``donors``: row (of ``innings``), ball, cell."""
    n = max(len(innings), 1)
    codes, order, starts = np.full((n, chase.BALLS), -1, dtype=np.int8), np.zeros((n, chase.BALLS), dtype=np.int8), np.zeros((n, CELLS + 1), dtype=np.int8)
    for i, (one, where) in enumerate(zip(innings, cells, strict=True)):
        codes[i, : len(one)], order[i, : len(one)] = one, np.argsort(where, kind="stable")
        starts[i, 1:] = np.cumsum(np.bincount(where, minlength=CELLS))
    donors = donors.sort_values(["cell", "row", "ball"])
    size = np.bincount(donors["cell"], minlength=CELLS)
    first, known = np.cumsum(size) - size, np.flatnonzero(size)
    if len(known):
        nearest = known[np.abs(known[None, :] - np.arange(CELLS)[:, None]).argmin(1)]  # the lower of two
        first, size = first[nearest], size[nearest]
    return Pool(codes, order, starts, donors["row"].to_numpy(np.int64), donors["ball"].to_numpy(np.int64), first, size, np.cumsum(shares, axis=1))


def packed_innings(balls: DataFrame) -> DataFrame:
    """``match_id`` and the innings' balls in order, ``ball_index``, ``code`` and ``cell`` a byte each: none reaches 200."""
    entry = F.sort_array(F.collect_list(F.struct("ball_index", "code", "cell")))
    packed = lambda c: F.unhex(F.array_join(F.transform(f"e.{c}", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return balls.groupBy("match_id").agg(entry.alias("e")).select("match_id", *(packed(c).alias(c) for c in ("ball_index", "code", "cell")))


def gather_pool(train: DataFrame, grid: DataFrame, seed: int, most: int = MOST_DONORS) -> Pool:
    """The pool of the training balls. What comes to the driver is at most ``most`` balls a cell and their innings."""
    balls = train.select("match_id", "ball_index", chase.outcome_index("outcome").cast("int").alias("code"), _cell().cast("int").alias("cell"))
    balls = balls.withColumn("h", F.xxhash64(F.lit(seed), "match_id", "ball_index"))
    sizes = balls.groupBy("cell").agg(F.count("*").alias("n"))  # a row a cell
    share = F.least(F.lit(1.0), (most + 10 * most**0.5 + 100) / F.col("n"))  # ten standard deviations above the bound
    near = balls.join(F.broadcast(sizes), "cell").filter(F.col("h") <= (F.lit(-(2.0**63)) + share * 2.0**64))
    first = F.row_number().over(Window.partitionBy("cell").orderBy("h", "match_id", "ball_index"))
    picked = near.withColumn("k", first).filter(F.col("k") <= most).select("match_id", "ball_index", "cell").toPandas()
    matches = train.sparkSession.createDataFrame([(int(m),) for m in sorted(set(picked["match_id"]))], "match_id long")
    rows = packed_innings(balls.join(matches, "match_id", "left_semi")).toPandas()
    for name in ("ball_index", "code", "cell"):
        rows[name] = [np.frombuffer(x, np.uint8) for x in rows[name]]
    row = pd.Series(np.arange(len(rows)), index=rows["match_id"]).reindex(picked["match_id"]).to_numpy(np.int64)
    at = np.array([np.searchsorted(rows["ball_index"][i], k) for i, k in zip(row, picked["ball_index"], strict=True)], dtype=np.int64)
    shares = np.full((CELLS, len(chase.OUTCOMES)), 1 / len(chase.OUTCOMES))
    for cell, p in grid.select("cell_id", "p").collect():  # 180 rows
        shares[cell] = p
    return pool_of(list(rows["code"]), [c.astype(np.int64) for c in rows["cell"]], pd.DataFrame({"row": row, "ball": at, "cell": picked["cell"]}), shares)


def fold(b: np.ndarray, w: np.ndarray, r: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States after each path's row of ``codes`` (-1: no ball), stopped where the chase ends: b, w, r, final value or nan, balls taken."""
    known = codes >= 0
    bs = b[:, None] - np.cumsum(known, axis=1, dtype=np.int16)
    ws = w[:, None] - np.cumsum(codes == 7, axis=1, dtype=np.int16)
    rs = r[:, None] - np.cumsum(_RUNS[codes], axis=1, dtype=np.int16)
    ended = (rs <= 0) | (ws == 0) | (bs == 0)
    done = ended.any(axis=1)
    stop = np.where(done, ended.argmax(axis=1), codes.shape[1] - 1)
    i = np.arange(len(b))
    b, w, r = bs[i, stop], ws[i, stop], rs[i, stop]
    value = np.where(r <= 0, 1.0, np.where((w > 0) & (r == 1), chase.TIE, 0.0))
    return b, w, r, np.where(done, value, np.nan), known & (np.arange(codes.shape[1]) <= stop[:, None])


def _next_codes(pool: Pool, mode: str, block: int, ball: int, key: np.ndarray, b: np.ndarray, w: np.ndarray, r: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The next outcomes of each path: a row of ``block`` for blocks, else of one. ``held``: each path's donor innings, for ``scattered``."""
    cells = cells_of(b, w, r)
    dice = hashed(key, ball)
    if mode == "model":
        share = (dice >> np.uint64(11)) / 2.0**53
        steps = pool.shares[cells]
        return (share[:, None] * steps[:, -1:] >= steps).sum(axis=1, dtype=np.int8)[:, None]
    row, at = pool.donors(cells, dice)
    if mode == "block":
        where = at[:, None] + np.arange(block)
        return np.where(where < chase.BALLS, pool.codes[row[:, None], np.minimum(where, chase.BALLS - 1)], -1)
    if ball % block == 0:
        held[:] = row
    start = pool.starts[held, cells].astype(np.int64)
    n = pool.starts[held, cells + 1] - start
    own = pool.order[held, np.minimum(start + _below(hashed(dice, 7), n), chase.BALLS - 1)]
    return np.where(n > 0, pool.codes[held, own], pool.codes[row, at])[:, None]


def continuations(pool: Pool, b: np.ndarray, w: np.ndarray, r: np.ndarray, key: np.ndarray, mode: str, block: int, sims: int) -> tuple[np.ndarray, np.ndarray]:
    """For each state: the mean final value of ``sims`` continuations, and how often each outcome was drawn; nan without donors."""
    if mode != "model" and not len(pool.row):
        return np.full(len(b), np.nan), np.zeros((len(b), len(chase.OUTCOMES)), dtype=np.int64)
    states, value = np.repeat(np.arange(len(b)), sims), np.full(len(b) * sims, np.nan)
    key = hashed(np.repeat(key, sims), np.tile(np.arange(sims), len(b)))
    b, w, r = (np.repeat(x, sims).astype(np.int16) for x in (b, w, r))
    tally = np.zeros((len(value) // sims, len(chase.OUTCOMES)), dtype=np.int64)
    live, held, ball = np.arange(len(value)), np.zeros(len(value), dtype=np.int64), 0
    while len(live):
        codes = _next_codes(pool, mode, block, ball, key, b, w, r, held)
        b, w, r, final, taken = fold(b, w, r, codes)
        tally += np.bincount((states[live][:, None] * 8 + codes)[taken], minlength=tally.size).reshape(tally.shape)
        value[live] = final
        on = np.isnan(final)
        live, key, b, w, r, held = live[on], key[on], b[on], w[on], r[on], held[on]
        ball += 1
    return value.reshape(-1, sims).mean(axis=1), tally


def modes_table(spark) -> DataFrame:
    rows = [("model", 1), *(("block", k) for k in BLOCKS), ("scattered", SCATTERED_K)]
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(k).alias("block")) for m, k in rows))))


def simulate(states: DataFrame, train: DataFrame, grid: DataFrame, seeds: int, sims: int = SIMS) -> DataFrame:
    """``seed, mode, block, slice, state_id, wp, o0..o7`` for each mode of each of ``states (seed, state_id, slice, b, w, r)``."""
    spark = states.sparkSession
    jobs = states.select("state_id", "slice", "b", "w", "r", "seed").crossJoin(F.broadcast(modes_table(spark)))
    jobs = jobs.repartition(4 * spark.sparkContext.defaultParallelism, "state_id", "mode", "block")

    def of(seed: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(gather_pool(train, grid, seed))

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for (mode, block), rows in frame.groupby(["mode", "block"]):
                    at_once = int(min(64, max(1, FOLDED // (sims * block))))
                    for k in range(0, len(rows), at_once):
                        part = rows.iloc[k : k + at_once]
                        key = hashed(part["seed"].to_numpy(), _NAMES.index(mode), block, part["state_id"].to_numpy())
                        wp, tally = continuations(shared.value, *(part[c].to_numpy() for c in "bwr"), key, mode, int(block), sims)
                        out = part[["seed", "mode", "block", "slice", "state_id"]].assign(wp=wp)
                        yield out.assign(**{f"o{i}": tally[:, i] for i in range(8)})

        return jobs.filter(F.col("seed") == seed).mapInPandas(task, "seed int, mode string, block int, slice int, state_id long, wp double, " + ", ".join(f"o{k} long" for k in range(8)))

    return reduce(DataFrame.unionByName, (of(seed) for seed in range(seeds)))


def sampled_states(balls: DataFrame, most: int = STATES, seed: int = 0) -> DataFrame:
    """Real states, at most ``most`` of each left-closed rate slice, with a running ``state_id``."""
    from .resample import stratified_sample

    picked = stratified_sample(balls.withColumn("slice", chase.slice_left_closed("rrr")), "slice", most, seed)
    return picked.withColumn("state_id", F.row_number().over(Window.orderBy("match_id", "ball_index")).cast("long"))  # most * 9 rows


def seeded_states(balls: DataFrame, seeds: int, most: int = STATES) -> DataFrame:
    """``sampled_states`` of each seed, drawn anew, with its ``seed``."""
    return reduce(DataFrame.unionByName, (sampled_states(balls, most, s).withColumn("seed", F.lit(s)) for s in range(seeds)))


def gaps(simulated: DataFrame, exact: DataFrame) -> DataFrame:
    """Mean absolute gap over slices between simulated and observed win rates by seed and mode; ``exact (slice, win_rate)``."""
    by = simulated.groupBy("seed", "mode", "block", "slice").agg(F.avg("wp").alias("wp"))
    return by.join(F.broadcast(exact), "slice").groupBy("seed", "mode", "block").agg(F.avg(F.abs(F.col("wp") - F.col("win_rate"))).alias("mean_gap"))


def over_seeds(gap_rows: DataFrame) -> DataFrame:
    """Least, mean and greatest gap of each mode over the seeds, and whether it is the best on average."""
    by = gap_rows.groupBy("mode", "block").agg(F.min("mean_gap").alias("least"), F.avg("mean_gap").alias("mean"), F.max("mean_gap").alias("greatest"))
    return by.withColumn("best", F.col("mean") == F.min("mean").over(Window.partitionBy()))


def claims(gap_rows: DataFrame) -> DataFrame:
    """One row that reads ``gaps`` over the seeds.

    ``best_block``: the block length of least mean gap; ``closed``: the share of single-ball
    blocks' gap that it closes; ``seeds_in_order``: seeds in which blocks of 20 beat blocks
    of 40; ``separated``: whether the best mean is below every seed's single-ball gap;
    ``resolved``: both, by a majority of seeds; ``scattered_share``: the part of the best
    blocks' closure that scattered donors reproduce.
    """
    mode = lambda name, k: (F.col("mode") == name) & (F.col("block") == k)
    pick = lambda where: F.max(F.when(where, F.col("mean_gap")))
    seeds = gap_rows.groupBy("seed").agg(pick(mode("block", 1)).alias("one"), pick(mode("block", 20)).alias("k20"), pick(mode("block", 40)).alias("k40"), pick(mode("scattered", SCATTERED_K)).alias("scattered"))
    sums = seeds.agg(F.count("*").alias("seeds"), F.count_if(F.col("k20") < F.col("k40")).alias("seeds_in_order"), F.min("one").alias("least_one"), F.avg("one").alias("mean_one"), F.avg("scattered").alias("mean_scattered"))
    means = gap_rows.filter("mode = 'block'").groupBy("block").agg(F.avg("mean_gap").alias("mean"))  # a row a length
    best = means.agg(F.min(F.struct("mean", "block")).alias("best")).select(F.col("best.block").alias("best_block"), F.col("best.mean").alias("best_gap"))
    gained = F.col("mean_one") - F.col("best_gap")
    rows = sums.crossJoin(best).withColumns({"closed": F.try_divide(gained, F.col("mean_one")), "separated": F.col("best_gap") < F.col("least_one"), "scattered_share": (F.col("mean_one") - F.col("mean_scattered")) / F.greatest(gained, F.lit(1e-12))})
    resolved = (2 * F.col("seeds_in_order") > F.col("seeds")) & F.col("separated")
    return rows.select("best_block", "closed", "seeds", "seeds_in_order", "separated", resolved.alias("resolved"), "scattered_share")


def fidelity(simulated: DataFrame) -> DataFrame:
    """Total variation of each mode's outcome shares from those of single-ball blocks, the greatest over the seeds."""
    k = range(8)
    sums = simulated.groupBy("seed", "mode", "block").agg(*(F.sum(f"o{i}").alias(f"o{i}") for i in k))
    total = sum((F.col(f"o{i}") for i in k), F.lit(0))
    shares = sums.select("seed", "mode", "block", *((F.col(f"o{i}") / total).alias(f"s{i}") for i in k))
    one = shares.filter("mode = 'block' and block = 1").select("seed", *(F.col(f"s{i}").alias(f"t{i}") for i in k))
    tv = sum((F.abs(F.col(f"s{i}") - F.col(f"t{i}")) for i in k), F.lit(0.0)) * 0.5
    return shares.join(F.broadcast(one), "seed").groupBy("mode", "block").agg(F.max(tv).alias("tv"))
