"""Serial dependence: lag profiles, demeaning, intraclass correlation and a permutation null."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import mixed
from ..session import cut
from .leverage import LAGS, PARTNERSHIP_LAGS

VARIANTS = {"state": None, "state+innings": ["match_id"], "state+partnership": ["match_id", "part"]}
SCOPES = {"innings": (["match_id"], LAGS), "partnership": (["match_id", "part"], PARTNERSHIP_LAGS)}
SERIES = ("runs", "wkt")


def demeaned(rows: DataFrame, value: str, keys: list[str], more: list[str]) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*more, *keys))


def lag_profile(rows: DataFrame, value: str = "runs", more: tuple[str, ...] = ()) -> DataFrame:
    """``variant, scope, lag, r, n``: pooled correlation at each lag within innings and partnerships.

    Fewer than 30 pairs or no variance give null. ``more`` keeps groups apart, such as replicates.
    """
    out = []
    for variant, keys in VARIANTS.items():
        series = rows if keys is None else rows.withColumn(value, demeaned(rows, value, keys, list(more)))
        for scope, (keys2, lags) in SCOPES.items():
            order = Window.partitionBy(*more, *keys2).orderBy("ball_index")
            later = F.array(*(F.struct(F.lit(k).alias("lag"), F.lead(value, k).over(order).alias("later")) for k in lags))
            pairs = series.withColumn("laters", later).select(*more, F.col(value).alias("x"), F.inline("laters")).filter("later is not null")
            sums = pairs.groupBy(*more, "lag").agg(F.count("*").alias("n"), F.corr("x", "later").alias("r"))
            out.append(sums.select(*more, F.lit(variant).alias("variant"), F.lit(scope).alias("scope"), "lag", F.when(F.col("n") >= 30, F.nanvl("r", F.lit(None))).alias("r"), "n"))
    return reduce(DataFrame.unionByName, out)


def icc(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """One-way intraclass correlation of unbalanced groups."""
    groups = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"))
    t = groups.agg(F.count("*").alias("k"), F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    msb = (F.col("q") - F.col("total") * F.col("grand") * F.col("grand")) / (F.col("k") - 1)
    msw = F.col("ssw") / (F.col("total") - F.col("k"))
    n0 = (F.col("total") - F.col("n2") / F.col("total")) / (F.col("k") - 1)
    return t.select((F.try_divide(msb - msw, msb + (n0 - 1) * msw)).alias("icc"), F.col("k").alias("groups"))


#: Variant, scope and lag of each figure of a profile, in the order of ``_pair_sums``.
_FIGURES = [(v, s, lag) for v in VARIANTS for s, (_, lags) in SCOPES.items() for lag in lags]
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _pair_sums(x: np.ndarray, part: np.ndarray) -> np.ndarray:
    """``n, x, y, xx, yy, xy`` of the pairs of each variant, scope and lag, for each row of ``x`` (one innings, shuffled): figures by sums by rows.

    Sums of ``x`` alone are products with the pairs' marks; those of ``x`` less its mean follow from them.
    """
    size = x.shape[1]
    same = {lag: part[: max(size - lag, 0)] == part[lag:] for lag in LAGS}
    marks = []
    for scope, (_, lags) in SCOPES.items():
        for lag in lags:
            pairs = same[lag] if scope == "partnership" else np.ones(len(same[lag]), dtype=bool)
            head, tail = np.zeros(size), np.zeros(size)
            head[: len(pairs)] = tail[size - len(pairs) :] = pairs
            marks += [head, tail]
    marks = np.stack(marks, axis=1)
    n = marks[:, ::2].sum(axis=0)[:, None]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    length = np.diff(np.append(starts, size))

    def sums(z: np.ndarray) -> tuple[np.ndarray, ...]:
        one, two = (z @ marks).T, ((z * z) @ marks).T
        products = {lag: z[:, : len(same[lag])] * z[:, size - len(same[lag]) :] for lag in LAGS}
        both = [products[lag] @ same[lag] if scope == "partnership" else products[lag].sum(axis=1) for scope, (_, lags) in SCOPES.items() for lag in lags]
        return one[::2], one[1::2], two[::2], two[1::2], np.stack(both)

    raw, m = sums(x), x.mean(axis=1)
    a, b, aa, bb, ab = raw
    less = (a - n * m, b - n * m, aa - 2 * m * a + n * m * m, bb - 2 * m * b + n * m * m, ab - m * (a + b) + n * m * m)
    within = sums(x - np.repeat(np.add.reduceat(x, starts, axis=1) / length, length, axis=1))
    out = np.empty((3, len(n), 6, len(x)))
    out[:, :, 0] = n
    for i, found in enumerate((raw, less, within)):
        for k, one in enumerate(found):
            out[i, :, k + 1] = one
    return out.reshape(len(_FIGURES), 6, len(x))


def _profile_sums(rows: DataFrame, reps: int, values: tuple[str, ...], seed: int, observed: bool) -> DataFrame:
    """``series, rep, variant, scope, lag`` and the sums of their pairs; ``observed``: replicate -1 too, the values in their own order.

    A task gives one row a figure and replicate, whatever the innings.
    """
    entry = F.sort_array(F.collect_list(F.struct("ball_index", "part", *values)))
    innings = rows.groupBy("match_id").agg(entry.alias("e")).select("match_id", *(F.col(f"e.{c}").alias(c) for c in ("ball_index", "part", *values)))
    which = np.arange(-1 if observed else 0, reps)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((len(_FIGURES), 6, len(values) * len(which))), False
        for batch in batches:
            any_ = any_ or len(batch) > 0
            matches, ends = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            balls, parts, *series = (batch.column(i).values.to_numpy(zero_copy_only=False) for i in range(1, 3 + len(values)))
            for match, a, b in zip(matches, ends[:-1], ends[1:], strict=True):
                keys = mixed(mixed(mixed(np.int64(seed), match), np.arange(reps))[:, None], balls[None, a:b].astype(np.int64))
                shift = int(b - a).bit_length()  # keys have 31 bits; balls are in order, so their places break ties
                order = np.sort((keys << shift) | np.arange(b - a), axis=1) & ((1 << shift) - 1)
                if observed:
                    order = np.concatenate([np.arange(b - a)[None, :], order])
                total += _pair_sums(np.concatenate([one[a:b].astype(float)[order] for one in series]), parts[a:b])
        if any_:
            size = len(which) * len(_FIGURES)
            columns = [np.repeat(values, size), np.tile(np.tile(which, len(_FIGURES)), len(values)), *(np.tile(np.repeat([f[k] for f in _FIGURES], len(which)), len(values)) for k in range(3))]
            sums = total.reshape(len(_FIGURES), 6, len(values), len(which)).transpose(1, 2, 0, 3).reshape(6, -1)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *map(pa.array, sums)], ["series", "rep", "variant", "scope", "lag", *_SUMS])

    parts = innings.mapInArrow(task, "series string, rep long, variant string, scope string, lag long, " + ", ".join(f"{c} double" for c in _SUMS))
    return parts.groupBy("series", "rep", "variant", "scope", "lag").agg(*(F.sum(c).alias(c) for c in _SUMS))


def _correlation() -> Column:
    """The correlation of pairs from their sums; null for fewer than 30 or no variance."""
    n, spread = F.col("n"), lambda a, aa: F.col("n") * F.col(aa) - F.col(a) * F.col(a)
    both = F.sqrt(F.greatest(spread("x", "xx"), F.lit(0.0))) * F.sqrt(F.greatest(spread("y", "yy"), F.lit(0.0)))
    return F.when((n >= 30) & (both > 1e-12), (n * F.col("xy") - F.col("x") * F.col("y")) / both)


def null_profiles(rows: DataFrame, reps: int, values: tuple[str, ...] = SERIES, seed: int = 0) -> DataFrame:
    """``series, rep, variant, scope, lag, r``: lag profiles of ``reps`` shuffles of the values within each innings.

    ``rows (match_id, ball_index, part, values)``; ``part`` doesn't fall in an innings. Rows
    are gathered to one an innings (at most 120 balls); each task gives the sums of
    its innings for each replicate, so what is shuffled doesn't grow with the replicates'
    copies. The order of a shuffle is that of a hash of seed, match, replicate and ball.
    """
    return _profile_sums(rows, reps, values, seed, False).select("series", "rep", "variant", "scope", "lag", _correlation().alias("r"))


def permutation_null(rows: DataFrame, reps: int, values: tuple[str, ...] = SERIES, seed: int = 0) -> DataFrame:
    """Observed profile of each series with the mean and the 2.5 and 97.5 percentiles of the profile of shuffled ones; one pass over the innings finds all."""
    keys = ["series", "variant", "scope", "lag"]
    found = cut(_profile_sums(rows, reps, values, seed, True).select(*keys, "rep", _correlation().alias("r"), F.col("n").cast("long").alias("n")))
    bands = found.filter("rep >= 0").groupBy(*keys).agg(F.avg("r").alias("null_mean"), F.percentile("r", F.lit(0.025)).alias("null_lo"), F.percentile("r", F.lit(0.975)).alias("null_hi"))
    seen = found.filter("rep < 0 and n > 0").select("variant", "scope", "lag", "r", "n", "series")
    flag = F.when(F.col("r") > F.col("null_hi"), "above").when(F.col("r") < F.col("null_lo"), "below").otherwise("inside")
    return seen.join(bands, keys).withColumn("flag", flag)


def dependence_verdict(profile: DataFrame, groups: DataFrame, series: str = "runs") -> DataFrame:
    """One row that reads the profile of a series beside its null, and the ``groups (scope, icc)`` beside it.

    ``beyond_innings``: the raw lag-1 correlation within innings exceeds its band;
    ``survives_innings``, ``survives_partnership``: so it does without innings or partnership
    means; ``share``: part of the raw one that its null's mean explains; ``decays``: the
    excess over the null at lags 20 and 30 is less than half of that at 1.
    """
    at = lambda variant, scope, lag: (F.col("variant") == variant) & (F.col("scope") == scope) & (F.col("lag") == lag)
    pick = lambda where, value: F.max(F.when(where, value))
    raw, above, excess = at("state", "innings", 1), F.col("flag") == "above", F.col("r") - F.col("null_mean")
    row = profile.filter(F.col("series") == series).agg(
        pick(raw, above).alias("beyond_innings"), pick(at("state+innings", "innings", 1), above).alias("survives_innings"), pick(at("state+partnership", "partnership", 1), above).alias("survives_partnership"),
        pick(raw, F.col("r")).alias("lag1"), pick(raw, F.col("null_mean")).alias("null_centre"), pick(raw, excess).alias("excess_lag1"),
        F.avg(F.when((F.col("variant") == "state") & (F.col("scope") == "innings") & F.col("lag").isin(20, 30), excess)).alias("excess_tail"),
    )
    share = F.when(F.col("lag1") > 0, F.least(F.greatest(F.col("null_centre") / F.col("lag1"), F.lit(0.0)), F.lit(1.0)))
    label = F.when(~F.col("beyond_innings"), "heterogeneity-only").when(F.col("survives_partnership"), "sequential").otherwise("partnership-latent")
    decays = (F.col("excess_lag1") > 0) & (F.col("excess_tail") < 0.5 * F.col("excess_lag1"))
    wide = groups.agg(*(F.max(F.when(F.col("scope") == s, F.col("icc"))).alias(f"icc_{s}") for s in SCOPES))
    return row.withColumns({"share": share, "decays": decays, "label": label}).crossJoin(wide)  # two single rows
