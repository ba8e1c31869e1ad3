"""Exact win probability by backward induction, as a fold over arrays.

Layer b holds the values of all states with b balls left: ``10 * r_max`` numbers, index
``(w - 1) * r_max + r - 1``. Each layer comes from the one before, so the surface is one
``aggregate`` over ``sequence(1, 120)``; its size is fixed, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chase
from ..session import cut


def greatest_r(*frames: DataFrame) -> int:
    """One more than the most runs required in any of the ball tables."""
    return max(frame.agg(F.max("r")).first()[0] or 0 for frame in frames) + 1


def _layer(r_max: int) -> str:
    """SQL of the next layer from ``last(acc)``, ``cells`` and ``b``."""
    w, r = f"(i div {r_max} + 1)", f"(i % {r_max} + 1)"
    rate = f"(6.0D * {r} / b)"
    bins = " + ".join(f"if({rate} >= {e}D, 1, 0)" for e in chase.RRR_EDGES)
    stage = "if((120 - b) div 6 < 6, 0, if((120 - b) div 6 < 15, 1, 2))"
    cell = f"cells[cast((({bins}) * 11 + {w}) * 3 + {stage} as int)]"
    terms = ["0.0D"]
    for k in range(7):
        terms.append(f"p[{k}] * if({r} <= {k}, 1.0D, v[cast(i - {k} as int)])")
    terms.append(f"p[7] * if({w} = 1, 0.0D, v[cast(i - {r_max} as int)])")
    state = f"transform(array({cell}), p -> {' + '.join(terms)})[0]"  # looks the state's distribution up once
    return f"transform(array(element_at(acc, -1)), v -> transform(sequence(0, {10 * r_max - 1}), i -> {state}))[0]"


def solve(grid: DataFrame, r_max: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, b, w, r, wp`` for all live states of each model in ``grid`` (see ``outcomes.full_grid``).

    Models are independent rows, solved in parallel. The surface is kept, for its few rows
    cost far more to find than to hold.
    """
    size = chase.RRR_BINS * 33
    entries = F.map_from_entries(F.collect_list(F.struct("cell_id", "p")))
    models = (grid.groupBy(*keys) if keys else grid.groupBy()).agg(entries.alias("found"))
    by_id = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("found", i))
    models = models.select(*keys, by_id.alias("cells"))
    first = f"array(transform(sequence(0, {10 * r_max - 1}), i -> if(i % {r_max} = 0, {chase.TIE}D, 0.0D)))"
    fold = f"aggregate(sequence(1, {chase.BALLS}), {first}, (acc, b) -> concat(acc, array({_layer(r_max)})))"
    layers = models.select(*keys, F.posexplode(F.expr(fold)).alias("b", "layer")).filter("b > 0")
    flat = layers.select(*keys, "b", F.posexplode("layer").alias("i", "wp"))
    return cut(flat.select(*keys, "b", F.expr(f"i div {r_max} + 1").cast("int").alias("w"), F.expr(f"i % {r_max} + 1").cast("int").alias("r"), "wp"))


def value(live: Column) -> Column:
    """The value of state ``b, w, r``: a terminal one by rule, a live one from ``live``. Raises on a state that the surface doesn't hold; null if part of the state is."""
    state = F.concat_ws(", ", *(F.concat(F.lit(f"{c} = "), F.col(c).cast("string")) for c in "bwr"))
    known = F.col("b").isNotNull() & F.col("w").isNotNull() & F.col("r").isNotNull()
    beyond = F.raise_error(F.concat(F.lit("no win probability for the state "), state)).cast("double")
    return F.when(known, F.coalesce(chase.terminal("b", "w", "r"), live, beyond))


def with_wp(balls: DataFrame, surface: DataFrame, keys: tuple[str, ...] = (), few: bool = True) -> DataFrame:
    """``balls`` with ``wp`` of their state, see ``value``. The surface has 1200 * r_max rows a model; it is broadcast if models are few, two at most."""
    found = surface.withColumnRenamed("wp", "live_wp")
    return balls.join(F.broadcast(found) if few else found, [*keys, "b", "w", "r"], "left").withColumn("wp", value(F.col("live_wp"))).drop("live_wp")


def children(states: DataFrame, surface: DataFrame) -> DataFrame:
    """Each state of ``b, w, r, p, wp`` with each outcome's probability ``prob`` and value ``next_wp``."""
    named = states.select("b", "w", "r", "wp", F.posexplode("p").alias("ord", "prob"))
    nb, nr = F.col("b") - 1, F.col("r") - F.when(F.col("ord") == 7, 0).otherwise(F.col("ord"))
    nw = F.col("w") - (F.col("ord") == 7).cast("int")
    moved = named.select("*", nb.alias("nb"), nw.alias("nw"), nr.alias("nr"))
    after = surface.select(F.col("b").alias("nb"), F.col("w").alias("nw"), F.col("r").alias("nr"), F.col("wp").alias("live_wp"))
    joined = moved.join(F.broadcast(after), ["nb", "nw", "nr"], "left")
    return joined.withColumn("next_wp", F.coalesce(chase.terminal("nb", "nw", "nr"), "live_wp"))


def inconsistent(states: DataFrame, surface: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """States whose value differs from the expectation of the next ones."""
    means = children(states, surface).groupBy("b", "w", "r", "wp").agg(F.sum(F.col("prob") * F.col("next_wp")).alias("implied"))
    return means.filter(F.abs(F.col("implied") - F.col("wp")) > tolerance)
