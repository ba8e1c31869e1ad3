"""Column expressions over chase states (b balls left, w wickets in hand, r runs required)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BALLS, WICKETS, TIE = 120, 10, 0.5
#: Outcomes in the order in which probabilities are stored and summed.
OUTCOMES = ["0", "1", "2", "3", "4", "5", "6", "W"]
#: Bin edges of the required run rate, for estimation and for diagnostics.
RRR_EDGES = [6.0, 8.0, 10.0, 12.0, 15.0]
FINE_EDGES = [0, 6, 8, 10, 12, 14, 16, 18, 22, 40]
RRR_BINS, PHASES = len(RRR_EDGES) + 1, ("powerplay", "middle", "death")
DRIFT_WIDTH = 0.02


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def phase(over: Column | str) -> Column:
    over = _c(over)
    return F.when(over < 6, "powerplay").when(over < 15, "middle").otherwise("death")


def phase_index(name: Column | str) -> Column:
    name = _c(name)
    return F.when(name == "powerplay", 0).when(name == "middle", 1).otherwise(2)


def count_edges(x: Column | str, edges: list[float]) -> Column:
    """How many edges are at most x: a left-closed bin number."""
    x = _c(x)
    return reduce(lambda a, e: a + (x >= F.lit(float(e))).cast("int"), edges, F.lit(0))


def rrr_bin(rrr: Column | str) -> Column:
    return count_edges(rrr, RRR_EDGES)


def cell_id(bin_: Column | str, w: Column | str, phase_no: Column | str) -> Column:
    return (_c(bin_) * 11 + _c(w)) * 3 + _c(phase_no)


def slice_right_closed(rrr: Column | str) -> Column:
    """Number of the fine slice, right-closed; null beyond the last edge."""
    rrr = _c(rrr)
    out = F.when(rrr < FINE_EDGES[0], None)
    for i, edge in enumerate(FINE_EDGES[1:]):
        out = out.when(rrr <= float(edge), i)
    return out


def slice_left_closed(rrr: Column | str) -> Column:
    """Number of the fine slice, left-closed; values beyond the last edge count in the last slice."""
    return F.greatest(F.least(count_edges(rrr, FINE_EDGES) - 1, F.lit(len(FINE_EDGES) - 2)), F.lit(0))


def wicket_group(w: Column | str) -> Column:
    w = _c(w)
    return F.when(w >= 7, "7-10 in hand").when(w >= 4, "4-6 in hand").otherwise("1-3 in hand")


def probability_bin(p: Column | str, bins: int = 15) -> Column:
    """Equal-width bin of a probability, left-closed, by explicit edges i / bins."""
    return count_edges(p, [i / bins for i in range(1, bins)])


def drift_bin(wp: Column | str) -> Column:
    return F.floor(F.least(F.greatest(_c(wp), F.lit(0.0)), F.lit(1.0)) / F.lit(DRIFT_WIDTH))


def runs_of(outcome: Column | str) -> Column:
    outcome = _c(outcome)
    return F.when(outcome == "W", 0.0).otherwise(outcome.cast("double"))


def outcome_index(outcome: Column | str) -> Column:
    outcome = _c(outcome)
    return F.when(outcome == "W", 7).otherwise(outcome.cast("int"))


def transition(outcome: Column | str) -> dict[str, Column]:
    """The state after a ball with this outcome."""
    outcome = _c(outcome)
    return {"b": F.col("b") - 1, "w": F.col("w") - (outcome == "W").cast("int"), "r": F.col("r") - runs_of(outcome).cast("int")}


def terminal(b: Column | str, w: Column | str, r: Column | str) -> Column:
    """Value of an ended chase, null while it lives. A reached target is looked at first."""
    b, w, r = _c(b), _c(w), _c(r)
    return F.when(r <= 0, 1.0).when(w == 0, 0.0).when((b == 0) & (r == 1), TIE).when(b == 0, 0.0)


def ahead_of_rate(target: Column | str) -> Column:
    """Whether the current run rate beats the required one, cross-multiplied."""
    return (_c(target) - F.col("r")) * F.col("b") > F.col("r") * (F.lit(BALLS) - F.col("b"))
