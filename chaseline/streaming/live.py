"""Live scoring: a stream of states joined to a solved surface, and stateful credit of each ball.

An extension beyond the batch operators: the surface is static and of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import winprob

CREDIT = "match_id long, ball_index int, batter string, wpa double"


def scored_stream(states: DataFrame, surface: DataFrame) -> DataFrame:
    """A stream of ``match_id, ball_index, batter, b, w, r, ts`` with the win probability of its states, ended ones too.

    A state beyond the surface stops the stream with an error that names it.
    """
    return winprob.with_wp(states, surface)


def _credit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values("ball_index")
    last = state.get if state.exists else None
    out = []
    for row in rows.itertuples():
        if last is not None and row.ball_index > last[0]:
            out.append((key[0], last[0], last[1], row.wp - last[2]))
        if last is None or row.ball_index > last[0]:
            last = (int(row.ball_index), row.batter, float(row.wp))
    state.update(last)
    state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs() + 1) + 3_600_000)
    yield pd.DataFrame(out, columns=["match_id", "ball_index", "batter", "wpa"])


def credited_stream(scored: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Credit of a ball once the next one arrives; balls older than the last one seen are dropped as late."""
    marked = scored.withWatermark("ts", lateness).select("match_id", "ball_index", "batter", "wp", "ts")
    return marked.groupBy("match_id").applyInPandasWithState(_credit, CREDIT, "ball_index int, batter string, wp double", "append", GroupStateTimeout.EventTimeTimeout)


def runs_by_window(balls: DataFrame, width: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Runs and balls in event-time windows."""
    return balls.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "match_id").agg(F.sum("runs").alias("runs"), F.count("*").alias("balls")).select(F.col("w.start").alias("start"), "match_id", "runs", "balls")
