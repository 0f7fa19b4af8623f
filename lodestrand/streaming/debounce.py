"""Bursts of events: closed after a quiet time, after a longest delay, or at once on a loss.

``bursts`` gives a batch's bursts by the quiet time alone, as a window expression. ``debounced`` adds the
longest delay, which depends on where the burst before was cut, and so is a fold in time order; in a batch it runs
over each key's bursts, as a stream it is a stateful processor with timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BURST = "key long, started_ms long, ended_ms long, events long, lost boolean"


def bursts(events: DataFrame, key: str, at_ms: str, quiet_ms: int) -> DataFrame:
    """(key, started_ms, ended_ms, events): events less than quiet_ms apart belong together."""
    w = Window.partitionBy(key).orderBy(at_ms)
    new = F.coalesce(F.col(at_ms) - F.lag(at_ms).over(w) >= quiet_ms, F.lit(True))
    numbered = events.withColumn("_b", F.sum(new.cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(F.col(key).alias("key"), "_b").agg(F.min(at_ms).alias("started_ms"), F.max(at_ms).alias("ended_ms"), F.count("*").alias("events")).drop("_b")


def _fold(times: list[int], lost: list[bool], quiet_ms: int, longest_ms: int, state: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Closed bursts and the open one, (first, last, count)."""
    closed = []
    for t, loss in zip(times, lost, strict=True):
        if state and (t >= state[1] + quiet_ms or t >= state[0] + longest_ms):
            closed.append((*state, False))
            state = None
        state = (state[0], t, state[2] + 1) if state else (t, t, 1)
        if loss:
            closed.append((*state, True))
            state = None
    return closed, state


def debounced(events: DataFrame, key: str, at_ms: str, lost: str, quiet_ms: int, longest_ms: int) -> DataFrame:
    """All bursts of a batch. A quiet gap and a loss end a burst wherever it began, which a window expression tells; only runs that last longer
    than the longest delay are folded, each by itself and never a key's whole history."""
    rows = events.select(F.col(key).alias("key"), F.col(at_ms).alias("at"), F.col(lost).alias("lost"))
    w = Window.partitionBy("key").orderBy("at", "lost")
    new = F.coalesce((F.col("at") - F.lag("at").over(w) >= quiet_ms) | F.lag("lost").over(w), F.lit(True))
    numbered = rows.withColumn("burst", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    burst = Window.partitionBy("key", "burst")
    timed = numbered.withColumn("_long", F.max("at").over(burst) - F.min("at").over(burst) >= longest_ms)
    short = timed.where("NOT _long").groupBy("key", "burst").agg(F.min("at").alias("started_ms"), F.max("at").alias("ended_ms"), F.count("*").alias("events"), F.max("lost").alias("lost")).drop("burst")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "lost"])
        closed, state = _fold(pdf["at"].tolist(), pdf["lost"].tolist(), quiet_ms, longest_ms, None)
        done = [*closed, *([(*state, False)] if state else [])]
        return pd.DataFrame([(pdf["key"].iloc[0], *r) for r in done], columns=["key", "started_ms", "ended_ms", "events", "lost"])

    return short.unionByName(timed.where("_long").drop("_long").groupBy("key", "burst").applyInPandas(fold, BURST))


def debounce_stream(events: DataFrame, key: str, at_ms: str, lost: str, quiet_ms: int, longest_ms: int) -> DataFrame:
    """The same over a stream: a burst that goes quiet is closed by a processing-time timer."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], *held, False)], columns=["key", "started_ms", "ended_ms", "events", "lost"])
            return
        pdf = pd.concat(list(frames)).sort_values(["at", "lost"])
        closed, held = _fold(pdf["at"].tolist(), pdf["lost"].tolist(), quiet_ms, longest_ms, tuple(held) if held else None)
        if held:
            state.update(held)
            state.setTimeoutDuration(quiet_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(k[0], *r) for r in closed], columns=["key", "started_ms", "ended_ms", "events", "lost"])

    rows = events.select(F.col(key).alias("key"), F.col(at_ms).alias("at"), F.col(lost).alias("lost"))
    return rows.groupBy("key").applyInPandasWithState(step, BURST, "first long, last long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
