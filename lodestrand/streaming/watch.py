"""Watching for changes: which native events count, what a trigger scans, how long a loop waits, and a folder's worker.

Sequential rules run over rows in key and time order, as they come out of a sort: a key's history passes through a task without
being gathered in it. The same steps drive streams, with the state kept by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.display import cli_delays_s
from .debounce import debounced


def ordered_fold(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], list[tuple]]) -> DataFrame:
    """step(state, row) for each row of a key in order, giving output rows; start makes a key's state. Ties of ``order`` should be settled by it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for pdf in frames:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                if row[0] != last:
                    last, state = row[0], start()
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    rows = df.select(key, *(c for c in df.columns if c != key))
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def counted_events(events: DataFrame, ignored: list[str]) -> DataFrame:
    """Events (key, at, kind, path) that may mean a change: no reads, none below an ignored prefix; ``lost`` where the watcher can't say what happened."""
    below = F.lit(False)
    for prefix in ignored:
        below = below | P.under(F.col("path"), F.lit(prefix))
    kept = events.where((F.col("kind") != "access") & ~F.coalesce(below, F.lit(False)))
    return kept.withColumn("lost", F.col("kind").isin("any", "other", "error"))


def triggers(events: DataFrame, ignored: list[str], quiet_ms: int, longest_ms: int) -> DataFrame:
    """(key, started_ms, ended_ms, events, lost, paths): debounced bursts of the events that count, with the paths they named, sorted."""
    kept = counted_events(events, ignored).select("key", "at", "lost", "path")
    bursts = debounced(kept, "key", "at", "lost", quiet_ms, longest_ms)
    # the burst of an event is the last one that began by then: one sort of both, no join by ranges
    marks = bursts.select("key", F.col("started_ms").alias("at"), F.lit(None).cast("string").alias("path"), F.col("started_ms").alias("_b"), F.lit(0).alias("_o"), "ended_ms", F.col("events").alias("n"), "lost")
    rows = kept.select("key", "at", "path", F.lit(None).cast("long").alias("_b"), F.lit(1).alias("_o"), F.lit(None).cast("long").alias("ended_ms"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("lost"))
    last = F.last("_b", ignorenulls=True).over(Window.partitionBy("key").orderBy("at", "_o").rowsBetween(Window.unboundedPreceding, 0))
    placed = marks.unionByName(rows).withColumn("started_ms", last)
    return placed.groupBy("key", "started_ms").agg(
        F.max("ended_ms").alias("ended_ms"), F.max("n").alias("events"), F.max("lost").alias("lost"), F.array_sort(F.collect_set("path")).alias("paths")
    ).select("key", "started_ms", "ended_ms", "events", "lost", "paths")


@dataclass
class _Watch:
    next_periodic: int | None = None
    next_fallback: int | None = None
    degraded: bool = False


SCANS = "key long, at long, event string, native_events long, whole boolean, degraded boolean"


def watch_scans(ticks: DataFrame, rescan_ms: int, fallback_ms: int) -> DataFrame:
    """(key, at, event, native_events, whole, degraded): the scans a watch loop runs.

    ticks: (key, at, events, lost, watched), one for each look at the watcher: how many events its trigger had (0 for none), whether some were
    lost, and at a key's first tick whether there is a watcher at all. A periodic scan comes first, then the fallback of a degraded watcher, then a
    trigger's; it covers the whole root unless a trigger alone, without loss, names its paths.
    """

    def step(s: _Watch, row: tuple) -> list[tuple]:
        key, at, events, lost, watched = row
        if s.next_periodic is None:
            s.next_periodic, s.next_fallback, s.degraded = at + rescan_ms, at + fallback_ms, not watched
        s.degraded = s.degraded or bool(events and lost)
        periodic, fallback = at >= s.next_periodic, s.degraded and at >= s.next_fallback
        if not events and not periodic and not fallback:
            return []
        if periodic:
            s.next_periodic = at + rescan_ms
        if fallback:
            s.next_fallback = at + fallback_ms
        name = "periodic_scan" if periodic else "fallback_scan" if fallback else "watch_scan"
        return [(key, at, name, events, bool(periodic or fallback or lost), s.degraded)]

    return ordered_fold(ticks.select("key", "at", "events", "lost", "watched"), "key", ["at"], SCANS, _Watch, step)


def loop_delays(passes: DataFrame, key: str, order: list[str], ok: Column, interval_s: int, most_s: int) -> DataFrame:
    """Each pass of a continuous sync with how long the loop waits after it and whether a local change may end the wait early.

    The interval after a success; after failures 1 s, doubling with each in a row up to ``most_s``, and then no change ends the wait.
    """
    w = Window.partitionBy(key).orderBy(*order)
    run = passes.withColumn("_ok", ok).withColumn("_run", F.sum(F.col("_ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    failures = F.row_number().over(Window.partitionBy(key, "_run", "_ok").orderBy(*order))
    delay = F.when(F.col("_ok"), F.lit(interval_s)).otherwise(cli_delays_s(failures, F.lit(most_s)))
    return run.withColumn("delay_s", delay.cast("bigint")).withColumn("wakes_early", F.col("_ok")).drop("_ok", "_run")


@dataclass
class _Worker:
    paused: bool = False
    failures: int = 0
    next: int | None = None


WORK = "key long, at long, command string, ran boolean, status string, failures long, retry_at long"


def worker_states(commands: DataFrame, interval_ms: int) -> DataFrame:
    """(key, at, command, ran, status, failures, retry_at) after each message or due tick of a folder's worker.

    commands: (key, at, seq, command, ok): sync, pause, resume, stop, tick, or changed (a tick at which the watcher saw a change); ok tells
    how a cycle would end. A paused folder refuses to sync; a tick runs a cycle when it is due, and a change does so early unless the last
    cycle failed. After a failure the next comes in 2 s, doubling to 64; after a stop nothing happens.
    """

    def step(s: _Worker, row: tuple) -> list[tuple]:
        key, at, _, command, ok = row
        if s.next is None:
            s.next = at + interval_ms
        if s.next < 0:
            return []
        ran, failed, resumed = False, False, False
        if command == "stop":
            s.next = -1
            return [(key, at, command, False, "stopped", s.failures, None)]
        if command == "pause":
            s.paused = True
        elif command == "resume":
            s.paused, resumed = False, True
        elif command == "sync":
            failed = s.paused
            ran = not s.paused
        elif not s.paused and (at >= s.next or (command == "changed" and s.failures == 0)):
            ran = True
        else:
            return []
        failed = failed or (ran and not ok)
        retry = None
        if failed:
            s.failures += 1
            s.next = at + 1000 * 2 ** min(s.failures, 6)
            retry = None if s.paused else s.next
        else:
            s.failures, s.next = 0, at if resumed else at + interval_ms
        status = "paused" if s.paused else "error" if failed else "checked" if ran else "idle"
        return [(key, at, command, ran, status, s.failures, retry)]

    return ordered_fold(commands.select("key", "at", "seq", "command", "ok"), "key", ["at", "seq"], WORK, _Worker, step)


def transfer_view(events: DataFrame) -> DataFrame:
    """What the observer of transfers shows of each folder: (folder, phase, path, peer_seen_at, sent, received, activities) from (folder, seq, at, event, path, bytes).

    The newest event sets phase and path; ``peer_seen`` tells when the other device was last there; a file's events are activities. Works on a
    batch and, in update mode, on a stream.
    """
    files = F.col("event").isin("file_sent", "file_received")
    moved = lambda e: F.coalesce(F.sum(F.when(F.col("event") == e, F.col("bytes"))), F.lit(0))
    newest = F.max(F.struct("seq", "event", "path")).alias("_n")
    return events.groupBy("folder").agg(
        newest, F.max(F.when(F.col("event") == "peer_seen", F.col("at"))).alias("peer_seen_at"), moved("file_sent").alias("sent"), moved("file_received").alias("received"), F.count_if(files).alias("activities")
    ).select("folder", F.col("_n.event").alias("phase"), F.col("_n.path").alias("path"), "peer_seen_at", "sent", "received", "activities")
