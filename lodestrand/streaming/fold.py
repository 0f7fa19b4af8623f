"""Folding event streams: observers' views, live counts, snapshots by revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_view(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Each key's newest values. Works on a batch and, in update mode, on a stream: the greatest order wins, so late events change nothing."""
    return events.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("_v")).select(key, "_v.*")


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by event-time window; on a stream, windows close when the watermark passes them."""
    at = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return at.groupBy(F.window(ts, width, slide), kind).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 day") -> DataFrame:
    at = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return at.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events"))


def changed_revisions(view: DataFrame, seen: DataFrame, key: str, revision: str) -> DataFrame:
    """What a poll sends: rows whose revision differs from the one last sent."""
    old = seen.select(key, F.col(revision).alias("_r"))
    return view.join(old, key, "left").where(~F.col(revision).eqNullSafe(F.col("_r"))).drop("_r")


def run_batch(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drive a stream over all that is there into a table in memory: for small inputs, as tests, and for streams without timers, which never end."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
