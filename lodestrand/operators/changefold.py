"""Applying a stream of inserts, updates and deletes.

A commutative fold. Every change is a struct (instant, first delivery, operation, payload); the state
of a key is the greatest of its structs. Taking a maximum doesn't depend on the order of arrival, and
a repeated change doesn't alter it, so batches may come late, twice or in any order, and base rows
enter the fold as further structs. Deletes win or lose by the same rule and stay in the state as
tombstones, so a change that arrives after a later delete cannot bring the key back.

Both aggregations combine on the map side: a key with a third of all rows leaves each map task as its
distinct changes, and the second stage as one row per task.

Defined results
* null key: names no record, left out.
* null or unknown operation: does nothing. Letter case and blanks around an operation don't count.
* null instant: before all others. null sequence: before all others at that instant.
* rows equal in all but the sequence: one change, at its smallest sequence.
* changes equal in instant and sequence: the one with the greater (operation, payload).
* null payload: kept as null. Empty feed: empty state. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tidy

UPSERTS, DELETES = ("adopt",), ("delete",)


def distinct_changes(
    feed: DataFrame,
    key: str,
    instant: str,
    sequence: str,
    operation: str,
    same: Sequence[str],
    base: DataFrame | None = None,
    upserts: Sequence[str] = UPSERTS,
    deletes: Sequence[str] = DELETES,
) -> DataFrame:
    """Repeated deliveries reduced to (key, instant, operation, *same) with their first sequence."""
    columns = [key, instant, operation, *same]
    rows = feed.select(key, instant, tidy(F.col(operation)).alias(operation), *same, sequence)
    if base is not None:
        rows = rows.unionByName(base.select(*columns, sequence))
    rows = rows.where(F.col(key).isNotNull() & F.col(operation).isin(*upserts, *deletes))
    return rows.groupBy(*columns).agg(F.min(sequence).alias(sequence))


def fold_changes(
    feed: DataFrame,
    key: str,
    instant: str,
    sequence: str,
    operation: str,
    payload: Sequence[str],
    same: Sequence[str] = (),
    base: DataFrame | None = None,
    upserts: Sequence[str] = UPSERTS,
    deletes: Sequence[str] = DELETES,
) -> DataFrame:
    """State after all changes, one row per key, tombstones included.

    same: the further columns by which a repeated delivery is told from a new change.
    base: rows of ``frontier`` of earlier feeds.
    """
    apart = [*payload, *(c for c in same if c not in payload)]
    changes = distinct_changes(feed, key, instant, sequence, operation, apart, base, upserts, deletes)
    last = F.max(F.struct(instant, sequence, operation, *payload)).alias("_last")
    folded = changes.groupBy(key).agg(last)
    return folded.select(
        key, *(F.col(f"_last.{c}").alias(c) for c in (instant, sequence, operation, *payload)),
        F.col(f"_last.{operation}").isin(*deletes).alias("deleted"),
    )


def frontier(
    feed: DataFrame,
    key: str,
    instant: str,
    sequence: str,
    operation: str,
    payload: Sequence[str],
    same: Sequence[str] = (),
    base: DataFrame | None = None,
) -> DataFrame:
    """What later folds need: each key's changes at its last instant, so that a late copy of one of them is known.

    Folding feed A, then feed B on A's frontier, equals folding A and B at once, unless B repeats at the key's last
    instant a change that A never saw; then both are kept.
    """
    apart = [*payload, *(c for c in same if c not in payload)]
    changes = distinct_changes(feed, key, instant, sequence, operation, apart, base)
    last = changes.groupBy(F.col(key).alias("_key")).agg(F.max(instant).alias("_at"))
    kept = (F.col(key) == F.col("_key")) & F.col(instant).eqNullSafe(F.col("_at"))
    return changes.join(last, kept).drop("_key", "_at")


def live(state: DataFrame, *columns: str) -> DataFrame:
    return state.where(~F.col("deleted")).select(*columns)
