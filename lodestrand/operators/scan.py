"""Comparing a fresh scan with the stored index: reuse of hashes, change kinds, counters, retries, collisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.display import retry_delay_ms
from ..runtime import cut
from .ranking import number_rows, running_max

STATE = ("kind", "size", "content_hash", "readonly")
FINGERPRINT = ("kind", "id_namespace", "id_object", "size", "modified_ns", "readonly")
#: What must be equal for a path to count as unchanged.
RECORD = (*FINGERPRINT, "content_hash")


def _same(a: str, b: str, fields: Sequence[str]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def joined(previous: DataFrame, current: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    side = lambda df, n: df.select(*keys, F.struct(F.lit(True).alias("here"), *fields).alias(n))
    return side(previous, "p").join(side(current, "c"), list(keys), "full_outer")


def under_prefixes(rows: DataFrame, keys: Sequence[str], prefixes: DataFrame) -> DataFrame:
    """Keys of the rows at or below one of the prefixes (*group, prefix)."""
    group = [k for k in keys if k != "path"]
    return rows.select(*keys, F.explode(P.ancestors(F.col("path"))).alias("prefix")).join(prefixes, [*group, "prefix"], "left_semi").select(*keys).distinct()


def scan_changes(previous: DataFrame, current: DataFrame, keys: Sequence[str], preserved: DataFrame | None = None) -> DataFrame:
    """(*keys, change, to_path, version): created (also over a tombstone), modified, renamed, deleted, unchanged, preserved.

    A path is unchanged if kind, identity, size, time, permission and content are. A vanished and a new path are one rename if nothing
    else of the step has their kind and identity on its side and they are equal in all of it; the row stands under the old path.
    What vanished under a prefix that couldn't be read (preserved: *group, prefix) is kept and is no end of a rename. version is
    the counter the stored row has (column ``version`` of previous, where there is one), of a rename the old path's, else 0.
    Tombstones of the current scan are absent paths.
    """
    group = [k for k in keys if k != "path"]
    counter = F.col("version") if "version" in previous.columns else F.lit(0)
    before = previous.withColumn("version", F.coalesce(counter.cast("bigint"), F.lit(0)))
    side = lambda df, n, *more: df.select(*keys, F.struct(F.lit(True).alias("here"), *RECORD, *more).alias(n))
    both = side(before, "p", "tombstone", "version").join(side(current.where(~F.col("tombstone")), "c"), list(keys), "full_outer")
    was = F.coalesce(F.col("p.here") & ~F.col("p.tombstone"), F.lit(False))
    is_ = F.col("c.here").isNotNull()
    change = F.when(is_ & ~was, "created").when(was & ~is_, "deleted").when(was & is_, F.when(_same("p", "c", RECORD), "unchanged").otherwise("modified"))
    found = both.withColumn("change", change).where(F.col("change").isNotNull())
    row = F.when(is_, F.col("c")).otherwise(F.struct(F.lit(True).alias("here"), *(F.col(f"p.{f}").alias(f) for f in RECORD)))
    found = cut(found.select(*keys, "change", F.coalesce("p.version", F.lit(0)).alias("version"), row.alias("row")))
    if preserved is not None:
        kept = under_prefixes(found.where("change = 'deleted'"), keys, preserved).withColumn("_kept", F.lit(True))
        found = cut(found.join(kept, list(keys), "left").withColumn("change", F.when((F.col("change") == "deleted") & F.col("_kept"), "preserved").otherwise(F.col("change"))).drop("_kept"))
    gone, came = F.col("change") == "deleted", F.col("change") == "created"
    identity = [F.col(f"row.{f}").alias(f"_{f}") for f in ("kind", "id_namespace", "id_object")]
    facing = F.struct("path", "version", F.struct(*(F.col(f"row.{f}").alias(f) for f in RECORD)).alias("r"))
    moved = (
        found.where((gone | came) & F.col("row.id_namespace").isNotNull() & F.col("row.id_object").isNotNull())
        .groupBy(*group, *identity).agg(F.count_if(gone).alias("n_gone"), F.count_if(came).alias("n_came"), F.max(F.when(gone, facing)).alias("a"), F.max(F.when(came, facing)).alias("b"))
        .where((F.col("n_gone") == 1) & (F.col("n_came") == 1) & F.col("a.r").eqNullSafe(F.col("b.r")))
        .select(*group, F.col("a.path").alias("path"), F.col("b.path").alias("to_path"), F.col("a.version").alias("version"))
    )
    ends = moved.select(*group, F.explode(F.array(F.struct("path", F.lit("deleted").alias("change")), F.struct(F.col("to_path").alias("path"), F.lit("created").alias("change")))).alias("e"))
    rest = found.join(ends.select(*group, "e.path", "e.change"), [*keys, "change"], "left_anti").select(*keys, "change", F.lit(None).cast("string").alias("to_path"), "version")
    return rest.unionByName(moved.select(*keys, F.lit("renamed").alias("change"), "to_path", "version"))


def deletions(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live before, not seen now, not the source of a rename, and not under a prefix that couldn't be read."""
    return changes.where("change = 'deleted'").select(*keys)


def counter_assignment(changes: DataFrame, group: Sequence[str], base: Column) -> DataFrame:
    """Each change with this replica's next counter: kept paths in path order, a rename at its new path and with one counter, then deletions in
    path order. A counter is one more than the one before it (base before the first) and than the row's own version.

    That is n + max(base, greatest version - n + 1 so far) for the n-th change, so it takes a rank and a running maximum, by blocks.
    """
    rows = changes.where(F.col("change").isin("created", "modified", "renamed", "deleted"))
    rows = rows.withColumn("_late", (F.col("change") == "deleted").cast("int")).withColumn("_at", F.coalesce("to_path", "path"))
    ranked = number_rows(rows, group, ["_late", "_at"], "_n").withColumn("_lead", F.col("version") - F.col("_n") + 1)
    lead = running_max(ranked, group, "_n", "_lead", "_most")
    return lead.withColumn("counter", (F.col("_n") + F.greatest(base, F.col("_most"))).cast("bigint")).drop("_late", "_at", "_n", "_lead", "_most")


def next_records(previous: DataFrame, current: DataFrame, numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The index after a scan, (*keys, RECORD, tombstone, version): what changed with its new counter, vanished and renamed-away paths as tombstones,
    all else as it was. numbered: the changes with their counters. previous: with ``version``."""
    group = [k for k in keys if k != "path"]
    here = numbered.select(*group, F.coalesce("to_path", "path").alias("path"), F.when(F.col("change") != "deleted", F.col("counter")).alias("_new"), F.when(F.col("change") == "deleted", F.col("counter")).alias("_end"))
    left = numbered.where("change = 'renamed'").select(*group, "path", F.lit(None).cast("bigint").alias("_new"), F.col("counter").alias("_end"))
    marks = here.unionByName(left)
    state = [*RECORD, "tombstone"]
    both = joined(previous, current.where(~F.col("tombstone")).withColumn("version", F.lit(None).cast("bigint")), keys, (*state, "version")).join(marks, list(keys), "left")
    new, end = F.col("_new").isNotNull(), F.col("_end").isNotNull()
    pick = lambda f: F.when(new, F.col(f"c.{f}")).otherwise(F.col(f"p.{f}")).alias(f)
    rows = both.where(new | F.col("p.here"))
    return rows.select(*keys, *map(pick, RECORD), F.when(new, False).when(end, True).otherwise(F.col("p.tombstone")).alias("tombstone"), F.coalesce("_new", "_end", F.col("p.version").cast("bigint"), F.lit(0)).alias("version"))


def scan_report(changes: DataFrame, hashed: DataFrame, retries: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counters of each step; hashed: (*group, path) whose content was read, retries: (*group, path) that wait."""
    of = lambda *v: F.count_if(F.col("change").isin(*v))
    counted = changes.groupBy(*group).agg(
        of("unchanged").alias("unchanged"), of("created").alias("created"), of("modified").alias("modified"), of("renamed").alias("renamed"), of("deleted").alias("deleted"),
        F.count_if(F.col("change") != "deleted").alias("live"),
    )
    for rows, name in ((hashed, "files_hashed"), (retries, "retries_queued")):
        counted = counted.join(rows.groupBy(*group).agg(F.count("*").alias(name)), list(group), "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return counted


def inventory(rows: DataFrame, retries: DataFrame, group: Sequence[str]) -> DataFrame:
    """(*group, live, tombstones, files, bytes, retries): what an index holds, bytes of its live files."""
    file = ~F.col("tombstone") & (F.col("kind") == "file")
    held = rows.groupBy(*group).agg(
        F.count_if(~F.col("tombstone")).alias("live"), F.count_if(F.col("tombstone")).alias("tombstones"), F.count_if(file).alias("files"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("bytes")
    )
    return held.join(retries.groupBy(*group).agg(F.count("*").alias("retries")), list(group), "left").withColumn("retries", F.coalesce("retries", F.lit(0)))


def deferred(wanted: DataFrame, retries: DataFrame, keys: Sequence[str], now_ms: Column) -> DataFrame:
    """Files to hash with their turn: hash, or defer if an earlier failure's time to try again hasn't come; what is deferred stays as it is stored."""
    waits = retries.select(*keys, F.col("not_before_ms").alias("_nb"))
    turn = F.when(F.col("_nb") > now_ms, "defer").otherwise("hash")
    return wanted.join(waits, list(keys), "left").withColumn("turn", turn).drop("_nb")


def next_retries(retries: DataFrame, seen: DataFrame, preserved: DataFrame, changes: DataFrame, failures: DataFrame, keys: Sequence[str], now_ms: Column) -> DataFrame:
    """The retries after a scan: those of paths that are gone, were read, deleted or renamed are cleared, each failure waits longer than the last.

    retries and failures: (*keys, attempts?, not_before_ms, last_error); seen: (*keys, ok), all paths of the scan and whether they were read;
    preserved: (*group, prefix). A message keeps its first 1,024 characters.
    """
    group = [k for k in keys if k != "path"]
    kept = retries.select(*keys).join(seen.select(*keys), list(keys), "left_semi").unionByName(under_prefixes(retries, keys, preserved)).distinct()
    ended = changes.where("change = 'deleted'").select(*keys).unionByName(changes.where("change = 'renamed'").select(*keys))
    ended = ended.unionByName(changes.where("change = 'renamed'").select(*group, F.col("to_path").alias("path"))).unionByName(seen.where("ok").select(*keys)).distinct()
    waiting = retries.join(kept, list(keys), "left_semi").join(ended, list(keys), "left_anti").select(*keys, "attempts", "not_before_ms", "last_error")
    failed = failures.select(*keys, F.left("last_error", F.lit(1024)).alias("_error"), F.lit(True).alias("_failed"))
    both = waiting.join(failed, list(keys), "full_outer")
    attempts = F.when(F.col("_failed"), F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts"))
    return both.select(
        *keys, attempts.cast("bigint").alias("attempts"), F.when(F.col("_failed"), now_ms + retry_delay_ms(attempts)).otherwise(F.col("not_before_ms")).cast("bigint").alias("not_before_ms"), F.coalesce("_error", "last_error").alias("last_error")
    )


def scan_gate(collisions: DataFrame, issues: DataFrame, retries: DataFrame, side: str) -> DataFrame:
    """One row, ``safe`` true; reading it raises if the scan has colliding paths, issues or retries."""
    counts = [d.agg(F.count("*").alias(n)) for d, n in ((collisions, "collisions"), (issues, "issues"), (retries, "retries"))]
    row = counts[0].withColumn("_k", F.lit(1)).join(counts[1].withColumn("_k", F.lit(1)), "_k").join(counts[2].withColumn("_k", F.lit(1)), "_k").drop("_k")
    text = lambda c: F.col(c).cast("string")
    why = F.when(F.col("collisions") > 0, F.concat(F.lit(f"{side} scan has "), text("collisions"), F.lit(" colliding path(s)"))).when(
        (F.col("issues") > 0) | (F.col("retries") > 0), F.concat(F.lit(f"{side} scan is incomplete: "), text("issues"), F.lit(" issue(s), "), text("retries"), F.lit(" retries"))
    )
    return row.select("collisions", "issues", "retries", F.when(why.isNull(), True).otherwise(F.raise_error(why).cast("boolean")).alias("safe"))


def reuse_hashes(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """decision per current row: reuse the stored hash if the fingerprint is unchanged and known, else hash; other kinds need none."""
    both = joined(previous, current, keys, (*FINGERPRINT, "content_hash", "tombstone")).where("c.here AND NOT c.tombstone")
    trusted = F.col("p.here") & ~F.col("p.tombstone") & _same("p", "c", FINGERPRINT) & F.col("p.content_hash").isNotNull()
    decision = F.when(F.col("c.kind") != "file", "none").when(F.coalesce(trusted, F.lit(False)), "reuse").otherwise("hash")
    return both.select(*keys, decision.alias("decision"), F.when(decision == "reuse", F.col("p.content_hash")).alias("content_hash"))


def collision_groups(rows: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Live paths that share a key: (*group, key, path) of every member; the count comes first, so that only members are joined."""
    live = rows.where("NOT tombstone").where(F.col(key).isNotNull()).select(*group, key, "path").distinct()
    several = live.groupBy(*group, key).agg(F.count("*").alias("members")).where("members > 1")
    return live.join(several, [*group, key])


def state_delta(previous: DataFrame, current: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """What a commit must write: current rows that are new or differ in any field."""
    both = joined(previous, current, keys, fields).where("c.here")
    return both.where(F.col("p.here").isNull() | ~_same("p", "c", fields)).select(*keys, *(F.col(f"c.{f}").alias(f) for f in fields))


def failure_runs(events: DataFrame, key: str, order: Sequence[str], failed: Column) -> DataFrame:
    """Every failure with the number of failures in a row up to it, and when to try again. A key's events are one item's history."""
    w = Window.partitionBy(key).orderBy(*order)
    run = events.withColumn("_run", F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    attempts = F.row_number().over(Window.partitionBy(key, "_run", failed).orderBy(*order))
    return run.withColumn("attempts", attempts.cast("bigint")).where(failed).drop("_run").withColumn("delay_ms", retry_delay_ms(F.col("attempts")))
