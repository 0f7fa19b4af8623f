"""Causal merge of two snapshots, conflict copies, action plans and the checks around them.

Snapshots hold one row per key: (*group, path, kind, size, content_hash, readonly, tombstone, vv) with vv a
map from replica to counter. An absent row is no deletion; only a tombstone deletes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import records as R
from ..runtime import cut

ROW = ("kind", "size", "content_hash", "readonly", "tombstone", "vv", "vtext")


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join: columns l and r hold the two rows, null where a side has none."""
    side = lambda df, n: df.select(*keys, F.struct(F.lit(True).alias("here"), "path", *ROW).alias(n))
    return side(left, "l").join(side(right, "r"), list(keys), "full_outer")


def _live_directory(r: str) -> Column:
    return ~F.col(f"{r}.tombstone") & (F.col(f"{r}.kind") == "directory")


def paired_sides(rows: DataFrame, keys: Sequence[str], left: Column) -> DataFrame:
    """The same pairs out of one relation with both sides' rows, told apart by ``left``: one aggregation in place of a join of two.

    Two rows of one side and key are an error of the caller; the greatest counts.
    """
    row = F.struct(F.lit(True).alias("here"), "path", *(c for c in ROW if c != "vv"))
    pair = rows.groupBy(*keys).agg(F.max(F.when(left, row)).alias("l"), F.max(F.when(~left, row)).alias("r"))
    full = lambda n: F.when(F.col(f"{n}.here"), F.struct(F.lit(True).alias("here"), F.col(f"{n}.path").alias("path"), *(R.vector_of(F.col(f"{n}.vtext")).alias("vv") if c == "vv" else F.col(f"{n}.{c}").alias(c) for c in ROW)))
    return pair.withColumn("l", full("l")).withColumn("r", full("r"))


def outcomes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of two snapshots with its outcome, see ``pair_outcomes``."""
    return pair_outcomes(paired(left, right, keys))


def pair_outcomes(pairs: DataFrame) -> DataFrame:
    """Every key with relation and outcome: left_only, right_only, before, after, equal, concurrent_same, equal_clock_divergence, concurrent_edit."""
    pair = pairs.withColumn("relation", F.when(F.col("l.here") & F.col("r.here"), R.relation(F.col("l.vv"), F.col("r.vv"))))
    same = R.same("l", "r")
    outcome = (
        F.when(F.col("r.here").isNull(), "left_only").when(F.col("l.here").isNull(), "right_only")
        .when(F.col("relation").isin("before", "after"), F.col("relation"))
        .when(F.col("relation") == "equal", F.when(same, "equal").otherwise("equal_clock_divergence"))
        .otherwise(F.when(same, "concurrent_same").otherwise("concurrent_edit"))
    )
    return pair.withColumn("outcome", outcome)


def resolved(out: DataFrame) -> DataFrame:
    """Adds for conflicts: left_wins, winner, loser, the resolved vector and whether the loser is kept as a copy."""
    conflict = F.col("outcome").isin("equal_clock_divergence", "concurrent_edit")
    ldir, rdir = _live_directory("l"), _live_directory("r")
    left_wins = F.when(ldir & ~rdir, True).when(rdir & ~ldir, False).otherwise(R.state_hash("l") >= R.state_hash("r"))
    out = out.where(conflict).withColumn("left_wins", left_wins)
    winner, loser = F.when(F.col("left_wins"), F.col("l")).otherwise(F.col("r")), F.when(F.col("left_wins"), F.col("r")).otherwise(F.col("l"))
    both = R.merged(F.col("l.vv"), F.col("r.vv"))
    out = out.withColumn("winner", winner).withColumn("loser", loser).withColumn("vv", R.incremented(both, R.RESOLVER))
    kept = ~F.col("loser.tombstone") & (F.col("loser.kind") == "file") & (F.col("winner.tombstone") | ~F.col("winner.content_hash").eqNullSafe(F.col("loser.content_hash")))
    return out.withColumn("winner_hash", R.logical_hash("winner")).withColumn("loser_hash", R.logical_hash("loser")).withColumn("kept", kept)


#: How much of the loser's hash a copy's name takes, shortest first that is free.
TOKEN_LENGTHS = (12, 16, 24, 32, 48, 64)
SERIALS = 10_000


def name_copies(conflicts: DataFrame, occupied: DataFrame, keys: Sequence[str]) -> DataFrame:
    """conflict_path of every kept loser: the first free of the token lengths, then of serial numbers behind the full token; an error if none is free."""
    group = [k for k in keys if k != "path"]
    kept = conflicts.where("kept").select(*keys, "loser_hash")
    tokens = F.array(*(F.struct(F.lit(i).alias("rank"), F.left("loser_hash", F.lit(n)).alias("token")) for i, n in enumerate(TOKEN_LENGTHS)))
    last = F.when(F.col("loser_hash").isNotNull(), F.lit(SERIALS))  # by row: as a constant the planner would carry all of them around
    serials = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct((i + len(TOKEN_LENGTHS)).alias("rank"), F.concat(F.col("loser_hash"), F.lit("-"), i.cast("string")).alias("token")))

    def free(rows: DataFrame, options: Column) -> DataFrame:
        named = rows.select(*keys, F.explode(options).alias("o")).select(*keys, "o.rank", P.conflict_path(F.col("path"), F.col("o.token")).alias("conflict_path"))
        taken = occupied.select(*group, F.col("path").alias("conflict_path"))
        return named.join(taken, [*group, "conflict_path"], "left_anti").groupBy(*keys).agg(F.min_by("conflict_path", "rank").alias("conflict_path"))

    first = cut(free(kept, tokens))
    rest = kept.join(first, list(keys), "left_anti")
    numbered = rest.select(*keys).join(free(rest, serials), list(keys), "left")
    none_left = F.raise_error(F.lit("no name is free for a conflict copy"))
    return first.unionByName(numbered.withColumn("conflict_path", F.coalesce("conflict_path", none_left)))


def merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, conflicts) of two snapshots, see ``merge_pairs``."""
    return merge_pairs(paired(left, right, keys), keys)


def merge_pairs(pairs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, conflicts). records: the merged snapshot incl. copies; conflicts: path, copy, hashes and reason."""
    out = cut(pair_outcomes(pairs))  # read by every branch
    group = [k for k in keys if k != "path"]
    conflict = cut(resolved(out))  # the few rows that five branches read
    occupied = out.select(*keys)
    copies = name_copies(conflict, occupied, keys)
    settled = out.where(~F.col("outcome").isin("equal_clock_divergence", "concurrent_edit"))
    pick = F.when(F.col("outcome").isin("left_only", "after", "equal", "concurrent_same"), F.col("l")).otherwise(F.col("r"))
    vv = F.when(F.col("outcome") == "concurrent_same", R.merged(F.col("l.vv"), F.col("r.vv"))).otherwise(F.col("p.vv"))
    state = [F.col(f"p.{f}").alias(f) for f in ROW[:5]]
    plain = settled.withColumn("p", pick).select(*group, "path", *state, vv.alias("vv"), "outcome")
    canonical = conflict.select(*group, "path", *(F.col(f"winner.{f}").alias(f) for f in ROW[:5]), "vv", "outcome")
    joined = conflict.where("kept").join(copies, list(keys))
    copied = joined.select(*group, F.col("conflict_path").alias("path"), *(F.lit(False).alias(f) if f == "tombstone" else F.col(f"loser.{f}").alias(f) for f in ROW[:5]), "vv", F.lit("conflict_copy").alias("outcome"))
    records = plain.unionByName(canonical).unionByName(copied).withColumn("vtext", R.vector_text(F.col("vv")))
    reasons = conflict.join(copies, list(keys), "left").select(*keys, "conflict_path", "winner_hash", "loser_hash", F.col("outcome").alias("reason"))
    return records, reasons


def merge_stats(out: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts by outcome class; copies are the losers kept."""
    is_in = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return out.groupBy(*group).agg(
        is_in("equal", "concurrent_same").alias("equal"), is_in("left_only", "after").alias("selected_left"),
        is_in("right_only", "before").alias("selected_right"), is_in("equal_clock_divergence", "concurrent_edit").alias("conflicts"),
    )


def actions_to_reach(current: DataFrame, desired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """delete or materialize for every desired row the current snapshot doesn't hold as it is; other paths are left alone."""
    return pair_actions(paired(current, desired, keys), keys)


def pair_actions(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for pairs of a current (l) and a desired row (r)."""
    pair = pairs.where(F.col("r.here"))
    differs = F.col("l.here").isNull() | ~R.same("l", "r") | (F.col("l.vtext") != F.col("r.vtext"))
    act = F.when(F.col("r.tombstone"), "delete").otherwise("materialize")
    return pair.where(differs).select(*keys, act.alias("action"), *(F.col(f"r.{f}").alias(f) for f in ROW[:5]))


def apply_order(actions: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """phase 0: deletions, deepest first; 1: directories, shallowest first; 2: the rest by path. A sort key, not a global rank."""
    phase = F.when(F.col("action") == "delete", 0).when(F.col("kind") == "directory", 1).otherwise(2)
    d = P.depth(F.col("path"))
    return actions.withColumn("phase", phase).withColumn("rank_depth", F.when(phase == 0, -d).when(phase == 1, d).otherwise(0))


def content_sources(required: DataFrame, local: DataFrame, remote: DataFrame, group: Sequence[str]) -> DataFrame:
    """For every content hash that must be there: the first live local file with it, else the first remote one, else none."""

    def first(side: DataFrame, name: str) -> DataFrame:
        live = side.where(~F.col("tombstone") & (F.col("kind") == "file") & F.col("content_hash").isNotNull())
        return live.groupBy(*group, "content_hash").agg(F.min("path").alias(name))

    need = required.where(F.col("content_hash").isNotNull()).select(*group, "content_hash").distinct()
    on = [*group, "content_hash"]
    found = need.join(first(local, "local_path"), on, "left").join(first(remote, "remote_path"), on, "left")
    return found.withColumn("source", F.when(F.col("local_path").isNotNull(), "local").when(F.col("remote_path").isNotNull(), "remote").otherwise("missing"))


def read_only_changes(local: DataFrame, remote: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An authoritative remote: local live paths it lacks are removed, its live rows that differ physically installed.

    A directory that is there is left as it is. A change below a path that is itself removed or installed as something else than a directory is dropped.
    """
    return pair_read_only_changes(paired(local, remote, keys), keys)


def pair_read_only_changes(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for pairs of a local (l) and a remote row (r)."""
    group = [k for k in keys if k != "path"]
    live = lambda n: F.when(~F.col(f"{n}.tombstone"), F.col(n))
    pair = pairs.withColumn("l", live("l")).withColumn("r", live("r")).where(F.col("l.here") | F.col("r.here"))
    physical = R.same("l", "r", ("kind", "size", "content_hash", "readonly"))
    both_dirs = (F.col("l.kind") == "directory") & (F.col("r.kind") == "directory")
    act = F.when(F.col("r.here").isNull(), "remove").when(F.col("l.here").isNull(), "install").when(both_dirs | physical, None).otherwise("install")
    changes = cut(pair.withColumn("action", act).where(F.col("action").isNotNull()).select(*keys, "action", F.coalesce("r.kind", "l.kind").alias("kind")))
    blockers = changes.where((F.col("action") == "remove") | (F.col("kind") != "directory")).select(*group, F.col("path").alias("above"))
    below = changes.select(*keys, F.explode(P.ancestors(F.col("path"), proper=True)).alias("above")).join(blockers, [*group, "above"], "left_semi").select(*keys).distinct()
    return changes.join(below, list(keys), "left_anti")


def causal_gate(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """accept, or why an incoming row is refused: stale, concurrent, divergent."""
    return pair_gate(paired(current, incoming, keys), keys)


def pair_gate(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for pairs of a current (l) and an incoming row (r)."""
    pair = pairs.where(F.col("r.here"))
    rel = R.relation(F.col("l.vv"), F.col("r.vv"))
    verdict = (
        F.when(F.col("l.here").isNull() | (rel == "before"), "accept").when(rel == "after", "stale").when(rel == "concurrent", "concurrent")
        .when(R.same("l", "r"), "accept").otherwise("divergent")
    )
    return pair.select(*keys, verdict.alias("verdict"))


def checkpoint_violations(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of an earlier checkpoint that the later one lost, sets back, contradicts, or changes without a new version."""
    return pair_checkpoint_violations(paired(before, after, keys), keys)


def pair_checkpoint_violations(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for pairs of an earlier (l) and a later row (r)."""
    pair = pairs.where(F.col("l.here"))
    rel = R.relation(F.col("l.vv"), F.col("r.vv"))
    why = (
        F.when(F.col("r.here").isNull(), "missing").when(rel == "after", "went_back").when(rel == "concurrent", "concurrent")
        .when((rel == "equal") & ~R.same("l", "r"), "changed_in_place")
    )
    return pair.withColumn("violation", why).where(F.col("violation").isNotNull()).select(*keys, "violation")


def poisoned(incoming: DataFrame, keys: Sequence[str], replica: Column, ceiling: Column) -> DataFrame:
    """Incoming rows that claim more of this replica's own counter than it has given out."""
    claimed = R.counter(F.col("vv"), replica)
    return incoming.where(claimed > ceiling).select(*keys, claimed.alias("claimed"))


def namespace_issues(rows: DataFrame, keys: Sequence[str], collision_key: Column) -> DataFrame:
    """Live rows that can't be laid out together: kind, ancestor (a row above that is dead or no directory), collision (two names of one folded form on any level)."""
    group = [k for k in keys if k != "path"]
    live = rows.where(~F.col("tombstone"))
    kinds = live.where(~F.col("kind").isin("file", "directory")).select(*keys, F.lit("kind").alias("issue"))
    need = live.select(*keys, F.explode(P.ancestors(F.col("path"), proper=True)).alias("above"))
    not_dirs = rows.where(F.col("tombstone") | (F.col("kind") != "directory")).select(*group, F.col("path").alias("above"))
    blocked = need.join(not_dirs, [*group, "above"], "left_semi").select(*keys).distinct().withColumn("issue", F.lit("ancestor"))
    prefixes = live.select(*group, F.explode(P.ancestors(F.col("path"))).alias("path")).distinct().withColumn("_k", collision_key)
    several = prefixes.groupBy(*group, "_k").agg(F.count("*").alias("n")).where("n > 1").select(*group, "_k")
    clash = prefixes.join(several, [*group, "_k"], "left_semi").select(*keys).withColumn("issue", F.lit("collision"))
    return kinds.unionByName(blocked).unionByName(clash)


def missing_ancestors(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Directories that a live row needs above it and that the snapshot lacks."""
    group = [k for k in keys if k != "path"]
    live = rows.where(~F.col("tombstone"))
    need = live.select(*group, F.explode(P.ancestors(F.col("path"), proper=True)).alias("path")).distinct()
    return need.join(live.where(F.col("kind") == "directory").select(*keys), list(keys), "left_anti")
