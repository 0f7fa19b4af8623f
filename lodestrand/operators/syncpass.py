"""A whole sync pass as one plan: merge, gates, actions for both sides, contents, application, check of convergence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..runtime import cut
from . import merge as M
from . import merkle


@dataclass
class Pass:
    """The parts of a pass, and ``report`` with one row for each."""

    desired: DataFrame
    conflicts: DataFrame
    local_actions: DataFrame
    remote_actions: DataFrame
    contents: DataFrame
    issues: DataFrame
    local_after: DataFrame
    remote_after: DataFrame
    report: DataFrame


def applied(rows: DataFrame, actions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The snapshot after the actions: every row an action names is replaced by the action's, deletions as tombstones."""
    columns = [*keys, *M.ROW[:5], "vtext"]
    kept = rows.select(*columns).join(actions.select(*keys), list(keys), "left_anti")
    return kept.unionByName(actions.select(*columns))


def _actions(pairs: DataFrame, desired: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
    """Actions that take one side of the pairs to the desired rows, with the rows' histories."""
    rows = pairs.where(F.col(f"{side}.here")).select(*keys, F.col(side).alias("l"))
    want = desired.select(*keys, F.struct(F.lit(True).alias("here"), "path", *M.ROW).alias("r"))
    met = want.join(rows, list(keys), "left")
    differs = F.col("l.here").isNull() | ~R.same("l", "r") | (F.col("l.vtext") != F.col("r.vtext"))
    act = F.when(F.col("r.tombstone"), "delete").otherwise("materialize")
    return met.where(differs).select(*keys, act.alias("action"), *(F.col(f"r.{f}").alias(f) for f in M.ROW[:5]), F.col("r.vtext").alias("vtext"))


def sync_pass(pairs: DataFrame, keys: Sequence[str], own: Column, ceiling: Column, collision_key: Column) -> Pass:
    """pairs: (*keys, l, r), the local and the remote row of every path; own and ceiling: this replica and the greatest counter it has given out.

    report's status names the first gate that stops a pass: counter (the remote side claims more of this replica's counter than was given
    out), namespace (the merged rows can't be laid out together), content (a required content is on neither side), convergence (a side's root
    or count after its actions isn't the desired one), else pass. ``require`` makes a stopped pass an error.
    """
    group = [k for k in keys if k != "path"]
    pairs = cut(pairs)
    records, conflicts = M.merge_pairs(pairs, keys)
    desired = cut(records)
    actions = {side: cut(_actions(pairs, desired, side, keys)) for side in ("l", "r")}
    rows = {side: pairs.where(F.col(f"{side}.here")).select(*keys, *(F.col(f"{side}.{c}").alias(c) for c in M.ROW)) for side in ("l", "r")}
    issues = M.namespace_issues(desired, keys, collision_key)
    claims = M.poisoned(rows["r"], keys, own, ceiling)
    required = None
    for side in ("l", "r"):
        wanted = actions[side].where("action = 'materialize' AND kind = 'file'").select(*group, "content_hash")
        required = wanted if required is None else required.unionByName(wanted)
    contents = cut(M.content_sources(required, rows["l"], rows["r"], group))
    after = {side: applied(rows[side], actions[side], keys) for side in ("l", "r")}

    hashed = R.logical_hash()
    root = lambda df, name: merkle.roots(df, group, hashed).select(*group, F.col("root_hash").alias(f"{name}_root"), F.col("record_count").alias(f"_{name}_n"))
    files = F.when((F.col("action") == "materialize") & (F.col("kind") == "file"), F.col("size"))
    tables = [
        root(rows["l"], "local_before"), root(rows["r"], "remote_before"), root(desired, "desired"), root(after["l"], "verified_local"), root(after["r"], "verified_remote"),
        actions["l"].groupBy(*group).agg(F.count("*").alias("local_actions"), F.coalesce(F.sum(files), F.lit(0)).alias("pending_local_bytes")),
        actions["r"].groupBy(*group).agg(F.count("*").alias("remote_actions")),
        contents.groupBy(*group).agg(F.count_if(F.col("source") == "local").alias("staged_local_files"), F.count_if(F.col("source") == "remote").alias("pulled_remote_files"), F.count_if(F.col("source") == "missing").alias("_lost")),
        conflicts.groupBy(*group).agg(F.count("*").alias("conflicts")), issues.groupBy(*group).agg(F.count("*").alias("_issues")), claims.groupBy(*group).agg(F.count("*").alias("_claims")),
    ]
    report = pairs.select(*group).distinct()
    for t in tables:
        report = report.join(t, list(group), "left")
    zeros = ("local_actions", "pending_local_bytes", "remote_actions", "staged_local_files", "pulled_remote_files", "conflicts", "_lost", "_issues", "_claims")
    report = report.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})
    met = F.lit(True)
    for side in ("local", "remote"):
        met = met & F.col(f"verified_{side}_root").eqNullSafe(F.col("desired_root")) & F.col(f"_verified_{side}_n").eqNullSafe(F.col("_desired_n"))
    status = F.when(F.col("_claims") > 0, "counter").when(F.col("_issues") > 0, "namespace").when(F.col("_lost") > 0, "content").when(~met, "convergence").otherwise("pass")
    shown = [f"{n}_root" for n in ("local_before", "remote_before", "desired", "verified_local", "verified_remote")]
    report = report.withColumn("status", status).select(*group, "status", *shown, *zeros[:6])
    return Pass(desired, conflicts, actions["l"], actions["r"], contents, issues, after["l"], after["r"], report)


def require(report: DataFrame) -> DataFrame:
    """The report; a pass that a gate stopped is an error when it is read."""
    why = F.concat(F.lit("a sync pass was stopped by its gate: "), F.col("status"))
    return report.withColumn("status", F.when(F.col("status") == "pass", F.col("status")).otherwise(F.raise_error(why).cast("string")))


def read_only_plan(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An authoritative remote's changes in the order they are made, parents before what is below them: (*keys, action, kind, depth)."""
    from ..functions import paths as P

    return M.pair_read_only_changes(pairs, keys).withColumn("depth", P.depth(F.col("path")))


# The stages a read-only pass goes through, each stored before the next begins.
STAGES = ("prepared", "preserved", "materialized", "adopted")


def next_stage(stage: Column, changes: Column, preserved: Column, materialized: Column, adopted: Column) -> Column:
    """Where a read-only pass goes on after an interruption, from its stored stage and how many of its changes are preserved and materialized."""
    return (
        F.when(stage.isNull(), STAGES[0]).when((stage == STAGES[0]) & ((preserved > 0) | (changes == 0)), STAGES[1])
        .when((stage == STAGES[1]) & (materialized >= changes), STAGES[2]).when((stage == STAGES[2]) & adopted, STAGES[3]).when(stage == STAGES[3], "done").otherwise(stage)
    )
