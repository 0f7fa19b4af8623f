"""Change journals as state machines, the same for a batch and for a stream's micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The steps a change may take.
STEPS = (
    ("none", "prepared"), ("prepared", "preserved"), ("prepared", "materialized"), ("prepared", "aborted"), ("preserved", "materialized"), ("preserved", "aborted"),
    ("preserved", "rolling_back"), ("materialized", "indexed"), ("materialized", "rolling_back"), ("indexed", "committed"), ("rolling_back", "rolled_back"),
)


def latest_states(log: DataFrame) -> DataFrame:
    """(id, state, seq) after all events of the log (id, state, seq)."""
    return log.groupBy("id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def illegal_steps(log: DataFrame) -> DataFrame:
    """Events that don't follow from the one before them."""
    before = F.lag("state").over(Window.partitionBy("id").orderBy("seq"))
    steps = log.withColumn("from_state", F.coalesce(before, F.lit("none"))).withColumnRenamed("state", "to_state")
    return steps.where(~F.concat_ws(">", "from_state", "to_state").isin(*(">".join(s) for s in STEPS)))


def recovery(state: Column, target_indexed: Column) -> Column:
    """What a restart does with a change: finish, roll_back, abort or nothing."""
    return (
        F.when(state.isin("committed", "aborted", "rolled_back"), "nothing").when(state.isin("materialized", "indexed") & target_indexed, "finish")
        .when(state == "rolling_back", "roll_back").when(state.isin("materialized"), "roll_back").otherwise("abort")
    )


def entry_issues(log: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, issue) of journal entries: version, id (letters, digits and dashes), path, state (no known one), artifact (a preserved row without its object).

    log: (id, version, path, state, expected, metadata_only); kept: (id, identity), the objects there are; expected: the identity of what was
    replaced, null where nothing was.
    """
    from ..functions import paths as P

    there = kept.select("id", F.col("identity").alias("_identity"), F.lit(True).alias("_there"))
    states = sorted({t for s in STEPS for t in s} - {"none"})
    needs = F.col("expected").isNotNull() & ~F.col("metadata_only") & F.col("state").isin("preserved", "materialized", "indexed", "committed")
    issue = (
        F.when(F.col("version") != 1, "version").when(~F.col("id").cast("string").rlike("^[A-Za-z0-9-]+$"), "id").when(P.path_issue(F.col("path")).isNotNull(), "path")
        .when(~F.col("state").isin(*states), "state").when(needs & (F.col("_there").isNull() | ~F.col("_identity").eqNullSafe(F.col("expected"))), "artifact")
    )
    return log.join(there, "id", "left").withColumn("issue", issue).where(F.col("issue").isNotNull()).select("id", "issue")


def resumed(state: Column, captured: Column, staged: Column, target: Column) -> Column:
    """Where a change ends that is taken up again: a file whose staging never ended and that has captured nothing is given up, all else is put in place."""
    return F.when((state == "prepared") & ~captured & (target == "file") & ~staged, "aborted").when(state.isin("prepared", "preserved"), "materialized").otherwise(state)


def aborted(state: Column) -> Column:
    """Given up: possible until something was put in place."""
    return F.when(state.isin("prepared", "preserved"), "aborted").otherwise(state)


def rolled_back(state: Column, target_indexed: Column) -> Column:
    """Taken back, unless the index holds the target already."""
    return F.when(state.isin("preserved", "materialized", "rolling_back") & ~target_indexed, "rolled_back").otherwise(state)


def mark_indexed(log: DataFrame, index: DataFrame, fields: tuple[str, ...] = ("record_hash",)) -> DataFrame:
    """The journal's newest rows, materialized ones marked indexed where the index holds exactly their record. log: (id, path, state, *fields); index: (path, *fields)."""
    now = index.select("path", *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_here"))
    same = F.col("_here").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    met = log.join(now, "path", "left")
    return met.withColumn("state", F.when((F.col("state") == "materialized") & same, "indexed").otherwise(F.col("state"))).select(*log.columns)


def recover(log: DataFrame, index: DataFrame) -> DataFrame:
    """(id, path, decision) of every open change against the row its path has in the index.

    log: (id, path, state, record_hash, precondition), the hash of the record it brings and of the row it was made over (null for none);
    index: (path, record_hash). nothing (ended), mark_indexed (the index holds the record), unavailable (the index holds neither), roll_back
    (it was being taken back), resume.
    """
    now = index.select("path", F.col("record_hash").alias("_now"))
    decision = (
        F.when(F.col("state").isin("committed", "aborted", "rolled_back"), "nothing").when(F.col("_now") == F.col("record_hash"), "mark_indexed")
        .when(~F.col("_now").eqNullSafe(F.col("precondition")), "unavailable").when(F.col("state") == "rolling_back", "roll_back").otherwise("resume")
    )
    return log.join(now, "path", "left").select("id", "path", decision.alias("decision"))


def preserved_objects(log: DataFrame, there: DataFrame) -> DataFrame:
    """(id, kind, location) of the artifacts and rollback copies of all changes that exist. there: (location)."""
    kinds = log.select("id", F.explode(F.array(F.lit("artifact"), F.lit("rollback"))).alias("kind"))
    return kinds.withColumn("location", F.concat_ws("/", F.col("id").cast("string"), "kind")).join(there.select("location").distinct(), "location", "left_semi").select("id", "kind", "location")
