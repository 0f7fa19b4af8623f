"""Roll-up of a namespace by path prefix: hashes and counts of subtrees, and what differs between two trees.

A node's hash covers its own record and its children's hashes, whatever their order: it is the sum of the digests of all
records at and below it, in eight words of 32 bits. A record's digest covers its path, so names count as well. Sums
combine on the map side, so a tree of any depth and a directory of any size take one aggregation over exploded prefixes:
no loop over levels, no list of a directory's children in one place. Such sums tell accidental differences as a 256-bit
digest does; they aren't meant to withstand someone who makes up records to meet a given sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.records import digest

WORDS = 8


def _words(hex_digest: Column) -> list[Column]:
    return [F.conv(F.substring(hex_digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"_w{i}") for i in range(WORDS)]


def _summed() -> list[Column]:
    # each word is below 2^32, so two thousand million records fit a long; a sum beyond is an error, not a wrong hash
    return [F.sum(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)]


def _text() -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(F.pmod(F.col(f"_w{i}"), F.lit(1 << 32)))), 8, "0") for i in range(WORDS)))


def nodes(rows: DataFrame, group: Sequence[str], own: Column) -> DataFrame:
    """(*group, prefix, parent, depth, own_hash, hash, record_count) of every prefix; the root has the empty prefix and depth 0.

    Two rows of one path are an error of the caller.
    """
    leaf = rows.select(*group, "path", own.alias("own_hash"))
    leaf = leaf.select(*group, "path", "own_hash", digest("node", F.col("path"), F.col("own_hash")).alias("_d")).select(*group, "path", "own_hash", *_words(F.col("_d")))
    at = leaf.withColumn("prefix", F.explode(F.concat(F.array(F.lit("")), P.ancestors(F.col("path")))))
    rolled = at.groupBy(*group, "prefix").agg(*_summed(), F.count("*").alias("record_count"), F.max(F.when(F.col("prefix") == F.col("path"), F.col("own_hash"))).alias("own_hash"))
    root = F.col("prefix") == ""
    return rolled.select(
        *group, "prefix", F.when(~root, F.coalesce(P.parent(F.col("prefix")), F.lit(""))).alias("parent"), F.when(root, 0).otherwise(P.depth(F.col("prefix"))).alias("depth"), "own_hash", _text().alias("hash"), "record_count"
    )


def roots(rows: DataFrame, group: Sequence[str], own: Column) -> DataFrame:
    """(*group, root_hash, record_count), without the nodes between."""
    leaf = rows.select(*group, digest("node", F.col("path"), own).alias("_d")).select(*group, *_words(F.col("_d")))
    return leaf.groupBy(*group).agg(*_summed(), F.count("*").alias("record_count")).select(*group, _text().alias("root_hash"), "record_count")


def differing_rows(rows: DataFrame, keys: Sequence[str], left: Column, own: Column) -> DataFrame:
    """Paths whose own records differ between the two sides of one relation, told apart by ``left``: one aggregation."""
    sides = rows.select(*keys, left.alias("_left"), own.alias("_own"))
    both = sides.groupBy(*keys).agg(F.max(F.when(F.col("_left"), F.col("_own"))).alias("_l"), F.max(F.when(~F.col("_left"), F.col("_own"))).alias("_r"))
    return both.where(~F.col("_l").eqNullSafe(F.col("_r"))).select(*keys)


def _facing(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    keys = [*group, "prefix"]
    side = lambda df, n: df.select(*keys, F.struct(F.lit(True).alias("here"), "parent", "depth", "own_hash", "hash", "record_count").alias(n))
    return side(left, "l").join(side(right, "r"), keys, "full_outer")


def _unlike() -> Column:
    return ~(F.col("l.hash").eqNullSafe(F.col("r.hash")) & F.col("l.record_count").eqNullSafe(F.col("r.record_count")))


def differing(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    """Paths whose own records differ, from two stored trees; where hash and count agree nothing below is looked at."""
    unlike = _facing(left, right, group).where(_unlike())
    return unlike.where(~F.col("l.own_hash").eqNullSafe(F.col("r.own_hash"))).select(*group, F.col("prefix").alias("path"))


def visited(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    """(*group, nodes): how many nodes a descent asks for that follows only differing children; the root is always asked."""
    asked = _facing(left, right, group).where((F.col("prefix") == "") | (_unlike() & F.col("r.here")))
    return asked.groupBy(*group).agg(F.count("*").alias("nodes"))


def reconstruct(local: DataFrame, remote: DataFrame, local_tree: DataFrame, remote_tree: DataFrame, group: Sequence[str]) -> DataFrame:
    """The remote snapshot with what must be fetched for it: local rows below a subtree that both trees have alike (origin reused), the rest from remote (fetched).

    local and remote have the same columns, with (*group, path).
    """
    alike = _facing(local_tree, remote_tree, group).where(~_unlike() & F.col("l.here") & F.col("r.here")).select(*group, "prefix")
    below = lambda rows: rows.select(*group, "path", F.explode(F.concat(F.array(F.lit("")), P.ancestors(F.col("path")))).alias("prefix")).join(alike, [*group, "prefix"], "left_semi").select(*group, "path").distinct()
    keys = [*group, "path"]
    reused = local.join(below(local), keys, "left_semi").withColumn("origin", F.lit("reused"))
    return reused.unionByName(remote.join(below(remote), keys, "left_anti").withColumn("origin", F.lit("fetched")))


def children(tree: DataFrame, group: Sequence[str]) -> DataFrame:
    return tree.where("parent IS NOT NULL").select(*group, "parent", P.name(F.col("prefix")).alias("name"), "hash", "record_count")


def subtree(rows: DataFrame, prefix: str) -> DataFrame:
    """The prefix itself and what lies below it, as a range of the key: it prunes files that are sorted by path."""
    path = F.col("path")
    return rows if prefix == "" else rows.where((path == prefix) | ((path >= prefix + "/") & (path < prefix + "0")))


def summary_issues(summaries: DataFrame, listed: DataFrame, group: Sequence[str]) -> DataFrame:
    """(*group, prefix, issue) of node summaries as a peer sent them.

    summaries: (*group, prefix, record_path, record_count), record_path null without a record of its own; listed: their children
    (*group, prefix, ordinal from 0, name, record_count). Issues: empty (a node or child without records), record (a record of another path), name
    (a child that is no single component), order (children out of order or twice), count (not the own record and the children's).
    """
    keys = [*group, "prefix"]
    empty = summaries.where((F.col("prefix") != "") & (F.col("record_count") <= 0)).select(*keys).unionByName(listed.where("record_count <= 0").select(*keys)).distinct()
    record = summaries.where(F.col("record_path").isNotNull() & (F.col("record_path") != F.col("prefix"))).select(*keys)
    name = listed.where(P.path_issue(F.col("name")).isNotNull() | F.contains("name", F.lit("/"))).select(*keys).distinct()
    ahead = listed.select(*keys, (F.col("ordinal") - 1).alias("ordinal"), F.col("name").alias("_next"))
    order = listed.join(ahead, [*keys, "ordinal"]).where(F.col("name") >= F.col("_next")).select(*keys).distinct()
    below = listed.groupBy(*keys).agg(F.sum("record_count").alias("_n"))
    own = F.when(F.col("record_path").isNotNull(), 1).otherwise(0)
    count = summaries.join(below, keys, "left").where(F.col("record_count") != own + F.coalesce("_n", F.lit(0))).select(*keys)
    found = None
    for rows, issue in ((empty, "empty"), (record, "record"), (name, "name"), (order, "order"), (count, "count")):
        named = rows.withColumn("issue", F.lit(issue))
        found = named if found is None else found.unionByName(named)
    return found


def checked_snapshot(rows: DataFrame, group: Sequence[str], own: Column, expected: DataFrame) -> DataFrame:
    """(*group, root_hash, record_count) of the rows; reading it raises where it isn't the expected (*group, root_hash, record_count)."""
    want = expected.select(*group, F.col("root_hash").alias("_h"), F.col("record_count").alias("_n"))
    met = roots(rows, group, own).join(want, list(group), "full_outer")
    same = F.col("root_hash").eqNullSafe(F.col("_h")) & F.col("record_count").eqNullSafe(F.col("_n"))
    checked = F.when(same, F.col("root_hash")).otherwise(F.raise_error(F.lit("the snapshot isn't the one that was expected")))
    return met.select(*group, checked.alias("root_hash"), "record_count")
