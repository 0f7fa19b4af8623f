"""Differences between two copies of data, row by row and field by field.

Both sides are reduced to one row per key (copies combine on the map side), spread over hash buckets of
the key and cogrouped; a bucket is a pair of Arrow tables of bounded size. Within it the keys are
aligned by a sorted search on their 64-bit hashes, verified against the keys themselves, and every
field is compared at once by null-aware masks over the aligned columns; the masked cells are emitted.

Defined results
* null equals null; a null side, null pass or null path names no row, left out.
* sides, digests and kinds are told apart without letter case and blanks at the ends (kind: as it is).
* several different rows for one key on one side: the greatest (size, digest, ...) stands for it.
* version: counters by replica, the greatest of several entries, an absent replica or null list counts 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tidy
from ..runtime import materialise

#: Rows of both sides that one bucket holds on average.
BUCKET_ROWS = 50_000


def canonical_version(entries: Column) -> Column:
    """One string for equal vectors: 'replica=counter' of the positive counters, from a list sorted by ``_sorted_counters``."""
    replica = lambda e: F.coalesce(e["replica"], F.lit(""))
    # of a replica's several entries the greatest is the last of its run
    is_last = lambda e, i: ~F.coalesce(replica(F.get(entries, i + 1)) == replica(e), F.lit(False)) | (i == F.size(entries) - 1)
    text = F.transform(F.filter(entries, is_last), lambda e: F.concat(replica(e), F.lit("="), e["counter"].cast("string")))
    return F.coalesce(F.array_join(text, ","), F.lit(""))


def _sorted_counters(version: Column) -> Column:
    entries = F.transform(version, lambda e: F.struct(tidy(e["replica"]).alias("replica"), e["counter"].alias("counter")))
    return F.array_sort(F.filter(entries, lambda e: e["counter"] > 0))


def _align(left: pa.Table, right: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each left row the right row of its key, or -1; and which right rows have a left one."""
    lh, rh = left["_hash"].to_numpy(), right["_hash"].to_numpy()
    order = np.argsort(rh, kind="stable")
    ranked = rh[order]
    at = np.searchsorted(ranked, lh)
    hit = at < len(ranked)
    hit[hit] = ranked[at[hit]] == lh[hit]
    partner = np.full(len(lh), -1, dtype=np.int64)
    partner[hit] = order[at[hit]]
    rows = np.flatnonzero(partner >= 0)
    true = np.ones(len(rows), dtype=bool)
    for k in keys:
        true &= pc.equal(left[k].take(pa.array(rows)), right[k].take(pa.array(partner[rows]))).to_numpy(zero_copy_only=False).astype(bool)
    twice = len(ranked) and bool((ranked[1:] == ranked[:-1]).any())
    if twice or not true.all():  # two keys of one hash: settle these few by the keys
        dense = set(ranked[1:][ranked[1:] == ranked[:-1]].tolist()) | set(lh[rows[~true]].tolist())
        full = {}
        for j in np.flatnonzero(np.isin(rh, list(dense))):
            full[tuple(right[k][int(j)].as_py() for k in keys)] = int(j)
        for i in np.flatnonzero(np.isin(lh, list(dense))):
            partner[i] = full.get(tuple(left[k][int(i)].as_py() for k in keys), -1)
    matched = np.zeros(len(rh), dtype=bool)
    matched[partner[partner >= 0]] = True
    return partner, matched


def _differs(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    both_null = pc.and_(pc.is_null(a), pc.is_null(b))
    equal = pc.fill_null(pc.equal(a, b), False)
    return ~pc.or_(equal, both_null).to_numpy(zero_copy_only=False).astype(bool)


def cell_differ(keys: Sequence[str], fields: Sequence[str], missing_left: str, missing_right: str, out: pa.Schema) -> Callable:
    """The function of one bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # a bucket that one side lacks comes without that side's columns
        left = left if left.num_columns else right.schema.empty_table()
        right = right if right.num_columns else left.schema.empty_table()
        partner, matched = _align(left, right, keys)
        alone_left, alone_right = np.flatnonzero(partner < 0), np.flatnonzero(~matched)
        pairs = np.flatnonzero(partner >= 0)
        at_left, at_right = pa.array(pairs), pa.array(partner[pairs])
        found = [(left, alone_left, missing_right), (right, alone_right, missing_left)]
        for f in fields:
            mask = _differs(left[f].take(at_left), right[f].take(at_right))
            found.append((left, pairs[mask], f))
        parts = [pa.table([*(t[k].take(pa.array(rows)) for k in keys), pa.array([name] * len(rows), pa.string())], names=out.names).cast(out) for t, rows, name in found]
        return pa.concat_tables(parts)

    return run


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    # new names for all columns: both sides may come from one table
    hashed = df.select(*(F.col(c).alias(c) for c in df.columns)).withColumn("_hash", F.xxhash64(*keys))
    return hashed.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))


def diff_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], missing_left: str, missing_right: str, buckets: int) -> DataFrame:
    """(*keys, field_name) of every cell that differs; a row of one side only gives missing_left or missing_right.

    Each side has one row per key, without null in the keys, and equal types.
    """
    types = dict(left.dtypes)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    out = pa.schema([*((k, arrow[types[k]]) for k in keys), ("field_name", pa.string())])
    ddl = ", ".join([*(f"{k} {types[k]}" for k in keys), "field_name string"])
    sides = [bucketed(s.select(*keys, *fields), keys, buckets).groupBy("_bucket") for s in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(cell_differ(keys, fields, missing_left, missing_right, out), ddl)


FIELDS = ("kind", "size", "content_hash", "readonly", "tombstone", "version")


def side_rows(rows: DataFrame) -> DataFrame:
    """One tidy row per (pass_id, path), side by side in the column ``side``."""
    placed = rows.where(F.col("pass_id").isNotNull() & F.col("path").isNotNull()).select(
        "pass_id", tidy(F.col("side")).alias("side"), "path", "kind", "size", tidy(F.col("content_hash")).alias("content_hash"),
        "readonly", "tombstone", _sorted_counters(F.col("version")).alias("entries"),
    ).withColumn("version", canonical_version(F.col("entries")))
    best = F.max(F.struct("size", "content_hash", "kind", "readonly", "tombstone", "version")).alias("_r")
    return placed.where(F.col("side").isin("local", "remote")).groupBy("pass_id", "side", "path").agg(best).select("pass_id", "side", "path", *(f"_r.{f}" for f in FIELDS))


def copy_differences(rows: DataFrame, buckets: int | None = None, total: int | None = None) -> DataFrame:
    """Missing rows and differing fields of every pass."""
    tidied = materialise(side_rows(rows), "sides")  # read for either side and for the number of buckets
    if buckets is None:
        buckets = max(1, -(-(tidied.count() if total is None else total) // BUCKET_ROWS))
    local, remote = (tidied.where(F.col("side") == s).drop("side") for s in ("local", "remote"))
    return diff_cells(local, remote, ["pass_id", "path"], FIELDS, "missing_local", "missing_remote", buckets)


def belied_roots(reports: DataFrame, differences: DataFrame) -> DataFrame:
    """Passes whose report claims equal roots before the pass while rows differ."""
    claimed = reports.where(tidy(F.col("local_before_root")) == tidy(F.col("remote_before_root"))).select("pass_id").distinct()
    return differences.select("pass_id").distinct().join(claimed, "pass_id", "left_semi").select("pass_id", F.lit("").alias("path"), F.lit("root").alias("field_name"))
