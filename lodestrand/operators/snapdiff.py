"""What changed between full snapshots.

Snapshots are range-partitioned and sorted by key, so that the rows of one key range, of all snapshots,
lie in one task. There the range is cut at keys whose own hash says so, into chunks: a cut depends on
the key alone, so an insertion moves no other cut. Of each chunk every snapshot has a digest; where two
consecutive snapshots agree, the chunk's rows are discarded on the spot, unshuffled. Only rows of chunks
that differ are joined by key and classified, then vanished and new keys are matched by identity.

Defined results
* null folder, snapshot number or path: no place in a snapshot, left out.
* several rows for one place: the highest generation; of equal generations the greatest (live, kind, hash, identity).
* tombstone: an absent path, but its snapshot exists. null tombstone: a live row.
* null generation: below all others. Half an identity (one of two numbers null) is none.
* digests that differ in letter case or blanks at the ends are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tidy
from ..runtime import cut, materialise

#: Mean number of paths in a chunk.
CHUNK_PATHS = 64

_ROLE_SCHEMA = "folder string, snap_no int, path string, is_new boolean, kind string, content_hash string, id_namespace long, id_object long"


def latest_rows(records: DataFrame) -> DataFrame:
    """One row per (folder, snap_no, path): the highest generation."""
    best = F.max(
        F.struct(
            F.col("generation"),
            (~F.coalesce(F.col("tombstone"), F.lit(False))).alias("live"),
            F.col("kind"),
            tidy(F.col("content_hash")).alias("content_hash"),
            F.col("id_namespace"),
            F.col("id_object"),
        )
    ).alias("_best")
    placed = records.where(F.col("folder").isNotNull() & F.col("snap_no").isNotNull() & F.col("path").isNotNull())
    return placed.groupBy("folder", "snap_no", "path").agg(best).select("folder", "snap_no", "path", "_best.*")


def snapshot_order(records: DataFrame) -> DataFrame:
    """Of each folder's snapshot its position and the number of its next one."""
    seen = records.where(F.col("folder").isNotNull() & F.col("snap_no").isNotNull() & F.col("path").isNotNull())
    by_folder = Window.partitionBy("folder").orderBy("snap_no")
    return seen.select("folder", "snap_no").distinct().select(
        "folder", "snap_no", F.row_number().over(by_folder).alias("pos"), F.lead("snap_no").over(by_folder).alias("next_no")
    )


def _unmatched(table: pa.Table) -> pa.Table:
    """Roles of the rows whose chunk differs between neighbouring snapshots. table: whole chunks, sorted by (folder, path)."""
    chunk = np.cumsum(table["cut"].to_numpy())
    pos = table["pos"].to_numpy().astype(np.int64)
    words = np.frombuffer(b"".join(table["digest"].to_pylist()), dtype="<u8").reshape(-1, 4)
    order = np.lexsort((pos, chunk))
    c, p, w = chunk[order], pos[order], words[order]
    first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1])])
    sums = np.add.reduceat(w, first, axis=0)  # a digest of the set of rows: the sum of 256-bit row digests, by 64-bit words
    gc, gp = c[first], p[first]
    same_as_next = np.r_[(gc[1:] == gc[:-1]) & (gp[1:] == gp[:-1] + 1) & (sums[1:] == sums[:-1]).all(axis=1), False]
    same_as_last = np.r_[False, same_as_next[:-1]]
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    has_next = ~table["next_no"].is_null().to_numpy()
    old = np.flatnonzero(has_next & ~same_as_next[of])
    new = np.flatnonzero((pos > 1) & ~same_as_last[of])
    state = ["kind", "content_hash", "id_namespace", "id_object"]
    parts = []
    for rows, is_new in ((old, False), (new, True)):
        part = table.take(pa.array(rows))
        parts.append(
            pa.table(
                [part["folder"], part["snap_no" if is_new else "next_no"], part["path"], pa.array(np.full(len(rows), is_new)), *(part[s] for s in state)],
                names=["folder", "snap_no", "path", "is_new", *state],
            )
        )
    return pa.concat_tables(parts)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes on whole chunks; what follows the last cut waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero(batch.column("cut").to_numpy(zero_copy_only=False))
        # rows of one path, one for each snapshot, carry the cut on the first of them only
        if not len(cuts):
            held.append(batch)
            continue
        ready = pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]) if held or cuts[-1] else None
        held = [batch.slice(cuts[-1])]
        if ready is not None and ready.num_rows:
            yield from _unmatched(ready).to_batches()
    if held:
        yield from _unmatched(pa.Table.from_batches(held)).to_batches()


def unmatched_rows(records: DataFrame, chunk_paths: int = CHUNK_PATHS, partitions: int | None = None) -> DataFrame:
    """Rows of differing chunks, each in its role in one step: is_new in the later snapshot, or not in the earlier."""
    rows = latest_rows(records).where("live").join(snapshot_order(records), ["folder", "snap_no"])
    state = F.to_json(F.struct("path", "kind", "content_hash", "id_namespace", "id_object"))
    is_cut = F.pmod(F.xxhash64("folder", "path"), F.lit(chunk_paths)) == 0
    rows = rows.select(
        "folder", "snap_no", "path", "pos", "next_no", "kind", "content_hash", "id_namespace", "id_object",
        F.unhex(F.sha2(state, 256)).alias("digest"), is_cut.alias("is_cut"),
    )
    rows = materialise(rows, "snapshot-rows")  # a range sort reads its input twice, for its bounds and for its rows
    ranged = rows.repartitionByRange(partitions, "folder", "path") if partitions else rows.repartitionByRange("folder", "path")
    ordered = ranged.sortWithinPartitions("folder", "path", "pos")
    return ordered.mapInArrow(_cut_first(_chunked), _ROLE_SCHEMA)


def _cut_first(inner):
    """Marks the cut on the first row of each path; a change of folder cuts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked() -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                folder = batch.column("folder").dictionary_encode()
                path = batch.column("path")
                f = folder.indices.to_numpy()
                new_folder = np.r_[True, f[1:] != f[:-1]]
                same_path = np.asarray(pc.equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False), dtype=bool)
                new_path = np.r_[True, ~same_path] | new_folder
                here = (folder.dictionary[int(f[0])].as_py(), path[0].as_py())
                if last is not None:
                    new_folder[0] = last[0] != here[0]
                    new_path[0] = last != here
                last = (folder.dictionary[int(f[-1])].as_py(), path[len(path) - 1].as_py())
                flag = new_folder | (new_path & batch.column("is_cut").to_numpy(zero_copy_only=False))
                yield batch.append_column("cut", pa.array(flag))

        yield from inner(marked())

    return run


def snapshot_changes(records: DataFrame, chunk_paths: int = CHUNK_PATHS, partitions: int | None = None) -> DataFrame:
    """(folder, snap_no, path, change_kind, to_path) for every step from a folder's snapshot to its next."""
    side = F.struct(F.lit(True).alias("here"), "kind", "content_hash", "id_namespace", "id_object")
    joined = (
        unmatched_rows(records, chunk_paths, partitions)
        .groupBy("folder", "snap_no", "path")
        .agg(F.max(F.when(~F.col("is_new"), side)).alias("old"), F.max(F.when(F.col("is_new"), side)).alias("new"))
    )
    known = lambda s: F.col(f"{s}.id_namespace").isNotNull() & F.col(f"{s}.id_object").isNotNull()
    differs = lambda c: ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    moved = known("old") & known("new") & (differs("id_namespace") | differs("id_object"))
    kind = (
        F.when(F.col("new.here").isNull(), "removed")
        .when(F.col("old.here").isNull(), "added")
        .when(differs("kind") | differs("content_hash") | moved, "changed")
    )
    state = F.coalesce("old", "new")
    changes = cut(
        joined.withColumn("change_kind", kind).where(F.col("change_kind").isNotNull()).select(
            "folder", "snap_no", "path", "change_kind", state["kind"].alias("kind"), state["content_hash"].alias("content_hash"),
            state["id_namespace"].alias("ns"), state["id_object"].alias("obj"),
        )
    )
    gone, came = F.col("change_kind") == "removed", F.col("change_kind") == "added"
    facing = F.struct("path", F.struct("content_hash").alias("content"))
    renamed = (
        changes.where((gone | came) & F.col("ns").isNotNull() & F.col("obj").isNotNull())
        .groupBy("folder", "snap_no", "kind", "ns", "obj")
        .agg(F.count_if(gone).alias("n_gone"), F.count_if(came).alias("n_came"), F.max(F.when(gone, facing)).alias("a"), F.max(F.when(came, facing)).alias("b"))
        .where((F.col("n_gone") == 1) & (F.col("n_came") == 1) & F.col("a.content").eqNullSafe(F.col("b.content")))
        .select("folder", "snap_no", F.col("a.path").alias("path"), F.col("b.path").alias("to_path"))
    )
    ends = renamed.select(
        "folder", "snap_no", F.explode(F.array(F.struct("path", F.lit("removed").alias("change_kind"), "to_path"), F.struct(F.col("to_path").alias("path"), F.lit("added").alias("change_kind"), F.lit(None).cast("string").alias("to_path")))).alias("e")
    ).select("folder", "snap_no", "e.path", "e.change_kind", "e.to_path", F.lit(True).alias("is_end"))
    result = changes.select("folder", "snap_no", "path", "change_kind").join(ends, ["folder", "snap_no", "path", "change_kind"], "left")
    return result.where(F.col("is_end").isNull() | F.col("to_path").isNotNull()).select(
        "folder", "snap_no", "path", F.when(F.col("is_end"), "renamed").otherwise(F.col("change_kind")).alias("change_kind"), F.coalesce("to_path", F.lit("")).alias("to_path")
    )
