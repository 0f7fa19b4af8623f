"""Queries of the general problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changefold import fold_changes, frontier, live
from ..operators.snapdiff import snapshot_changes
from ..operators.tablediff import belied_roots, copy_differences
from ..runtime import cut, table


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths ever adopted or deleted, with what was last done to them."""
    state = fold_changes(table(spark, sf_dir, "provenance"), "path", "accepted_at", "seq", "operation", ["record_hash"], ["peer", "epoch"])
    return state.select("path", "seq", "operation", "record_hash", "deleted")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = fold_changes(table(spark, sf_dir, "provenance"), "path", "accepted_at", "seq", "operation", ["record_hash"], ["peer", "epoch"])
    return live(state, "path", "record_hash")


def p1_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from two feeds: the earlier deliveries leave their frontier, on which the later ones are folded."""
    feed = table(spark, sf_dir, "provenance")
    half = feed.agg(F.percentile_approx("seq", 0.5)).scalar()
    early = F.coalesce(F.col("seq") <= half, F.lit(True))
    shape = ("path", "accepted_at", "seq", "operation", ["record_hash"], ["peer", "epoch"])
    state = fold_changes(feed.where(~early), *shape, base=frontier(feed.where(early), *shape))
    return state.select("path", "seq", "operation", "record_hash", "deleted")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "index_records"))


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("folder", "snap_no", "change_kind").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cut(copy_differences(table(spark, sf_dir, "snapshot_rows")))
    return cells.unionByName(belied_roots(table(spark, sf_dir, "sync_reports"), cells))


def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_differences(table(spark, sf_dir, "snapshot_rows")).groupBy("pass_id", "field_name").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p1_increments, p3_found, p3_summary, p5_found, p5_summary)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

_TIDY = lambda c: f"lower(trim({c}, {_BLANKS}))"

_P1 = f"""
WITH feed AS (SELECT path, accepted_at, {_TIDY('operation')} AS operation, record_hash, peer, epoch, min(seq) AS seq
              FROM provenance WHERE path IS NOT NULL AND {_TIDY('operation')} IN ('adopt', 'delete') GROUP BY ALL),
     last AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY accepted_at DESC NULLS LAST, seq DESC NULLS LAST) AS r FROM feed)
"""

_P3 = f"""
WITH best AS (SELECT * FROM (
       SELECT folder, snap_no, path, kind, {_TIDY('content_hash')} AS h, id_namespace AS ns, id_object AS obj, coalesce(tombstone, false) AS gone,
              row_number() OVER (PARTITION BY folder, snap_no, path ORDER BY generation DESC NULLS LAST) AS r
       FROM index_records WHERE folder IS NOT NULL AND snap_no IS NOT NULL AND path IS NOT NULL) WHERE r = 1),
     snaps AS (SELECT folder, snap_no, lead(snap_no) OVER (PARTITION BY folder ORDER BY snap_no) AS next_no FROM (SELECT DISTINCT folder, snap_no FROM best)),
     o AS (SELECT b.folder, s.next_no AS snap_no, path, kind, h, ns, obj FROM best b JOIN snaps s USING (folder, snap_no) WHERE next_no IS NOT NULL AND NOT gone),
     n AS (SELECT b.folder, b.snap_no, path, kind, h, ns, obj FROM best b JOIN snaps s ON s.folder = b.folder AND s.next_no = b.snap_no WHERE NOT gone),
     j AS (SELECT coalesce(o.folder, n.folder) AS folder, coalesce(o.snap_no, n.snap_no) AS snap_no, coalesce(o.path, n.path) AS path,
                  CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'added'
                       WHEN o.kind IS DISTINCT FROM n.kind OR o.h IS DISTINCT FROM n.h
                            OR (o.ns IS NOT NULL AND o.obj IS NOT NULL AND n.ns IS NOT NULL AND n.obj IS NOT NULL AND (o.ns <> n.ns OR o.obj <> n.obj)) THEN 'changed' END AS change_kind,
                  coalesce(o.kind, n.kind) AS kind, CASE WHEN n.path IS NULL THEN o.h ELSE n.h END AS h, coalesce(o.ns, n.ns) AS ns, coalesce(o.obj, n.obj) AS obj
           FROM o FULL JOIN n ON o.folder = n.folder AND o.snap_no = n.snap_no AND o.path = n.path),
     v AS (SELECT *, count(*) OVER (PARTITION BY folder, snap_no, change_kind, kind, ns, obj) AS c FROM j WHERE change_kind IN ('removed', 'added') AND ns IS NOT NULL AND obj IS NOT NULL),
     ren AS (SELECT a.folder, a.snap_no, a.path, b.path AS to_path FROM v a JOIN v b ON a.folder = b.folder AND a.snap_no = b.snap_no AND a.kind IS NOT DISTINCT FROM b.kind
               AND a.ns = b.ns AND a.obj = b.obj AND a.change_kind = 'removed' AND b.change_kind = 'added' AND a.c = 1 AND b.c = 1 AND a.h IS NOT DISTINCT FROM b.h),
     found AS (SELECT folder, snap_no, path, change_kind, '' AS to_path FROM j WHERE change_kind IS NOT NULL
                 AND NOT (change_kind = 'removed' AND EXISTS (SELECT 1 FROM ren WHERE ren.folder = j.folder AND ren.snap_no = j.snap_no AND ren.path = j.path))
                 AND NOT (change_kind = 'added' AND EXISTS (SELECT 1 FROM ren WHERE ren.folder = j.folder AND ren.snap_no = j.snap_no AND ren.to_path = j.path))
               UNION ALL SELECT folder, snap_no, path, 'renamed', to_path FROM ren)
"""

_P5 = f"""
WITH r AS (SELECT DISTINCT pass_id, {_TIDY('side')} AS side, path, kind, size, {_TIDY('content_hash')} AS content_hash, readonly, tombstone,
                  list_sort(list_transform(list_filter(version, lambda e: e.counter > 0), lambda e: {_TIDY('e.replica')} || '=' || e.counter)) AS version FROM snapshot_rows),
     l AS (SELECT * FROM r WHERE side = 'local'), m AS (SELECT * FROM r WHERE side = 'remote'),
     j AS (SELECT coalesce(l.pass_id, m.pass_id) AS pass_id, coalesce(l.path, m.path) AS path,
                  CASE WHEN l.path IS NULL THEN ['missing_local'] WHEN m.path IS NULL THEN ['missing_remote'] ELSE
                    list_filter([CASE WHEN l.kind IS DISTINCT FROM m.kind THEN 'kind' END, CASE WHEN l.size IS DISTINCT FROM m.size THEN 'size' END,
                     CASE WHEN l.content_hash IS DISTINCT FROM m.content_hash THEN 'content_hash' END, CASE WHEN l.readonly IS DISTINCT FROM m.readonly THEN 'readonly' END,
                     CASE WHEN l.tombstone IS DISTINCT FROM m.tombstone THEN 'tombstone' END, CASE WHEN l.version IS DISTINCT FROM m.version THEN 'version' END], lambda x: x IS NOT NULL) END AS fs
           FROM l FULL JOIN m ON l.pass_id = m.pass_id AND l.path = m.path),
     cells AS (SELECT pass_id, path, unnest(fs) AS field_name FROM j)
"""

ORACLES = {
    "p1_found": _P1 + "SELECT path, record_hash FROM last WHERE r = 1 AND operation = 'adopt'",
    "p1_state": _P1 + "SELECT path, seq, operation, record_hash, operation = 'delete' AS deleted FROM last WHERE r = 1",
    "p1_increments": _P1 + "SELECT path, seq, operation, record_hash, operation = 'delete' AS deleted FROM last WHERE r = 1",
    "p3_found": _P3 + "SELECT * FROM found",
    "p3_summary": _P3 + "SELECT folder, snap_no, change_kind, count(*) AS n FROM found GROUP BY ALL",
    "p5_found": _P5 + f"SELECT * FROM cells UNION ALL SELECT DISTINCT pass_id, '', 'root' FROM sync_reports WHERE {_TIDY('local_before_root')} = {_TIDY('remote_before_root')} AND pass_id IN (SELECT pass_id FROM cells)",
    "p5_summary": _P5 + "SELECT pass_id, field_name, count(*) AS n FROM cells GROUP BY ALL",
}
