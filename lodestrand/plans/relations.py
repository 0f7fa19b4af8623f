"""Relations the queries share, each as a DataFrame and as the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.text import digest_bytes, tidy
from ..operators.merge import paired_sides
from ..runtime import table

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def sql_tidy(c: str) -> str:
    return f"lower(trim({c}, {BLANKS}))"


def sql_key(c: str) -> str:
    return f"CASE WHEN regexp_full_match({sql_tidy(c)}, '[0-9a-f]{{64}}') THEN {sql_tidy(c)} END"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "snapshot_rows").where("pass_id IS NOT NULL AND path IS NOT NULL").select(
        "pass_id", tidy(F.col("side")).alias("side"), "path", "kind", "size", tidy(F.col("content_hash")).alias("content_hash"), "readonly", "tombstone", R.vector(F.col("version")).alias("vv")
    )
    return rows.withColumn("vtext", R.vector_text(F.col("vv"))).drop("vv")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' records, one row per (pass_id, side, path)."""
    rows = _placed(spark, sf_dir)
    best = F.max(F.struct(*(c for c in rows.columns if c not in ("pass_id", "side", "path")))).alias("_r")
    one = rows.groupBy("pass_id", "side", "path").agg(best).select("pass_id", "side", "path", "_r.*")
    return one.withColumn("vv", R.vector_of(F.col("vtext")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pass_id, path, l, r): the local and the remote record of every path, from one aggregation."""
    rows = _placed(spark, sf_dir).where("side IN ('local', 'remote')")
    return paired_sides(rows, ["pass_id", "path"], F.col("side") == "local")


def local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).where("side = 'local'").drop("side")


def remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).where("side = 'remote'").drop("side")


SNAP = f"""snap AS (SELECT DISTINCT pass_id, {sql_tidy('side')} AS side, path, kind, size, {sql_tidy('content_hash')} AS content_hash, readonly, tombstone,
    coalesce(array_to_string(list_sort(list_transform(list_filter(version, lambda e: e.counter > 0), lambda e: {sql_tidy('e.replica')} || '=' || e.counter)), ','), '') AS vtext
    FROM snapshot_rows WHERE pass_id IS NOT NULL AND path IS NOT NULL),
  l AS (SELECT * FROM snap WHERE side = 'local'), r AS (SELECT * FROM snap WHERE side = 'remote'),
  ent AS (SELECT pass_id, side, path, split_part(x, '=', 1) AS replica, CAST(split_part(x, '=', 2) AS BIGINT) AS n
          FROM (SELECT pass_id, side, path, unnest(string_split(vtext, ',')) AS x FROM snap WHERE vtext <> ''))"""

_SAME = "l.kind IS NOT DISTINCT FROM r.kind AND l.size IS NOT DISTINCT FROM r.size AND l.content_hash IS NOT DISTINCT FROM r.content_hash AND l.readonly IS NOT DISTINCT FROM r.readonly AND l.tombstone IS NOT DISTINCT FROM r.tombstone"

RELATION = f"""pairs AS (SELECT coalesce(a.pass_id, b.pass_id) AS pass_id, coalesce(a.path, b.path) AS path, coalesce(a.replica, b.replica) AS replica, coalesce(a.n, 0) AS ln, coalesce(b.n, 0) AS rn
    FROM (SELECT * FROM ent WHERE side = 'local') a FULL JOIN (SELECT * FROM ent WHERE side = 'remote') b ON a.pass_id = b.pass_id AND a.path = b.path AND a.replica = b.replica),
  vs AS (SELECT pass_id, path, bool_or(ln > rn) AS ahead, bool_or(rn > ln) AS behind,
         array_to_string(list_sort(list(replica || '=' || greatest(ln, rn))), ',') AS both_text FROM pairs GROUP BY ALL),
  j AS (SELECT coalesce(l.pass_id, r.pass_id) AS pass_id, coalesce(l.path, r.path) AS path, l.path IS NOT NULL AS in_l, r.path IS NOT NULL AS in_r,
          l.kind AS lk, r.kind AS rk, l.size AS ls, r.size AS rs, l.content_hash AS lh, r.content_hash AS rh, l.readonly AS lro, r.readonly AS rro, l.tombstone AS lt, r.tombstone AS rt, l.vtext AS lv, r.vtext AS rv,
          {_SAME} AS same FROM l FULL JOIN r ON l.pass_id = r.pass_id AND l.path = r.path),
  o AS (SELECT j.*, coalesce(both_text, '') AS both_text,
          CASE WHEN in_l AND in_r THEN CASE WHEN coalesce(ahead, false) AND coalesce(behind, false) THEN 'concurrent' WHEN coalesce(ahead, false) THEN 'after' WHEN coalesce(behind, false) THEN 'before' ELSE 'equal' END END AS relation
        FROM j LEFT JOIN vs ON j.pass_id = vs.pass_id AND j.path = vs.path),
  oc AS (SELECT *, CASE WHEN NOT in_r THEN 'left_only' WHEN NOT in_l THEN 'right_only' WHEN relation IN ('before', 'after') THEN relation
            WHEN relation = 'equal' THEN CASE WHEN same THEN 'equal' ELSE 'equal_clock_divergence' END ELSE CASE WHEN same THEN 'concurrent_same' ELSE 'concurrent_edit' END END AS outcome,
          sha256('state|' || coalesce(lk, '-') || '|' || coalesce(ls::VARCHAR, '-') || '|' || coalesce(lh, '-') || '|' || CASE WHEN lro THEN '1' ELSE '0' END || '|' || CASE WHEN lt THEN '1' ELSE '0' END) AS lsh,
          sha256('state|' || coalesce(rk, '-') || '|' || coalesce(rs::VARCHAR, '-') || '|' || coalesce(rh, '-') || '|' || CASE WHEN rro THEN '1' ELSE '0' END || '|' || CASE WHEN rt THEN '1' ELSE '0' END) AS rsh,
          sha256('record|' || path || '|' || coalesce(lk, '-') || '|' || coalesce(ls::VARCHAR, '-') || '|' || coalesce(lh, '-') || '|' || CASE WHEN lro THEN '1' ELSE '0' END || '|' || CASE WHEN lt THEN '1' ELSE '0' END || '|' || lv) AS llh,
          sha256('record|' || path || '|' || coalesce(rk, '-') || '|' || coalesce(rs::VARCHAR, '-') || '|' || coalesce(rh, '-') || '|' || CASE WHEN rro THEN '1' ELSE '0' END || '|' || CASE WHEN rt THEN '1' ELSE '0' END || '|' || rv) AS rlh
        FROM o)"""

#: Conflicts with the winner's and the loser's columns; the resolver's counter never occurs in the data, so it becomes 1.
CONFLICT = """w AS (SELECT *, CASE WHEN (NOT lt AND lk = 'directory') AND NOT (NOT rt AND rk = 'directory') THEN true WHEN (NOT rt AND rk = 'directory') AND NOT (NOT lt AND lk = 'directory') THEN false ELSE lsh >= rsh END AS lw
    FROM oc WHERE outcome IN ('equal_clock_divergence', 'concurrent_edit')),
  c AS (SELECT *, CASE WHEN lw THEN llh ELSE rlh END AS winner_hash, CASE WHEN lw THEN rlh ELSE llh END AS loser_hash,
          CASE WHEN lw THEN lk ELSE rk END AS wk, CASE WHEN lw THEN ls ELSE rs END AS ws, CASE WHEN lw THEN lh ELSE rh END AS wh, CASE WHEN lw THEN lro ELSE rro END AS wro, CASE WHEN lw THEN lt ELSE rt END AS wt,
          CASE WHEN lw THEN rk ELSE lk END AS xk, CASE WHEN lw THEN rs ELSE ls END AS xs, CASE WHEN lw THEN rh ELSE lh END AS xh, CASE WHEN lw THEN rro ELSE lro END AS xro, CASE WHEN lw THEN rt ELSE lt END AS xt,
          array_to_string(list_sort(list_append(list_filter(string_split(both_text, ','), lambda x: x <> ''), 'resolver=1')), ',') AS vtext FROM w),
  d AS (SELECT *, NOT xt AND xk = 'file' AND (wt OR wh IS DISTINCT FROM xh) AS kept, regexp_extract(path, '([^/]*)$', 1) AS nm, CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '' END AS above FROM c),
  e AS (SELECT *, CASE WHEN kept THEN above || CASE WHEN instr(nm[2:], '.') > 0 THEN regexp_replace(nm, '\\.[^.]*$', '') ELSE nm END || '.conflict-' || loser_hash[1:12] ||
          CASE WHEN instr(nm[2:], '.') > 0 THEN regexp_extract(nm, '(\\.[^.]*)$', 1) ELSE '' END END AS conflict_path FROM d)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index_records reduced to the highest generation of each (folder, snap_no, path)."""
    rows = table(spark, sf_dir, "index_records").where("folder IS NOT NULL AND snap_no IS NOT NULL AND path IS NOT NULL")
    fields = ["generation", "kind", "size", "content_hash", "readonly", "tombstone", "id_namespace", "id_object", "modified_ns", "collision_key"]
    best = F.max(F.struct(*fields)).alias("_r")
    return rows.withColumn("content_hash", tidy(F.col("content_hash"))).withColumn("tombstone", F.coalesce("tombstone", F.lit(False))).groupBy("folder", "snap_no", "path").agg(best).select("folder", "snap_no", "path", "_r.*")


RECORDS = f"""recs AS (SELECT folder, snap_no, path, kind, size, content_hash, readonly, tombstone, id_namespace, id_object, modified_ns, collision_key, generation FROM (
    SELECT folder, snap_no, path, kind, size, {sql_tidy('content_hash')} AS content_hash, readonly, coalesce(tombstone, false) AS tombstone, id_namespace, id_object, modified_ns, collision_key, generation,
           row_number() OVER (PARTITION BY folder, snap_no, path ORDER BY generation DESC NULLS LAST) AS k
    FROM index_records WHERE folder IS NOT NULL AND snap_no IS NOT NULL AND path IS NOT NULL) WHERE k = 1)"""


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each folder's last snapshot."""
    rows = records(spark, sf_dir)
    last = table(spark, sf_dir, "index_records").where("path IS NOT NULL").groupBy("folder").agg(F.max("snap_no").alias("snap_no"))
    return rows.join(last, ["folder", "snap_no"])


LATEST = f"""{RECORDS}, latest AS (SELECT recs.* FROM recs JOIN (SELECT folder, max(snap_no) AS snap_no FROM recs GROUP BY ALL) USING (folder, snap_no))"""


def steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(previous, current): the rows of the earlier and of the later snapshot of every step, under the later one's number."""
    rows = records(spark, sf_dir)
    from ..operators.snapdiff import snapshot_order

    order = snapshot_order(table(spark, sf_dir, "index_records"))
    previous = rows.join(order.where("next_no IS NOT NULL").select("folder", "snap_no", "next_no"), ["folder", "snap_no"]).withColumn("snap_no", F.col("next_no")).drop("next_no")
    current = rows.join(order.where("pos > 1").select("folder", "snap_no"), ["folder", "snap_no"])
    return previous, current


STEPS = f"""{RECORDS}, ord AS (SELECT folder, snap_no, lead(snap_no) OVER (PARTITION BY folder ORDER BY snap_no) AS next_no, row_number() OVER (PARTITION BY folder ORDER BY snap_no) AS pos FROM (SELECT DISTINCT folder, snap_no FROM recs)),
  prev AS (SELECT recs.* REPLACE (ord.next_no AS snap_no) FROM recs JOIN ord USING (folder, snap_no) WHERE next_no IS NOT NULL),
  cur AS (SELECT recs.* FROM recs JOIN ord USING (folder, snap_no) WHERE pos > 1)"""


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest arrival for each (path, idx), with tidy hashes; rows of no key are left out."""
    rows = table(spark, sf_dir, "extents").select("path", "idx", "chunk_offset", "length", F.lower(F.hex(digest_bytes(F.col("hash")))).alias("hash"), "arrival")
    keyed = rows.where("path IS NOT NULL AND idx IS NOT NULL AND hash IS NOT NULL")
    return keyed.groupBy("path", "idx").agg(F.max_by(F.struct("chunk_offset", "length", "hash"), "arrival").alias("e")).select("path", "idx", "e.*")


EXTENTS = f"""ext AS (SELECT path, idx, chunk_offset, length, hash FROM (SELECT path, idx, chunk_offset, length, {sql_key('hash')} AS hash, row_number() OVER (PARTITION BY path, idx ORDER BY arrival DESC) AS k
    FROM extents WHERE path IS NOT NULL AND idx IS NOT NULL AND {sql_key('hash')} IS NOT NULL) WHERE k = 1)"""


#: Needs EXTENTS.
MANIFESTS = """blk AS (SELECT path, idx // 4096 AS block, sha256(string_agg(chunk_offset || ':' || length || ':' || hash, ';' ORDER BY idx)) AS d, sum(length) AS s, count(*) AS n FROM ext GROUP BY ALL),
  mani AS (SELECT path, CAST(sum(s) AS BIGINT) AS size, CAST(sum(n) AS BIGINT) AS chunks, sha256('manifest|' || CAST(sum(s) AS BIGINT) || '|' || CAST(sum(n) AS BIGINT) || '|' || string_agg(d, ';' ORDER BY block)) AS manifest_hash FROM blk GROUP BY path)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct inventory digests with their length."""
    rows = table(spark, sf_dir, "inventory").select(F.lower(F.hex(digest_bytes(F.col("hash")))).alias("hash"), "length")
    return rows.where("hash IS NOT NULL").groupBy("hash").agg(F.max("length").alias("length"))


STORED = f"stored AS (SELECT {sql_key('hash')} AS hash, max(length) AS length FROM inventory WHERE {sql_key('hash')} IS NOT NULL GROUP BY ALL)"
