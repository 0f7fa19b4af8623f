"""Causal merge, conflicts, plans and gates, over the two sides of every pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import records as R
from ..functions.pyfuncs import collision_key
from ..operators import merge as M
from ..runtime import table
from .registry import Registry
from .relations import CONFLICT, RELATION, SNAP, local, pairs, remote, sides, sql_tidy

query = Registry()
KEYS = ["pass_id", "path"]
_OUT = f"WITH {SNAP}, {RELATION}"
_CON = f"WITH {SNAP}, {RELATION}, {CONFLICT}"


@query(_OUT + "SELECT outcome, count(*) AS n FROM oc GROUP BY ALL")
def causal_merge_outcomes(spark, sf_dir):
    return M.pair_outcomes(pairs(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"))


_RECORDS = """SELECT pass_id, path, CASE WHEN outcome IN ('left_only', 'after', 'equal', 'concurrent_same') THEN lk ELSE rk END AS kind, CASE WHEN outcome IN ('left_only', 'after', 'equal', 'concurrent_same') THEN ls ELSE rs END AS size,
  CASE WHEN outcome IN ('left_only', 'after', 'equal', 'concurrent_same') THEN lh ELSE rh END AS content_hash, CASE WHEN outcome IN ('left_only', 'after', 'equal', 'concurrent_same') THEN lro ELSE rro END AS readonly,
  CASE WHEN outcome IN ('left_only', 'after', 'equal', 'concurrent_same') THEN lt ELSE rt END AS tombstone,
  CASE WHEN outcome = 'concurrent_same' THEN both_text WHEN outcome IN ('left_only', 'after', 'equal') THEN lv ELSE rv END AS vtext, outcome FROM oc WHERE outcome NOT IN ('equal_clock_divergence', 'concurrent_edit')
UNION ALL SELECT pass_id, path, wk, ws, wh, wro, wt, vtext, outcome FROM e
UNION ALL SELECT pass_id, conflict_path, xk, xs, xh, xro, false, vtext, 'conflict_copy' FROM e WHERE kept"""


@query(_CON + _RECORDS)
def causal_merge_records(spark, sf_dir):
    records, _ = M.merge_pairs(pairs(spark, sf_dir), KEYS)
    return records.select("pass_id", "path", "kind", "size", "content_hash", "readonly", "tombstone", "vtext", "outcome")


@query(_CON + "SELECT pass_id, path, conflict_path, winner_hash, loser_hash, outcome AS reason FROM e")
def causal_conflicts(spark, sf_dir):
    return M.merge_pairs(pairs(spark, sf_dir), KEYS)[1]


@query(_CON + "SELECT pass_id, path, CASE WHEN conflict_path IS NULL THEN 'metadata' ELSE 'preserved_copy' END AS event FROM e")
def conflict_events(spark, sf_dir):
    conflicts = M.merge_pairs(pairs(spark, sf_dir), KEYS)[1]
    return conflicts.select("pass_id", "path", F.when(F.col("conflict_path").isNull(), "metadata").otherwise("preserved_copy").alias("event"))


@query(
    _OUT
    + """SELECT pass_id, count(*) FILTER (outcome IN ('equal', 'concurrent_same')) AS equal, count(*) FILTER (outcome IN ('left_only', 'after')) AS selected_left,
  count(*) FILTER (outcome IN ('right_only', 'before')) AS selected_right, count(*) FILTER (outcome IN ('equal_clock_divergence', 'concurrent_edit')) AS conflicts FROM oc GROUP BY ALL"""
)
def merge_stats(spark, sf_dir):
    return M.merge_stats(M.pair_outcomes(pairs(spark, sf_dir)), ["pass_id"])


@query(_OUT + "SELECT pass_id, path, relation, both_text AS merged_vector FROM oc WHERE relation IS NOT NULL")
def vector_relations(spark, sf_dir):
    pair = pairs(spark, sf_dir).where("l.here AND r.here")
    both = R.vector_text(R.merged(F.col("l.vv"), F.col("r.vv")))
    return pair.select(*KEYS, R.relation(F.col("l.vv"), F.col("r.vv")).alias("relation"), both.alias("merged_vector"))


@query(f"WITH {SNAP} SELECT pass_id, side, path, list_sum(list_transform(list_filter(string_split(vtext, ','), lambda x: x <> ''), lambda x: CAST(split_part(x, '=', 2) AS BIGINT)))::BIGINT AS total, len(list_filter(string_split(vtext, ','), lambda x: x <> '')) AS replicas FROM snap")
def vector_sizes(spark, sf_dir):
    total = F.aggregate(F.map_values("vv"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return sides(spark, sf_dir).select("pass_id", "side", "path", F.when(F.size("vv") > 0, total).alias("total"), F.size("vv").cast("bigint").alias("replicas"))


@query(_OUT + "SELECT pass_id, path, same FROM oc WHERE in_l AND in_r")
def same_state(spark, sf_dir):
    return pairs(spark, sf_dir).where("l.here AND r.here").select(*KEYS, R.same("l", "r").alias("same"))


_ACT = _OUT + ", act AS (SELECT pass_id, path, CASE WHEN rt THEN 'delete' ELSE 'materialize' END AS action, rk AS kind, rs AS size, rh AS content_hash, rro AS readonly, rt AS tombstone FROM oc WHERE in_r AND (NOT in_l OR NOT same OR lv <> rv)) "


@query(_ACT + "SELECT * FROM act")
def actions_to_reach(spark, sf_dir):
    return M.pair_actions(pairs(spark, sf_dir), KEYS)


@query(
    _ACT
    + """SELECT pass_id, path, action, phase, row_number() OVER (PARTITION BY pass_id ORDER BY phase, CASE phase WHEN 0 THEN -len(string_split(path, '/')) WHEN 1 THEN len(string_split(path, '/')) ELSE 0 END, path) AS position
  FROM (SELECT *, CASE WHEN action = 'delete' THEN 0 WHEN kind = 'directory' THEN 1 ELSE 2 END AS phase FROM act)"""
)
def apply_order(spark, sf_dir):
    from ..operators.ranking import number_rows

    ordered = M.apply_order(M.pair_actions(pairs(spark, sf_dir), KEYS))
    return number_rows(ordered, ["pass_id"], ["phase", "rank_depth", "path"], "position").select("pass_id", "path", "action", "phase", "position")


@query(_ACT + "SELECT pass_id, count(*) AS actions, count(*) FILTER (action = 'delete') AS deletions, CAST(coalesce(sum(size) FILTER (action = 'materialize' AND kind = 'file'), 0) AS BIGINT) AS pending_bytes FROM act GROUP BY ALL")
def pending_work(spark, sf_dir):
    acts = M.pair_actions(pairs(spark, sf_dir), KEYS)
    files = F.when((F.col("action") == "materialize") & (F.col("kind") == "file"), F.col("size"))
    return acts.groupBy("pass_id").agg(F.count("*").alias("actions"), F.count_if(F.col("action") == "delete").alias("deletions"), F.coalesce(F.sum(files), F.lit(0)).alias("pending_bytes"))


@query(_ACT + "SELECT pass_id, tombstone, kind, count(*) AS n FROM act GROUP BY ALL")
def action_groups(spark, sf_dir):
    return M.pair_actions(pairs(spark, sf_dir), KEYS).groupBy("pass_id", "tombstone", "kind").agg(F.count("*").alias("n"))


_REQ = _ACT + """, req AS (SELECT DISTINCT pass_id, content_hash FROM act WHERE action = 'materialize' AND kind = 'file' AND content_hash IS NOT NULL) """


@query(_REQ + "SELECT pass_id, content_hash FROM req")
def required_contents(spark, sf_dir):
    acts = M.pair_actions(pairs(spark, sf_dir), KEYS)
    return acts.where("action = 'materialize' AND kind = 'file' AND content_hash IS NOT NULL").select("pass_id", "content_hash").distinct()


@query(
    _REQ
    + """SELECT req.pass_id, req.content_hash, a.p AS local_path, b.p AS remote_path, CASE WHEN a.p IS NOT NULL THEN 'local' WHEN b.p IS NOT NULL THEN 'remote' ELSE 'missing' END AS source
  FROM req LEFT JOIN (SELECT pass_id, content_hash, min(path) AS p FROM l WHERE NOT tombstone AND kind = 'file' GROUP BY ALL) a ON a.pass_id = req.pass_id AND a.content_hash = req.content_hash
  LEFT JOIN (SELECT pass_id, content_hash, min(path) AS p FROM r WHERE NOT tombstone AND kind = 'file' GROUP BY ALL) b ON b.pass_id = req.pass_id AND b.content_hash = req.content_hash"""
)
def content_sources(spark, sf_dir):
    return M.content_sources(required_contents(spark, sf_dir), local(spark, sf_dir), remote(spark, sf_dir), ["pass_id"])


@query(
    f"""WITH {SNAP}, ll AS (SELECT * FROM l WHERE NOT tombstone), rr AS (SELECT * FROM r WHERE NOT tombstone),
 ch AS (SELECT coalesce(l.pass_id, r.pass_id) AS pass_id, coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'remove' ELSE 'install' END AS action, coalesce(r.kind, l.kind) AS kind
   FROM ll l FULL JOIN rr r ON l.pass_id = r.pass_id AND l.path = r.path WHERE l.path IS NULL OR r.path IS NULL OR NOT ((l.kind = 'directory' AND r.kind = 'directory')
     OR (l.kind IS NOT DISTINCT FROM r.kind AND l.size IS NOT DISTINCT FROM r.size AND l.content_hash IS NOT DISTINCT FROM r.content_hash AND l.readonly IS NOT DISTINCT FROM r.readonly)))
 SELECT * FROM ch WHERE NOT EXISTS (SELECT 1 FROM ch b WHERE b.pass_id = ch.pass_id AND (b.action = 'remove' OR b.kind <> 'directory') AND starts_with(ch.path, b.path || '/'))"""
)
def read_only_changes(spark, sf_dir):
    return M.pair_read_only_changes(pairs(spark, sf_dir), KEYS)


@query(_OUT + "SELECT pass_id, path, CASE WHEN NOT in_l OR relation = 'before' THEN 'accept' WHEN relation = 'after' THEN 'stale' WHEN relation = 'concurrent' THEN 'concurrent' WHEN same THEN 'accept' ELSE 'divergent' END AS verdict FROM oc WHERE in_r")
def causal_gate(spark, sf_dir):
    return M.pair_gate(pairs(spark, sf_dir), KEYS)


@query(_OUT + "SELECT * FROM (SELECT pass_id, path, CASE WHEN NOT in_r THEN 'missing' WHEN relation = 'after' THEN 'went_back' WHEN relation = 'concurrent' THEN 'concurrent' WHEN relation = 'equal' AND NOT same THEN 'changed_in_place' END AS violation FROM oc WHERE in_l) WHERE violation IS NOT NULL")
def checkpoint_violations(spark, sf_dir):
    return M.pair_checkpoint_violations(pairs(spark, sf_dir), KEYS)


_OWN = "own AS (SELECT min(replica) AS replica FROM ent), cap AS (SELECT pass_id, max(n) AS ceiling FROM ent, own WHERE ent.replica = own.replica AND side = 'local' GROUP BY ALL)"


@query(f"WITH {SNAP}, {_OWN} SELECT e.pass_id, e.path, e.n AS claimed FROM ent e JOIN own ON e.replica = own.replica LEFT JOIN cap ON cap.pass_id = e.pass_id WHERE e.side = 'remote' AND e.n > coalesce(cap.ceiling, 0)")
def counter_poisoning(spark, sf_dir):
    """Taking the least replica as this one: remote rows that claim more of its counter than the local side has given out."""
    both = sides(spark, sf_dir)
    entries = both.select("pass_id", "side", F.explode("vv").alias("replica", "n"))
    own = entries.agg(F.min("replica")).scalar()
    ceiling = entries.where((F.col("side") == "local") & (F.col("replica") == own)).groupBy("pass_id").agg(F.max("n").alias("ceiling"))
    incoming = both.where("side = 'remote'").join(ceiling, "pass_id", "left")
    return M.poisoned(incoming, KEYS, own, F.coalesce(F.col("ceiling"), F.lit(0)))


_PREFIX = "parts AS (SELECT pass_id, path, kind, string_split(path, '/') AS p FROM r WHERE NOT tombstone), pre AS (SELECT pass_id, path, array_to_string(p[1:i], '/') AS above, i < len(p) AS proper FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts))"


@query(f"WITH {SNAP}, {_PREFIX} SELECT DISTINCT pre.pass_id, pre.above AS path FROM pre WHERE proper AND NOT EXISTS (SELECT 1 FROM parts d WHERE d.pass_id = pre.pass_id AND d.path = pre.above AND d.kind = 'directory')")
def missing_ancestors(spark, sf_dir):
    return M.missing_ancestors(remote(spark, sf_dir), KEYS)


@query(None)
def namespace_issues(spark, sf_dir):
    return M.namespace_issues(remote(spark, sf_dir), KEYS, collision_key("path"))


@query(f"WITH {SNAP}, {_PREFIX} SELECT pass_id, path, len(string_split(path, '/')) AS depth, (SELECT count(*) FROM pre q WHERE q.pass_id = parts.pass_id AND q.path = parts.path) AS prefixes, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent FROM parts")
def path_parts(spark, sf_dir):
    live = remote(spark, sf_dir).where("NOT tombstone")
    p = F.col("path")
    return live.select("pass_id", "path", P.depth(p).cast("bigint").alias("depth"), F.size(P.ancestors(p)).cast("bigint").alias("prefixes"), P.name(p).alias("name"), P.parent(p).alias("parent"))


_T = sql_tidy


@query(
    f"""SELECT DISTINCT pass_id, {_T('verified_local_root')} IS NOT DISTINCT FROM {_T('verified_remote_root')} AS sides_agree, {_T('verified_local_root')} IS NOT DISTINCT FROM {_T('desired_root')} AS reached,
  {_T('local_before_root')} = {_T('remote_before_root')} AS nothing_to_do FROM sync_reports WHERE pass_id IS NOT NULL"""
)
def convergence(spark, sf_dir):
    from ..functions.text import tidy

    c = lambda n: tidy(F.col(n))
    return table(spark, sf_dir, "sync_reports").where("pass_id IS NOT NULL").select(
        "pass_id", c("verified_local_root").eqNullSafe(c("verified_remote_root")).alias("sides_agree"), c("verified_local_root").eqNullSafe(c("desired_root")).alias("reached"),
        (c("local_before_root") == c("remote_before_root")).alias("nothing_to_do"),
    ).distinct()


@query(f"WITH {SNAP} SELECT pass_id, side, path, CASE WHEN NOT tombstone AND kind = 'file' AND content_hash IS NULL THEN 'file_without_hash' WHEN NOT tombstone AND kind <> 'file' AND (size <> 0 OR content_hash IS NOT NULL) THEN 'payload_on_non_file' END AS issue FROM snap")
def record_validation(spark, sf_dir):
    issue = R.record_issue(F.col("kind"), F.col("size"), F.col("content_hash"), F.col("tombstone"))
    return sides(spark, sf_dir).select("pass_id", "side", "path", issue.alias("issue"))


@query(
    f"""WITH {SNAP} SELECT pass_id, side, path, sha256('state|' || coalesce(kind, '-') || '|' || coalesce(size::VARCHAR, '-') || '|' || coalesce(content_hash, '-') || '|' || CASE WHEN readonly THEN '1' ELSE '0' END || '|' || CASE WHEN tombstone THEN '1' ELSE '0' END) AS state_hash,
  sha256('record|' || path || '|' || coalesce(kind, '-') || '|' || coalesce(size::VARCHAR, '-') || '|' || coalesce(content_hash, '-') || '|' || CASE WHEN readonly THEN '1' ELSE '0' END || '|' || CASE WHEN tombstone THEN '1' ELSE '0' END || '|' || vtext) AS logical_hash FROM snap"""
)
def record_hashes(spark, sf_dir):
    return sides(spark, sf_dir).select("pass_id", "side", "path", R.state_hash().alias("state_hash"), R.logical_hash().alias("logical_hash"))


@query(f"WITH {SNAP}, {_OWN} SELECT snap.pass_id, snap.path, coalesce(cap.ceiling, 0) + 1 AS counter FROM snap, own LEFT JOIN cap ON cap.pass_id = snap.pass_id WHERE side = 'remote' AND kind = 'file' AND NOT tombstone")
def adoption(spark, sf_dir):
    """A directly pushed file taken into the index: this replica's next counter, seen in the adopted row's vector."""
    both = sides(spark, sf_dir)
    entries = both.select("pass_id", "side", F.explode("vv").alias("replica", "n"))
    own = entries.agg(F.min("replica")).scalar()
    ceiling = entries.where((F.col("side") == "local") & (F.col("replica") == own)).groupBy("pass_id").agg(F.max("n").alias("ceiling"))
    pushed = both.where("side = 'remote' AND kind = 'file' AND NOT tombstone").join(ceiling, "pass_id", "left")
    counter = F.coalesce(F.col("ceiling"), F.lit(0)) + 1
    taken = pushed.withColumn("_own", own).withColumn("counter", counter).withColumn("vv", R.observed(F.col("vv"), F.col("_own"), F.col("counter")))
    return taken.select("pass_id", "path", F.greatest(F.col("counter"), F.lit(0)).alias("counter"))


@query(
    _OUT
    + """SELECT pass_id, path, CASE WHEN NOT in_l AND NOT in_r THEN 'apply' WHEN NOT in_l THEN CASE WHEN rt THEN 'apply' ELSE 'drift' END WHEN NOT in_r THEN 'drift'
  WHEN lt AND rt THEN 'apply' WHEN same AND NOT lt THEN 'apply' ELSE 'drift' END AS precondition FROM oc"""
)
def apply_preconditions(spark, sf_dir):
    """Local rows as observed, remote rows as indexed: may a change be applied over what is there?"""
    pair = pairs(spark, sf_dir)
    verdict = (
        F.when(F.col("l.here").isNull(), F.when(F.col("r.tombstone"), "apply").otherwise("drift")).when(F.col("r.here").isNull(), "drift")
        .when(F.col("l.tombstone") & F.col("r.tombstone"), "apply").when(R.same("l", "r") & ~F.col("l.tombstone"), "apply").otherwise("drift")
    )
    return pair.select(*KEYS, verdict.alias("precondition"))
