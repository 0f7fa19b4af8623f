"""Scans, indexes, trees: over the folders' snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import records as R
from ..functions.pyfuncs import collision_key
from ..functions.text import tidy
from ..operators import merkle, scan
from ..operators.ranking import number_rows
from ..runtime import cut, table
from .registry import Registry
from .relations import LATEST, RECORDS, STEPS, latest, records, sql_tidy, steps

query = Registry()
KEYS = ["folder", "snap_no", "path"]

_OWN = "sha256('state|' || coalesce(kind, '-') || '|' || coalesce(size::VARCHAR, '-') || '|' || coalesce(content_hash, '-') || '|' || CASE WHEN readonly THEN '1' ELSE '0' END || '|' || CASE WHEN tombstone THEN '1' ELSE '0' END)"


def _tree_sql(source: str, prefix: str, group: str) -> str:
    """Every prefix with the word-wise sum of the digests below it."""
    g = ", ".join(group.split())
    words = ", ".join(f"('0x' || substring(d, {8 * i + 1}, 8))::BIGINT AS w{i}" for i in range(8))
    text = " || ".join(f"lpad(to_hex(CAST(sum(w{i}) % 4294967296 AS BIGINT)), 8, '0')" for i in range(8))
    return f"""{prefix}leaf AS (SELECT {g}, path, own_hash, {words} FROM (SELECT *, sha256('node|' || path || '|' || own_hash) AS d FROM (SELECT {g}, path, {_OWN} AS own_hash FROM {source}))),
 {prefix}spots AS (SELECT *, array_to_string(string_split(path, '/')[1:i], '/') AS prefix, i AS depth FROM (SELECT *, unnest(range(0, len(string_split(path, '/')) + 1)) AS i FROM {prefix}leaf)),
 {prefix}tree AS (SELECT {g}, prefix, CASE WHEN depth = 0 THEN NULL WHEN contains(prefix, '/') THEN regexp_replace(prefix, '/[^/]*$', '') ELSE '' END AS parent, depth, max(own_hash) FILTER (prefix = path AND depth > 0) AS own_hash,
   lower({text}) AS hash, count(*) AS record_count FROM {prefix}spots GROUP BY {g}, prefix, depth)"""


_TREE = f"WITH {LATEST}, {_tree_sql('latest', '', 'folder')} "


_TREE_ROOTS = _TREE + "SELECT folder, hash AS root_hash, record_count FROM tree WHERE depth = 0"


_MATCH = " AND ".join(f"p.{f} IS NOT DISTINCT FROM c.{f}" for f in ("kind", "id_namespace", "id_object", "size", "modified_ns", "readonly", "content_hash"))


def _changes_sql(unread: str | None = None) -> str:
    """The scan's rule by steps: match, what vanished and what is new, the identities that only one of each has, and what is left."""
    kept = f"(path = '{unread}' OR starts_with(path, '{unread}/'))" if unread else "false"
    return f"""WITH {STEPS}, vanished AS (SELECT * FROM prev WHERE NOT tombstone AND NOT EXISTS (SELECT 1 FROM cur c WHERE NOT c.tombstone AND c.folder = prev.folder AND c.snap_no = prev.snap_no AND c.path = prev.path)),
  gone AS (SELECT * FROM vanished WHERE NOT {kept}),
  fresh AS (SELECT * FROM cur WHERE NOT tombstone AND NOT EXISTS (SELECT 1 FROM prev p WHERE NOT p.tombstone AND p.folder = cur.folder AND p.snap_no = cur.snap_no AND p.path = cur.path)),
  one_gone AS (SELECT * FROM gone WHERE id_namespace IS NOT NULL AND id_object IS NOT NULL QUALIFY count(*) OVER (PARTITION BY folder, snap_no, kind, id_namespace, id_object) = 1),
  one_fresh AS (SELECT * FROM fresh WHERE id_namespace IS NOT NULL AND id_object IS NOT NULL QUALIFY count(*) OVER (PARTITION BY folder, snap_no, kind, id_namespace, id_object) = 1),
  moved AS (SELECT p.folder, p.snap_no, p.path, c.path AS to_path, p.generation AS version FROM one_gone p JOIN one_fresh c ON p.folder = c.folder AND p.snap_no = c.snap_no AND {_MATCH}),
  ch AS (SELECT p.folder, p.snap_no, p.path, CASE WHEN {_MATCH} THEN 'unchanged' ELSE 'modified' END AS change, NULL AS to_path, p.generation AS version
           FROM prev p JOIN cur c ON p.folder = c.folder AND p.snap_no = c.snap_no AND p.path = c.path WHERE NOT p.tombstone AND NOT c.tombstone
         UNION ALL SELECT f.folder, f.snap_no, f.path, 'created', NULL, coalesce(p.generation, 0) FROM fresh f LEFT JOIN prev p ON p.folder = f.folder AND p.snap_no = f.snap_no AND p.path = f.path
           WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.folder = f.folder AND m.snap_no = f.snap_no AND m.to_path = f.path)
         UNION ALL SELECT folder, snap_no, path, 'deleted', NULL, generation FROM gone WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.folder = gone.folder AND m.snap_no = gone.snap_no AND m.path = gone.path)
         UNION ALL SELECT folder, snap_no, path, 'preserved', NULL, generation FROM vanished WHERE {kept}
         UNION ALL SELECT folder, snap_no, path, 'renamed', to_path, version FROM moved)"""


_CHANGES = _changes_sql()


def _steps(spark, sf_dir):
    """A stored row's generation stands for the counter that this replica's entry in its version has."""
    previous, current = steps(spark, sf_dir)
    return previous.withColumn("version", F.col("generation")), current


def _changes(spark, sf_dir):
    return scan.scan_changes(*_steps(spark, sf_dir), KEYS)


@query(_CHANGES + " SELECT folder, snap_no, path, change, to_path FROM ch WHERE change <> 'unchanged'")
def scan_changes(spark, sf_dir):
    return _changes(spark, sf_dir).where("change <> 'unchanged'").select(*KEYS, "change", "to_path")


_HASHED = f"""todo AS (SELECT c.folder, c.snap_no, c.path FROM cur c LEFT JOIN prev p ON p.folder = c.folder AND p.snap_no = c.snap_no AND p.path = c.path WHERE NOT c.tombstone AND c.kind = 'file'
   AND NOT coalesce(NOT p.tombstone AND {_MATCH.rsplit(' AND ', 1)[0]} AND p.content_hash IS NOT NULL, false))"""
_RETRIES = "retry AS (SELECT folder, snap_no, path, generation % 4 + 1 AS attempts, (generation % 7 + snap_no) * 1000 AS not_before_ms, 'error ' || generation AS last_error FROM prev WHERE generation % 5 = 0)"


def _retries(previous):
    """Retries as an earlier scan might have left them: every fifth generation failed."""
    g = F.col("generation")
    return previous.where(g % 5 == 0).select(*KEYS, (g % 4 + 1).alias("attempts"), ((g % 7 + F.col("snap_no")) * 1000).alias("not_before_ms"), F.concat(F.lit("error "), g.cast("string")).alias("last_error"))


@query(_CHANGES + f""", {_HASHED}, {_RETRIES} SELECT ch.folder, ch.snap_no, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'created') AS created, count(*) FILTER (change = 'modified') AS modified,
 count(*) FILTER (change = 'renamed') AS renamed, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change <> 'deleted') AS live,
 (SELECT count(*) FROM todo WHERE todo.folder = ch.folder AND todo.snap_no = ch.snap_no) AS files_hashed, (SELECT count(*) FROM retry WHERE retry.folder = ch.folder AND retry.snap_no = ch.snap_no) AS retries_queued FROM ch GROUP BY ch.folder, ch.snap_no""")
def scan_report(spark, sf_dir):
    previous, current = _steps(spark, sf_dir)
    hashed = scan.reuse_hashes(previous, current, KEYS).where("decision = 'hash'")
    return scan.scan_report(scan.scan_changes(previous, current, KEYS), hashed, _retries(previous), ["folder", "snap_no"])


_ORDERED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, snap_no ORDER BY (change = 'deleted')::INT, coalesce(to_path, path)) AS n FROM ch WHERE change NOT IN ('unchanged', 'preserved')),
 counted AS (SELECT *, CAST(n + greatest(snap_no * 2, max(version - n + 1) OVER (PARTITION BY folder, snap_no ORDER BY n)) AS BIGINT) AS counter FROM ranked)"""


@query(_CHANGES + f", {_ORDERED} SELECT folder, snap_no, path, change, to_path, counter FROM counted")
def counter_assignment(spark, sf_dir):
    """From a stored counter of twice the step's number."""
    return scan.counter_assignment(_changes(spark, sf_dir), ["folder", "snap_no"], F.col("snap_no") * 2).select(*KEYS, "change", "to_path", "counter")


_FIELDS = ("kind", "id_namespace", "id_object", "size", "modified_ns", "readonly", "content_hash")


def _shown(side, field):
    return f"{side}.{field}::VARCHAR AS {field}" if field == "modified_ns" else f"{side}.{field}"


@query(_CHANGES + f""", {_ORDERED}, marks AS (SELECT folder, snap_no, coalesce(to_path, path) AS path, change <> 'deleted' AS stays, counter FROM counted UNION ALL SELECT folder, snap_no, path, false, counter FROM counted WHERE change = 'renamed')
SELECT m.folder, m.snap_no, m.path, {', '.join(_shown('c', f) for f in _FIELDS)}, false AS tombstone, m.counter AS version FROM marks m JOIN cur c ON c.folder = m.folder AND c.snap_no = m.snap_no AND c.path = m.path WHERE stays AND NOT c.tombstone
UNION ALL SELECT p.folder, p.snap_no, p.path, {', '.join(_shown('p', f) for f in _FIELDS)}, p.tombstone OR m.counter IS NOT NULL, coalesce(m.counter, p.generation, 0) FROM prev p LEFT JOIN marks m ON p.folder = m.folder AND p.snap_no = m.snap_no AND p.path = m.path WHERE m.stays IS NOT TRUE""")
def scan_commit(spark, sf_dir):
    """The whole scan as one job: changes with renames, counters, and the index that is stored after it."""
    previous, current = _steps(spark, sf_dir)
    numbered = scan.counter_assignment(scan.scan_changes(previous, current, KEYS), ["folder", "snap_no"], F.col("snap_no") * 2)
    return scan.next_records(previous, current, numbered, KEYS).withColumn("modified_ns", F.col("modified_ns").cast("string"))


@query(_CHANGES + ", named AS (SELECT folder, snap_no, path, change FROM ch WHERE change NOT IN ('unchanged', 'preserved')) SELECT *, row_number() OVER (PARTITION BY folder ORDER BY snap_no, path, change) AS position FROM named")
def change_order(spark, sf_dir):
    """A report's changes by path, then kind."""
    named = _changes(spark, sf_dir).where("change <> 'unchanged'").select(*KEYS, "change")
    return number_rows(named, ["folder"], ["snap_no", "path", "change"], "position")


_UNREAD = _changes_sql("inbox")


@query(_UNREAD + " SELECT folder, snap_no, path FROM ch WHERE change = 'deleted'")
def deleted_paths(spark, sf_dir):
    """Deletions that are no renames; the folder 'inbox' counts as unreadable, so what vanished below it is kept."""
    return scan.deletions(_unread_changes(spark, sf_dir), KEYS)


def _unread(current):
    return current.select("folder", "snap_no").distinct().withColumn("prefix", F.lit("inbox"))


def _unread_changes(spark, sf_dir):
    previous, current = _steps(spark, sf_dir)
    return scan.scan_changes(previous, current, KEYS, _unread(current))


@query(f"WITH {STEPS}, {_HASHED}, {_RETRIES} SELECT todo.*, CASE WHEN not_before_ms > todo.snap_no * 1000 + 2500 THEN 'defer' ELSE 'hash' END AS turn FROM todo LEFT JOIN retry ON retry.folder = todo.folder AND retry.snap_no = todo.snap_no AND retry.path = todo.path")
def deferred_files(spark, sf_dir):
    """Which files a scan reads now, and which wait for their time to be tried again."""
    previous, current = _steps(spark, sf_dir)
    wanted = scan.reuse_hashes(previous, current, KEYS).where("decision = 'hash'").select(*KEYS)
    return scan.deferred(wanted, _retries(previous), KEYS, F.col("snap_no") * 1000 + 2500)


@query(_UNREAD + f""", {_RETRIES}, bad AS (SELECT folder, snap_no, path FROM cur WHERE NOT tombstone AND generation % 3 = 0), ended AS (SELECT folder, snap_no, path FROM ch WHERE change IN ('deleted', 'renamed') UNION SELECT folder, snap_no, to_path FROM ch WHERE change = 'renamed'
   UNION SELECT folder, snap_no, path FROM cur WHERE NOT tombstone AND coalesce(generation % 3 <> 0, true)),
 kept AS (SELECT * FROM retry r WHERE (EXISTS (SELECT 1 FROM cur c WHERE NOT c.tombstone AND c.folder = r.folder AND c.snap_no = r.snap_no AND c.path = r.path) OR path = 'inbox' OR starts_with(path, 'inbox/'))
   AND NOT EXISTS (SELECT 1 FROM ended e WHERE e.folder = r.folder AND e.snap_no = r.snap_no AND e.path = r.path))
SELECT coalesce(k.folder, b.folder) AS folder, coalesce(k.snap_no, b.snap_no) AS snap_no, coalesce(k.path, b.path) AS path, CAST(CASE WHEN b.path IS NULL THEN attempts ELSE coalesce(attempts, 0) + 1 END AS BIGINT) AS attempts,
  CAST(CASE WHEN b.path IS NULL THEN not_before_ms ELSE b.snap_no * 1000 + least(500 * power(2, least(coalesce(attempts, 0), 31)), 300000) END AS BIGINT) AS not_before_ms, CASE WHEN b.path IS NULL THEN last_error ELSE 'unreadable' END AS last_error
FROM kept k FULL JOIN bad b ON k.folder = b.folder AND k.snap_no = b.snap_no AND k.path = b.path""")
def retry_queue(spark, sf_dir):
    """The retries after a scan in which every third generation couldn't be read."""
    previous, current = _steps(spark, sf_dir)
    live = current.where(~F.col("tombstone"))
    failed = F.coalesce(F.col("generation") % 3 == 0, F.lit(False))
    failures = live.where(failed).select(*KEYS, F.lit("unreadable").alias("last_error"))
    seen = live.select(*KEYS, (~failed).alias("ok"))
    return scan.next_retries(_retries(previous), seen, _unread(current), _unread_changes(spark, sf_dir), failures, KEYS, F.col("snap_no") * 1000)


@query(
    f"""WITH {STEPS} SELECT c.folder, c.snap_no, c.path, CASE WHEN c.kind <> 'file' THEN 'none' WHEN d THEN 'reuse' ELSE 'hash' END AS decision, CASE WHEN c.kind = 'file' AND d THEN ph END AS content_hash FROM (
  SELECT c.*, p.content_hash AS ph, coalesce(NOT p.tombstone AND {_MATCH.rsplit(' AND ', 1)[0]} AND p.content_hash IS NOT NULL, false) AS d FROM cur c LEFT JOIN prev p ON p.folder = c.folder AND p.snap_no = c.snap_no AND p.path = c.path WHERE NOT c.tombstone) c"""
)
def incremental_hash_reuse(spark, sf_dir):
    return scan.reuse_hashes(*steps(spark, sf_dir), KEYS)


@query(f"WITH {RECORDS}, live AS (SELECT DISTINCT folder, snap_no, {sql_tidy('collision_key')} AS ckey, path FROM recs WHERE NOT tombstone AND collision_key IS NOT NULL) SELECT *, count(*) OVER (PARTITION BY folder, snap_no, ckey) AS members FROM live QUALIFY members > 1")
def collision_groups(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("ckey", tidy(F.col("collision_key")))
    return scan.collision_groups(rows, ["folder", "snap_no"], "ckey")


@query(None)
def stale_collision_keys(spark, sf_dir):
    """Stored keys that aren't the folded form of their path."""
    rows = records(spark, sf_dir).select("path", "collision_key").distinct().withColumn("expected", collision_key("path"))
    return rows.where(~F.col("collision_key").eqNullSafe(F.col("expected")))


@query(f"WITH {LATEST} SELECT path, regexp_full_match(path, '[ -~]*') AS is_ascii, CASE WHEN regexp_full_match(path, '[ -~]*') THEN lower(path) END AS folded FROM (SELECT DISTINCT path FROM latest)")
def ascii_collision_keys(spark, sf_dir):
    """Every path's folded form, shown where SQL has one too."""
    ascii_only = F.col("path").rlike("^[ -~]*$")
    keyed = latest(spark, sf_dir).select("path").distinct().select("path", ascii_only.alias("is_ascii"), collision_key("path").alias("folded"))
    return keyed.withColumn("folded", F.when(F.col("is_ascii"), F.col("folded")))


@query(f"WITH {STEPS} SELECT c.folder, c.snap_no, c.path, c.kind, c.size, c.content_hash FROM cur c LEFT JOIN prev p ON p.folder = c.folder AND p.snap_no = c.snap_no AND p.path = c.path WHERE p.path IS NULL OR p.kind IS DISTINCT FROM c.kind OR p.size IS DISTINCT FROM c.size OR p.content_hash IS DISTINCT FROM c.content_hash")
def commit_delta(spark, sf_dir):
    return scan.state_delta(*steps(spark, sf_dir), KEYS, ("kind", "size", "content_hash"))


@query(f"WITH {LATEST} SELECT folder, count(*) FILTER (NOT tombstone) AS live, count(*) FILTER (tombstone) AS tombstones, count(*) FILTER (NOT tombstone AND kind = 'file') AS files, CAST(coalesce(sum(size) FILTER (NOT tombstone AND kind = 'file'), 0) AS BIGINT) AS bytes, count(*) FILTER (generation % 5 = 0) AS retries FROM latest GROUP BY ALL")
def inventory(spark, sf_dir):
    rows = latest(spark, sf_dir)
    return scan.inventory(rows, rows.where("generation % 5 = 0").select("folder", "path"), ["folder"])


@query(_TREE_ROOTS)
def snapshot_precondition(spark, sf_dir):
    """Every folder's last snapshot read again before it would be changed; had it another root or number of rows, this would be an error."""
    rows = latest(spark, sf_dir)
    expected = cut(merkle.roots(rows, ["folder"], R.state_hash()))
    return merkle.checked_snapshot(rows, ["folder"], R.state_hash(), expected)


@query("SELECT folder, snap_no, path, count(*) AS n FROM index_records WHERE path IS NOT NULL AND folder IS NOT NULL AND snap_no IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_paths(spark, sf_dir):
    placed = table(spark, sf_dir, "index_records").where("path IS NOT NULL AND folder IS NOT NULL AND snap_no IS NOT NULL")
    return placed.groupBy("folder", "snap_no", "path").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {STEPS} SELECT 'only_before' AS side, folder, snap_no, path FROM prev WHERE NOT tombstone AND NOT EXISTS (SELECT 1 FROM cur c WHERE c.folder = prev.folder AND c.snap_no = prev.snap_no AND c.path = prev.path AND NOT c.tombstone) UNION ALL SELECT 'only_after', folder, snap_no, path FROM cur WHERE NOT tombstone AND NOT EXISTS (SELECT 1 FROM prev p WHERE p.folder = cur.folder AND p.snap_no = cur.snap_no AND p.path = cur.path AND NOT p.tombstone)")
def path_set_equality(spark, sf_dir):
    """Paths by which the live sets of a step differ; empty if they are equal."""
    p, c = (s.where("NOT tombstone").select(*KEYS) for s in steps(spark, sf_dir))
    return p.join(c, KEYS, "left_anti").select(F.lit("only_before").alias("side"), *KEYS).unionByName(c.join(p, KEYS, "left_anti").select(F.lit("only_after").alias("side"), *KEYS))


@query(f"WITH {LATEST} SELECT folder, path FROM latest WHERE NOT (path = 'inbox' OR starts_with(path, 'inbox/') OR path = 'drafts' OR starts_with(path, 'drafts/'))")
def unignored_paths(spark, sf_dir):
    ignored = P.under(F.col("path"), F.lit("inbox")) | P.under(F.col("path"), F.lit("drafts"))
    return latest(spark, sf_dir).where(~ignored).select("folder", "path")


@query(f"WITH {LATEST} SELECT folder, kind, CASE WHEN kind = 'file' THEN size ELSE 0 END AS size, CASE WHEN kind = 'file' THEN modified_ns::VARCHAR END AS modified_ns, CASE WHEN kind = 'file' THEN readonly ELSE false END AS readonly, path FROM latest WHERE NOT tombstone")
def metadata_fingerprints(spark, sf_dir):
    file = F.col("kind") == "file"
    return latest(spark, sf_dir).where("NOT tombstone").select(
        "folder", "path", "kind", F.when(file, F.col("size")).otherwise(F.lit(0)).alias("size"), F.when(file, F.col("modified_ns").cast("string")).alias("modified_ns"), F.when(file, F.col("readonly")).otherwise(F.lit(False)).alias("readonly")
    )


@query(f"""WITH {STEPS} SELECT c.folder, c.snap_no, c.path, coalesce(p.modified_ns = c.modified_ns, false) AS time_reliable, coalesce(p.modified_ns = c.modified_ns, false) AND p.size IS NOT DISTINCT FROM c.size AND p.readonly IS NOT DISTINCT FROM c.readonly AND p.content_hash IS NOT DISTINCT FROM c.content_hash
 AND p.id_namespace IS NOT DISTINCT FROM c.id_namespace AND p.id_object IS NOT DISTINCT FROM c.id_object AS trusted FROM cur c JOIN prev p ON p.folder = c.folder AND p.snap_no = c.snap_no AND p.path = c.path""")
def trusted_observations(spark, sf_dir):
    """The earlier row as the observation, the later one as metadata and as record; its time of modification also stands for that of change."""
    previous, current = steps(spark, sf_dir)
    fields = ("size", "readonly", "modified_ns", F.col("modified_ns").alias("changed_ns"), "id_namespace", "id_object", "content_hash")
    both = scan.joined(previous, current, KEYS, fields).where("p.here AND c.here")
    return both.select(*KEYS, R.both_known_and_equal(F.col("p.modified_ns"), F.col("c.modified_ns")).alias("time_reliable"), R.trusts("p", "c", "c").alias("trusted"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed FROM events), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
SELECT user_id, event_id, attempts, CAST(least(500 * power(2, least(attempts - 1, 31)), 300000) AS BIGINT) AS delay_ms, (epoch_us(ts) // 1000) + CAST(least(500 * power(2, least(attempts - 1, 31)), 300000) AS BIGINT) AS not_before_ms
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run, failed ORDER BY ts, event_id) AS attempts FROM g) WHERE failed""")
def retry_backoff(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    runs = scan.failure_runs(events, "user_id", ["ts", "event_id"], F.col("failed"))
    return runs.select("user_id", "event_id", "attempts", "delay_ms", (F.unix_millis("ts") + F.col("delay_ms")).alias("not_before_ms"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed FROM events), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
r AS (SELECT user_id, (epoch_us(ts) // 1000) + CAST(least(500 * power(2, least(attempts - 1, 31)), 300000) AS BIGINT) AS nb FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run, failed ORDER BY ts, event_id) AS attempts FROM g) WHERE failed)
SELECT user_id, max(nb) AS not_before_ms, (SELECT max((epoch_us(ts) // 1000)) FROM events) >= max(nb) AS due FROM r GROUP BY ALL""")
def retry_due(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).scalar()
    last = retry_backoff(spark, sf_dir).groupBy("user_id").agg(F.max("not_before_ms").alias("not_before_ms"))
    return last.withColumn("due", now >= F.col("not_before_ms"))


@query("SELECT folder, snap_no, path, kind, size FROM index_records WHERE path = (SELECT min(path) FROM index_records)")
def point_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "index_records")
    return rows.where(F.col("path") == rows.agg(F.min("path")).scalar()).select("folder", "snap_no", "path", "kind", "size")


_PATHS = "(SELECT DISTINCT path FROM index_records WHERE path IS NOT NULL UNION SELECT p_name || CASE p_partkey % 9 WHEN 0 THEN '.' WHEN 1 THEN '/CON.txt' WHEN 2 THEN '/../x' WHEN 3 THEN '//a' WHEN 4 THEN '\\b' WHEN 5 THEN '/lpt3' WHEN 6 THEN '/a?b' WHEN 7 THEN '/' || repeat('n', 256) ELSE '/ok' END FROM part)"


@query(
    f"""SELECT path, CASE WHEN path = '' THEN 'empty' WHEN octet_length(encode(path)) > 4096 THEN 'too_long' WHEN starts_with(path, '/') OR contains(path, '\\') THEN 'not_relative'
  WHEN len(list_filter(string_split(path, '/'), lambda c: c IN ('', '.', '..') OR suffix(c, '.') OR suffix(c, ' ') OR regexp_matches(c, '[<>:"|?*\\x00-\\x1f\\x7f]'))) > 0 THEN 'component'
  WHEN len(list_filter(string_split(path, '/'), lambda c: octet_length(encode(c)) > 255)) > 0 THEN 'component_too_long'
  WHEN len(list_filter(string_split(path, '/'), lambda c: upper(rtrim(split_part(c, '.', 1), ' ')) IN ('CON', 'PRN', 'AUX', 'NUL', 'CLOCK$', 'CONIN$', 'CONOUT$') OR regexp_full_match(upper(rtrim(split_part(c, '.', 1), ' ')), '(COM|LPT)[1-9¹²³]'))) > 0 THEN 'reserved' END AS issue FROM {_PATHS}"""
)
def path_validation(spark, sf_dir):
    bad = F.when(F.col("k") == 0, ".").when(F.col("k") == 1, "/CON.txt").when(F.col("k") == 2, "/../x").when(F.col("k") == 3, "//a").when(F.col("k") == 4, "\\b").when(F.col("k") == 5, "/lpt3").when(F.col("k") == 6, "/a?b").when(F.col("k") == 7, F.concat(F.lit("/"), F.lit("n" * 256))).otherwise("/ok")
    made = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 9).select(F.concat("p_name", bad).alias("path"))
    rows = table(spark, sf_dir, "index_records").where("path IS NOT NULL").select("path").unionByName(made).distinct()
    return rows.select("path", P.path_issue(F.col("path")).alias("issue"))


@query(f"""WITH {LATEST} SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '' END || CASE WHEN instr(nm[2:], '.') > 0 THEN regexp_replace(nm, '\\.[^.]*$', '') ELSE nm END || '.conflict-abc123' || CASE WHEN instr(nm[2:], '.') > 0 THEN regexp_extract(nm, '(\\.[^.]*)$', 1) ELSE '' END AS copy
FROM (SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS nm FROM latest)""")
def conflict_names(spark, sf_dir):
    return latest(spark, sf_dir).select("path").distinct().select("path", P.conflict_path(F.col("path"), F.lit("abc123")).alias("copy"))


@query(_TREE + "SELECT folder, prefix, parent, depth, own_hash, hash, record_count FROM tree")
def merkle_nodes(spark, sf_dir):
    return merkle.nodes(latest(spark, sf_dir), ["folder"], R.state_hash())


@query(_TREE_ROOTS)
def merkle_root(spark, sf_dir):
    return merkle.roots(latest(spark, sf_dir), ["folder"], R.state_hash())


@query(_TREE + "SELECT folder, parent, regexp_extract(prefix, '([^/]*)$', 1) AS name, hash, record_count FROM tree WHERE parent IS NOT NULL")
def node_children(spark, sf_dir):
    return merkle.children(merkle_nodes(spark, sf_dir), ["folder"])


_DAMAGED = """summ AS (SELECT folder, prefix, CASE WHEN own_hash IS NULL THEN NULL WHEN starts_with(hash, '00') THEN prefix || 'x' ELSE prefix END AS record_path, record_count + CASE WHEN starts_with(hash, 'f1') THEN 1 ELSE 0 END AS record_count FROM tree),
 kids AS (SELECT folder, parent AS prefix, regexp_extract(prefix, '([^/]*)$', 1) AS name, hash, record_count FROM tree WHERE parent IS NOT NULL),
 sent AS (SELECT folder, prefix, CASE WHEN starts_with(hash, '0a') THEN name || '/..' ELSE name END AS name, CASE WHEN starts_with(hash, '0b') THEN 0 ELSE record_count END AS record_count,
   row_number() OVER (PARTITION BY folder, prefix ORDER BY CASE WHEN starts_with(hash, '0c') THEN '' ELSE name END, name) - 1 AS ordinal FROM kids)"""


@query(_TREE + f""", {_DAMAGED} SELECT DISTINCT folder, prefix, issue FROM (
  SELECT folder, prefix, 'empty' AS issue FROM sent WHERE record_count <= 0 UNION ALL SELECT folder, prefix, 'record' FROM summ WHERE record_path <> prefix
  UNION ALL SELECT folder, prefix, 'name' FROM sent WHERE contains(name, '/') OR suffix(name, '.') OR suffix(name, ' ') OR regexp_matches(name, '[<>:"|?*\\x00-\\x1f\\x7f\\\\]') OR octet_length(encode(name)) > 255 OR regexp_full_match(upper(rtrim(split_part(name, '.', 1), ' ')), 'CON|PRN|AUX|NUL|CLOCK\\$|CONIN\\$|CONOUT\\$|(COM|LPT)[1-9¹²³]')
  UNION ALL SELECT folder, prefix, 'order' FROM (SELECT *, lag(name) OVER (PARTITION BY folder, prefix ORDER BY ordinal) AS before FROM sent) WHERE before >= name
  UNION ALL SELECT s.folder, s.prefix, 'count' FROM summ s LEFT JOIN (SELECT folder, prefix, sum(record_count) AS n FROM sent GROUP BY ALL) k ON k.folder = s.folder AND k.prefix = s.prefix WHERE s.record_count <> coalesce(k.n, 0) + CASE WHEN s.record_path IS NULL THEN 0 ELSE 1 END)""")
def snapshot_summary_violations(spark, sf_dir):
    """Over summaries as a faulty peer might send them: by a node's hash, records of another path, children out of order, wrong counts and names."""
    tree = cut(merkle_nodes(spark, sf_dir))
    bad = lambda p: F.startswith("hash", F.lit(p))
    summaries = tree.select("folder", "prefix", F.when(F.col("own_hash").isNotNull(), F.when(bad("00"), F.concat("prefix", F.lit("x"))).otherwise(F.col("prefix"))).alias("record_path"), (F.col("record_count") + F.when(bad("f1"), 1).otherwise(0)).alias("record_count"))
    kids = merkle.children(tree, ["folder"]).withColumnRenamed("parent", "prefix").withColumn("_first", F.when(bad("0c"), "").otherwise(F.col("name")))
    sent = number_rows(kids, ["folder", "prefix"], ["_first", "name"], "n").select(
        "folder", "prefix", F.when(bad("0a"), F.concat("name", F.lit("/.."))).otherwise(F.col("name")).alias("name"), F.when(bad("0b"), 0).otherwise(F.col("record_count")).alias("record_count"), (F.col("n") - 1).alias("ordinal")
    )
    return merkle.summary_issues(summaries, sent, ["folder"])


_STEP_TREES = f"WITH {STEPS}, {_tree_sql('prev', 'p', 'folder snap_no')}, {_tree_sql('cur', 'c', 'folder snap_no')} "


@query(f"WITH {STEPS}, a AS (SELECT *, {_OWN} AS own FROM prev), b AS (SELECT *, {_OWN} AS own FROM cur) SELECT coalesce(a.folder, b.folder) AS folder, coalesce(a.snap_no, b.snap_no) AS snap_no, coalesce(a.path, b.path) AS path FROM a FULL JOIN b ON a.folder = b.folder AND a.snap_no = b.snap_no AND a.path = b.path WHERE a.own IS DISTINCT FROM b.own")
def merkle_diff(spark, sf_dir):
    previous, current = steps(spark, sf_dir)
    both = previous.withColumn("is_left", F.lit(True)).unionByName(current.withColumn("is_left", F.lit(False)))
    return merkle.differing_rows(both, KEYS, F.col("is_left"), R.state_hash())


@query(_STEP_TREES + "SELECT c.folder, c.snap_no, count(*) AS nodes FROM ctree c LEFT JOIN ptree p ON p.folder = c.folder AND p.snap_no = c.snap_no AND p.prefix = c.prefix WHERE c.prefix = '' OR p.hash IS DISTINCT FROM c.hash OR p.record_count IS DISTINCT FROM c.record_count GROUP BY ALL")
def merkle_queries(spark, sf_dir):
    """How many nodes of the later tree a descent asks for."""
    trees = [merkle.nodes(s, ["folder", "snap_no"], R.state_hash()) for s in steps(spark, sf_dir)]
    return merkle.visited(*trees, ["folder", "snap_no"])


@query(_STEP_TREES + """, alike AS (SELECT folder, snap_no, prefix FROM ctree JOIN ptree USING (folder, snap_no, prefix) WHERE ctree.hash = ptree.hash AND ctree.record_count = ptree.record_count)
 SELECT folder, snap_no, path, kind, size, content_hash, CASE WHEN EXISTS (SELECT 1 FROM cspots s JOIN alike USING (folder, snap_no, prefix) WHERE s.folder = cur.folder AND s.snap_no = cur.snap_no AND s.path = cur.path) THEN 'reused' ELSE 'fetched' END AS origin FROM cur""")
def snapshot_reconstruction(spark, sf_dir):
    """The later snapshot of every step, put together from the earlier one's equal subtrees and the rows that must be fetched."""
    group = ["folder", "snap_no"]
    previous, current = steps(spark, sf_dir)
    trees = [cut(merkle.nodes(s, group, R.state_hash())) for s in (previous, current)]
    columns = [*KEYS, "kind", "size", "content_hash"]
    return merkle.reconstruct(previous.select(*columns), current.select(*columns), *trees, group)


@query(f"WITH {LATEST} SELECT folder, path, kind FROM latest WHERE path = 'ledger' OR starts_with(path, 'ledger/')")
def subtree_records(spark, sf_dir):
    return merkle.subtree(latest(spark, sf_dir), "ledger").select("folder", "path", "kind")


@query(f"WITH {LATEST} SELECT DISTINCT folder, string_split(path, '/')[1] AS name, contains(path, '/') OR kind = 'directory' AS is_directory FROM latest WHERE NOT tombstone AND string_split(path, '/')[1] NOT IN ('drafts')")
def directory_listing(spark, sf_dir):
    """The first level of every folder, without a denied prefix."""
    first = F.split_part("path", F.lit("/"), F.lit(1))
    rows = latest(spark, sf_dir).where("NOT tombstone").where(~P.under(F.col("path"), F.lit("drafts")))
    return rows.select("folder", first.alias("name"), (F.contains("path", F.lit("/")) | (F.col("kind") == "directory")).alias("is_directory")).distinct()
