"""Pushes, pulls and whole passes: over the manifests of extents and both sides of every pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.pyfuncs import collision_key
from ..operators import delta, exchange, swarm, syncpass
from ..operators import merge as M
from ..operators.ranking import number_rows
from ..runtime import cut
from .delta_queries import HIGH, _avail, _miss, _peers
from .merge_queries import _CON, _RECORDS
from .registry import Registry
from .relations import EXTENTS, MANIFESTS, SNAP, STORED, extents, pairs, remote, stored

query = Registry()
KEY = ["path"]
PASS = ["pass_id", "path"]

# Records to push, one for each manifest: by the first digit of its hash some are wrong in one way each, by the second some meet another row that is there.
_FILES = f"""{EXTENTS}, {STORED}, {MANIFESTS}, spots AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM ext),
 faulty AS (SELECT path FROM spots GROUP BY path HAVING bool_or(chunk_offset <> expected) OR bool_or(length <= 0) OR bool_or(length > {HIGH}) OR max(idx) + 1 <> count(*) UNION SELECT path FROM ext GROUP BY path, hash HAVING min(length) <> max(length)),
 m AS (SELECT mani.*, substring(manifest_hash, 1, 1) AS c1, substring(manifest_hash, 2, 1) AS c2, faulty.path IS NOT NULL AS bad FROM mani LEFT JOIN faulty USING (path)),
 rec AS (SELECT path, CASE WHEN c1 = '2' THEN 'directory' ELSE 'file' END AS kind, CASE WHEN c1 = '2' THEN 0 WHEN c1 = '0' THEN size + 1 ELSE size END AS size,
   CASE WHEN c1 IN ('2', '4') THEN NULL WHEN c1 = '3' THEN sha256(manifest_hash) ELSE manifest_hash END AS content_hash, false AS readonly, c1 = '1' AS tombstone, 'a=2' AS vtext, c1, c2, size AS msize, manifest_hash, chunks, bad FROM m),
 rh AS (SELECT *, sha256('record|' || path || '|' || kind || '|' || size || '|' || coalesce(content_hash, '-') || '|0|' || CASE WHEN tombstone THEN '1' ELSE '0' END || '|' || vtext) AS record_hash,
   CASE WHEN NOT tombstone AND kind = 'file' AND content_hash IS NULL THEN 'invalid_record' END AS invalid, CASE c2 WHEN 'c' THEN 'stale' WHEN 'd' THEN 'concurrent' WHEN 'e' THEN 'divergent' WHEN 'f' THEN 'divergent' END AS causal FROM rec),
 u AS (SELECT path, hash, max(length) AS length, count(*) AS n FROM ext GROUP BY ALL),
 nd AS (SELECT path, CAST(count(*) FILTER (s.hash IS NULL) AS BIGINT) AS missing, CAST(coalesce(sum(u.length) FILTER (s.hash IS NULL), 0) AS BIGINT) AS missing_bytes, CAST(coalesce(sum(n) FILTER (s.hash IS NOT NULL), 0) AS BIGINT) AS reused_extents FROM u LEFT JOIN stored s ON u.hash = s.hash GROUP BY ALL),
 push AS (SELECT rh.*, coalesce(invalid, CASE WHEN bad THEN 'invalid_manifest' WHEN tombstone OR kind <> 'file' THEN 'not_live_file' WHEN c1 IN ('0', '3') THEN 'manifest_differs' END, causal, 'accept') AS verdict, nd.missing_bytes, nd.reused_extents FROM rh LEFT JOIN nd USING (path))"""


def _manifests(spark, sf_dir):
    ext = extents(spark, sf_dir)
    issues = delta.manifest_issues(ext, HIGH).groupBy("path").agg(F.min("issue").alias("issue"))
    made = delta.manifest_hash(ext).join(issues, "path", "left")
    return made.select("path", "size", "chunks", "manifest_hash", F.col("manifest_hash").alias("file_hash"), "issue")


def _digits(h="manifest_hash"):
    return F.substring(h, 1, 1), F.substring(h, 2, 1)


def _records(manifests):
    c1, _ = _digits()
    rows = manifests.select(
        "path", F.when(c1 == "2", "directory").otherwise("file").alias("kind"), F.when(c1 == "2", 0).when(c1 == "0", F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(c1.isin("2", "4"), None).when(c1 == "3", F.sha2("manifest_hash", 256)).otherwise(F.col("manifest_hash")).alias("content_hash"), F.lit(False).alias("readonly"), (c1 == "1").alias("tombstone"), F.lit("a=2").alias("vtext"), "manifest_hash",
    )
    return rows.withColumn("vv", R.vector_of(F.col("vtext")))


def _current(records):
    _, c2 = _digits()
    text = F.when(c2.isin("4", "5", "6", "7"), "a=1").when(c2 == "c", "a=3").when(c2 == "d", "b=1").otherwise("a=2")
    there = records.where(~c2.isin("0", "1", "2", "3"))
    return there.withColumn("vtext", text).withColumn("vv", R.vector_of(F.col("vtext"))).withColumn("readonly", c2.isin("e", "f")).drop("manifest_hash")


def _pushed(spark, sf_dir):
    manifests = cut(_manifests(spark, sf_dir))
    records = _records(manifests)
    needs = exchange.need(extents(spark, sf_dir), stored(spark, sf_dir), KEY)
    return manifests, records, exchange.record_push(records.drop("manifest_hash"), manifests, needs, _current(records), KEY)


@query(f"WITH {_FILES} SELECT path, verdict, CASE WHEN verdict = 'accept' THEN record_hash END AS record_hash, CASE WHEN verdict = 'accept' THEN missing_bytes END AS transferred_bytes, CASE WHEN verdict = 'accept' THEN reused_extents END AS reused_extents FROM push")
def push_records(spark, sf_dir):
    return _pushed(spark, sf_dir)[2]


@query(f"WITH {_FILES} SELECT path, coalesce(invalid, CASE WHEN NOT tombstone AND kind <> 'directory' THEN 'unsupported' END, causal, 'accept') AS verdict, CASE WHEN coalesce(invalid, CASE WHEN NOT tombstone AND kind <> 'directory' THEN 'unsupported' END, causal) IS NULL THEN record_hash END AS record_hash FROM rh")
def push_metadata(spark, sf_dir):
    records = _records(_manifests(spark, sf_dir))
    return exchange.metadata_push(records.drop("manifest_hash"), _current(records), KEY)


@query(f"WITH {_FILES} SELECT path, CASE WHEN invalid IS NOT NULL THEN invalid WHEN tombstone OR kind <> 'file' THEN 'not_live_file' WHEN c2 IN ('0', '1', '2', '3') THEN 'absent' WHEN c2 NOT IN ('8', '9', 'a', 'b') THEN 'changed' WHEN c1 IN ('0', '3') THEN 'content_changed' ELSE 'accept' END AS verdict FROM rh")
def pull_records(spark, sf_dir):
    manifests = cut(_manifests(spark, sf_dir))
    records = _records(manifests)
    return exchange.record_pull(records.drop("manifest_hash"), _current(records), manifests, KEY)


@query(f"WITH {_FILES} SELECT path, CASE c1 WHEN '5' THEN 'transferred_bytes' WHEN '6' THEN 'receipt' ELSE 'reused_extents' END AS field FROM push WHERE verdict = 'accept' AND c1 IN ('5', '6', '7')")
def push_receipts(spark, sf_dir):
    """Receipts of which some are lost and some count wrong, against the sender's own figures."""
    manifests, _, answers = _pushed(spark, sf_dir)
    own = cut(answers.where("verdict = 'accept'"))
    c1, _ = _digits()
    told = own.join(manifests.select("path", "manifest_hash"), "path").where(c1 != "6")
    told = told.withColumn("transferred_bytes", F.col("transferred_bytes") + F.when(c1 == "5", 1).otherwise(0)).withColumn("reused_extents", F.col("reused_extents") + F.when(c1 == "7", 1).otherwise(0))
    return exchange.receipt_issues(told, own, KEY, ("record_hash", "transferred_bytes", "reused_extents"))


_REQUESTS = """req AS (SELECT path, hash, row_number() OVER (PARTITION BY path ORDER BY min(idx)) - 1 AS pos FROM ext GROUP BY path, hash),
 asked AS (SELECT path, pos, hash FROM req UNION ALL SELECT path, pos + 1000000, hash FROM req WHERE starts_with(hash, '0') UNION ALL SELECT path, 2000000, sha256(path) FROM (SELECT DISTINCT path FROM ext)), len AS (SELECT path, hash, max(length) AS length FROM ext GROUP BY ALL)"""


def _requests(ext):
    first = number_rows(delta.first_uses(ext), ["path"], ["first_idx"], "n").select("path", (F.col("n") - 1).alias("pos"), "hash")
    return cut(first)


def _asked(ext, requests):
    twice = requests.where(F.startswith("hash", F.lit("0"))).withColumn("pos", F.col("pos") + 1_000_000)
    odd = ext.select("path").distinct().select("path", F.lit(2_000_000).cast("bigint").alias("pos"), F.sha2("path", 256).alias("hash"))
    return requests.unionByName(twice).unionByName(odd)


@query(f"WITH {EXTENTS}, {_REQUESTS}, r AS (SELECT a.*, len.length, CASE WHEN a.pos > min(a.pos) OVER (PARTITION BY a.path, a.hash) THEN 'duplicate' WHEN len.length IS NULL THEN 'unknown' END AS issue FROM asked a LEFT JOIN len ON len.path = a.path AND len.hash = a.hash) SELECT path, pos, hash, length, CAST(coalesce(sum(CASE WHEN issue IS NULL THEN length ELSE 0 END) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before, issue FROM r")
def sent_chunks(spark, sf_dir):
    """The frames of every request, in order; chunks asked for twice and chunks no manifest has are told apart."""
    ext = extents(spark, sf_dir)
    return exchange.requested_frames(_asked(ext, _requests(ext)), ext, KEY)


@query(f"WITH {EXTENTS}, {_REQUESTS} SELECT path, pos, CASE substring(hash, 1, 1) WHEN '1' THEN 'order' WHEN '2' THEN 'length' ELSE 'not_sent' END AS issue FROM req WHERE substring(hash, 1, 1) IN ('1', '2', '3') UNION ALL SELECT DISTINCT path, 3000000, 'surplus' FROM ext")
def received_chunks(spark, sf_dir):
    """Frames of which some are another chunk, of another length, missing or too many."""
    ext = extents(spark, sf_dir)
    requests = _requests(ext)
    first = F.substring("hash", 1, 1)
    lengths = ext.groupBy("path", "hash").agg(F.max("length").alias("length"))
    frames = requests.join(lengths, ["path", "hash"]).where(first != "3").withColumn("length", F.col("length") + F.when(first == "2", 1).otherwise(0)).withColumn("hash", F.when(first == "1", F.sha2("hash", 256)).otherwise(F.col("hash")))
    more = ext.groupBy("path").agg(F.min("hash").alias("hash")).join(lengths, ["path", "hash"]).select("path", "hash", F.lit(3_000_000).cast("bigint").alias("pos"), "length")
    return exchange.received_issues(frames.unionByName(more), requests, ext, KEY)


@query(f"WITH {_FILES} SELECT path, manifest_hash, manifest_hash AS file_hash, msize AS size, missing_bytes AS transferred_bytes, reused_extents, CASE c1 WHEN '8' THEN 'incomplete' WHEN '9' THEN 'size_differs' END AS issue FROM rh LEFT JOIN nd USING (path)")
def file_receipts(spark, sf_dir):
    manifests = cut(_manifests(spark, sf_dir))
    c1, _ = _digits()
    built = manifests.where(c1 != "8").select("path", (F.col("size") + F.when(c1 == "9", 1).otherwise(0)).alias("size"))
    needs = exchange.need(extents(spark, sf_dir), stored(spark, sf_dir), KEY)
    return exchange.file_receipts(manifests, needs, built, KEY)


@query(f"WITH {EXTENTS}, {STORED} SELECT DISTINCT path, hash FROM ext WHERE hash NOT IN (SELECT hash FROM stored)")
def unresolved_chunks(spark, sf_dir):
    return exchange.unresolved(extents(spark, sf_dir), stored(spark, sf_dir), KEY)


@query(f"WITH {_FILES}, part AS (SELECT path, 'p' || substring(hash, 2, 1) AS peer, length FROM ext WHERE substring(hash, 1, 1) IN ('0', '1', '2', '3')) SELECT nd.path, CAST(missing_bytes + coalesce((SELECT sum(length) FROM part WHERE part.path = nd.path), 0) AS BIGINT) AS transferred_bytes, coalesce((SELECT count(DISTINCT peer) FROM part WHERE part.path = nd.path), 0) AS sources FROM nd")
def fallback_pulls(spark, sf_dir):
    """Full pulls after fills from several sources that broke off."""
    ext = extents(spark, sf_dir)
    partial = ext.where(F.substring("hash", 1, 1).isin("0", "1", "2", "3")).select("path", F.concat(F.lit("p"), F.substring("hash", 2, 1)).alias("peer"), F.col("length").alias("bytes"))
    full = exchange.need(ext, stored(spark, sf_dir), KEY).select("path", F.col("missing_bytes").alias("transferred_bytes"))
    return exchange.fallback_totals(partial, full, KEY)


@query(None)
def swarm_fill(spark, sf_dir):
    """Chunks of ten jobs fetched from the peers that have them, some of which fail once or always, or lack what they offer."""
    needed = _miss(spark, sf_dir).select((F.col("hash") % 10).alias("job"), "hash", (F.col("hash") % 1000 + 1).alias("length"))
    cost = swarm.source_cost_ms(F.col("rtt_ms"), F.col("queued_bytes"), F.col("goodput_bps"), F.col("failure_penalty"))
    offers = _avail(spark, sf_dir).distinct().join(_peers(spark, sf_dir).select("peer", cost.alias("cost")), "peer")
    luck = F.pmod(F.col("hash") * 7 + F.col("peer") * 3, F.lit(101))
    outcome = F.when(luck == 0, "failed").when((luck < 5) & (F.col("attempt") == 1), "failed").when(luck < 9, "missing").otherwise("ok")
    done, left = exchange.fill(needed, offers.select((F.col("hash") % 10).alias("job"), "hash", "peer", "cost"), outcome, ["job"])
    return done.select("job", "hash", "peer", F.lit("delivered").alias("state")).unionByName(left.select("job", "hash", F.lit(None).cast("long").alias("peer"), F.lit("open").alias("state")))


def _root_sql(name, source):
    words = ", ".join(f"('0x' || substring(d, {8 * i + 1}, 8))::BIGINT AS w{i}" for i in range(8))
    text = " || ".join(f"lpad(to_hex(CAST(sum(w{i}) % 4294967296 AS BIGINT)), 8, '0')" for i in range(8))
    hashed = "sha256('record|' || path || '|' || coalesce(kind, '-') || '|' || coalesce(size::VARCHAR, '-') || '|' || coalesce(content_hash, '-') || '|' || CASE WHEN readonly THEN '1' ELSE '0' END || '|' || CASE WHEN tombstone THEN '1' ELSE '0' END || '|' || vtext)"
    return f"{name} AS (SELECT pass_id, lower({text}) AS root FROM (SELECT pass_id, {words} FROM (SELECT pass_id, sha256('node|' || path || '|' || {hashed}) AS d FROM {source})) GROUP BY pass_id)"


_DIFFERS = "s.path IS NULL OR s.kind IS DISTINCT FROM d.kind OR s.size IS DISTINCT FROM d.size OR s.content_hash IS DISTINCT FROM d.content_hash OR s.readonly IS DISTINCT FROM d.readonly OR s.tombstone IS DISTINCT FROM d.tombstone OR s.vtext <> d.vtext"
_PASS_SQL = f"""{_CON}, des AS ({_RECORDS}), la AS (SELECT d.* FROM des d LEFT JOIN l s ON s.pass_id = d.pass_id AND s.path = d.path WHERE {_DIFFERS}), ra AS (SELECT d.* FROM des d LEFT JOIN r s ON s.pass_id = d.pass_id AND s.path = d.path WHERE {_DIFFERS}),
 need AS (SELECT DISTINCT pass_id, content_hash FROM (SELECT * FROM la UNION ALL SELECT * FROM ra) WHERE NOT tombstone AND kind = 'file' AND content_hash IS NOT NULL),
 src AS (SELECT n.*, EXISTS (SELECT 1 FROM l s WHERE s.pass_id = n.pass_id AND s.content_hash = n.content_hash AND s.kind = 'file' AND NOT s.tombstone) AS here, EXISTS (SELECT 1 FROM r s WHERE s.pass_id = n.pass_id AND s.content_hash = n.content_hash AND s.kind = 'file' AND NOT s.tombstone) AS there FROM need n),
 {_root_sql('lr', 'l')}, {_root_sql('rr', 'r')}, {_root_sql('dr', 'des')}, ps AS (SELECT DISTINCT pass_id FROM oc)"""


@query(f"""{_PASS_SQL} SELECT ps.pass_id, lr.root AS local_before_root, rr.root AS remote_before_root, dr.root AS desired_root, dr.root AS verified_local_root, dr.root AS verified_remote_root,
 (SELECT count(*) FROM la WHERE la.pass_id = ps.pass_id) AS local_actions, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM la WHERE la.pass_id = ps.pass_id AND NOT tombstone AND kind = 'file') AS pending_local_bytes, (SELECT count(*) FROM ra WHERE ra.pass_id = ps.pass_id) AS remote_actions,
 (SELECT count(*) FROM src WHERE src.pass_id = ps.pass_id AND here) AS staged_local_files, (SELECT count(*) FROM src WHERE src.pass_id = ps.pass_id AND there AND NOT here) AS pulled_remote_files, (SELECT count(*) FROM e WHERE e.pass_id = ps.pass_id) AS conflicts
 FROM ps LEFT JOIN lr ON lr.pass_id = ps.pass_id LEFT JOIN rr ON rr.pass_id = ps.pass_id LEFT JOIN dr ON dr.pass_id = ps.pass_id""")
def sync_pass(spark, sf_dir):
    """Every pass run as a whole; the verified roots are those of both sides after their actions."""
    return _pass(spark, sf_dir).report.drop("status")


def _pass(spark, sf_dir):
    # no replica of these tables is this one, so no counter was given out by it
    return syncpass.sync_pass(pairs(spark, sf_dir), PASS, F.lit("self"), F.lit(0), collision_key("path"))


@query(None)
def sync_status(spark, sf_dir):
    """Which gate stops each pass; without SQL for its folded names."""
    return _pass(spark, sf_dir).report.select("pass_id", "status")


@query(f"{_PASS_SQL} SELECT pass_id, content_hash, CASE WHEN here THEN 'local' WHEN there THEN 'remote' ELSE 'missing' END AS source FROM src")
def staged_contents(spark, sf_dir):
    """What both sides' actions need, and where it is."""
    return _pass(spark, sf_dir).contents.select("pass_id", "content_hash", "source")


@query(f"{_PASS_SQL} SELECT 'local' AS side, (SELECT count(*) FROM la) AS actions, CAST(0 AS BIGINT) AS left_over UNION ALL SELECT 'remote', (SELECT count(*) FROM ra), CAST(0 AS BIGINT)")
def replay_is_empty(spark, sf_dir):
    """The actions of every pass are applied; planned again from what was reached there is nothing to do."""
    done = _pass(spark, sf_dir)
    want = done.desired
    out = None
    for side, actions, after in (("local", done.local_actions, done.local_after), ("remote", done.remote_actions, done.remote_after)):
        again = M.actions_to_reach(after.withColumn("vv", R.vector_of(F.col("vtext"))), want, PASS).agg(F.count("*").alias("left_over"))
        counts = actions.agg(F.count("*").alias("actions"), F.lit(0).cast("long").alias("left_over")).unionByName(again.withColumn("actions", F.lit(0).cast("long")))
        row = counts.groupBy(F.lit(side).alias("side")).agg(F.sum("actions").alias("actions"), F.sum("left_over").alias("left_over"))
        out = row if out is None else out.unionByName(row)
    return out


_LEVELS = "seg AS (SELECT pass_id, path, kind, string_split(path, '/') AS p FROM r WHERE NOT tombstone), up AS (SELECT pass_id, path, array_to_string(p[1:i], '/') AS above FROM (SELECT *, unnest(range(1, len(p))) AS i FROM seg))"


@query(f"WITH {SNAP}, {_LEVELS} SELECT pass_id, path, 'kind' AS issue FROM seg WHERE kind NOT IN ('file', 'directory') UNION ALL SELECT DISTINCT up.pass_id, up.path, 'ancestor' FROM up JOIN r a ON a.pass_id = up.pass_id AND a.path = up.above WHERE a.tombstone OR a.kind <> 'directory'")
def namespace_blocked(spark, sf_dir):
    """The issues of a namespace but for folded names, which SQL has no form for."""
    return M.namespace_issues(remote(spark, sf_dir), PASS, collision_key("path")).where("issue <> 'collision'")


@query(f"WITH {SNAP}, changes AS (SELECT coalesce(l.pass_id, r.pass_id) AS pass_id, coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'remove' ELSE 'install' END AS action, coalesce(r.kind, l.kind) AS kind FROM (SELECT * FROM l WHERE NOT tombstone) l FULL JOIN (SELECT * FROM r WHERE NOT tombstone) r ON l.pass_id = r.pass_id AND l.path = r.path WHERE l.path IS NULL OR r.path IS NULL OR NOT ((l.kind = 'directory' AND r.kind = 'directory') OR (l.kind IS NOT DISTINCT FROM r.kind AND l.size IS NOT DISTINCT FROM r.size AND l.content_hash IS NOT DISTINCT FROM r.content_hash AND l.readonly IS NOT DISTINCT FROM r.readonly))), top AS (SELECT * FROM changes c WHERE NOT EXISTS (SELECT 1 FROM changes b WHERE b.pass_id = c.pass_id AND (b.action = 'remove' OR b.kind <> 'directory') AND starts_with(c.path, b.path || '/'))) SELECT pass_id, path, action, row_number() OVER (PARTITION BY pass_id ORDER BY len(string_split(path, '/')), path) AS position FROM top")
def read_only_order(spark, sf_dir):
    """An authoritative remote's changes in the order they are made."""
    plan = syncpass.read_only_plan(pairs(spark, sf_dir), PASS)
    return number_rows(plan, ["pass_id"], ["depth", "path"], "position").select("pass_id", "path", "action", "position")
