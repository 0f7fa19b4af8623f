"""Journals, watchers, workers, settings and admission: over orders, events, customers, suppliers and folders' directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import records as R
from ..operators import access, dashboard, merkle
from ..runtime import table
from ..streaming import debounce, journal, watch
from .registry import Registry
from .relations import LATEST, SNAP, STEPS, latest, sides, steps
from .scan_queries import KEYS

query = Registry()

# A change for every order: its state, what it brings and was made over, and an index row for two of three customers.
_JOURNAL = """log AS (SELECT o_orderkey AS id, 'docs/' || o_custkey AS path, ['prepared', 'preserved', 'materialized', 'indexed', 'committed', 'aborted', 'rolling_back', 'rolled_back'][o_orderkey % 8 + 1] AS state, 'h' || o_orderkey % 5 AS record_hash,
  CASE WHEN o_orderkey % 3 > 0 THEN 'h' || o_orderkey % 4 END AS precondition FROM orders), idx AS (SELECT 'docs/' || c_custkey AS path, 'h' || c_custkey % 5 AS record_hash FROM customer WHERE c_custkey % 3 > 0)"""
_STATES = ("prepared", "preserved", "materialized", "indexed", "committed", "aborted", "rolling_back", "rolled_back")


def _pick(values, by):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (by + 1).cast("int"))


def _h(c):
    return F.concat(F.lit("h"), c.cast("string"))


def _journal(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("docs/"), F.col("o_custkey").cast("string")).alias("path"), _pick(_STATES, k % 8).alias("state"), _h(k % 5).alias("record_hash"), F.when(k % 3 > 0, _h(k % 4)).alias("precondition"))


def _index(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 3 > 0).select(F.concat(F.lit("docs/"), k.cast("string")).alias("path"), _h(k % 5).alias("record_hash"))


@query(f"WITH {_JOURNAL} SELECT id, log.path, CASE WHEN state IN ('committed', 'aborted', 'rolled_back') THEN 'nothing' WHEN idx.record_hash = log.record_hash THEN 'mark_indexed' WHEN idx.record_hash IS DISTINCT FROM precondition THEN 'unavailable' WHEN state = 'rolling_back' THEN 'roll_back' ELSE 'resume' END AS decision FROM log LEFT JOIN idx ON idx.path = log.path")
def recovery_decisions(spark, sf_dir):
    """Every change joined with the row its path has in the index now."""
    return journal.recover(_journal(spark, sf_dir), _index(spark, sf_dir))


@query(f"WITH {_JOURNAL} SELECT id, log.path, CASE WHEN state = 'materialized' AND idx.record_hash = log.record_hash THEN 'indexed' ELSE state END AS state FROM log LEFT JOIN idx ON idx.path = log.path")
def indexed_changes(spark, sf_dir):
    return journal.mark_indexed(_journal(spark, sf_dir), _index(spark, sf_dir)).select("id", "path", "state")


_STEPS_OF = "(SELECT id, state, id % 5 = 0 AS captured, id % 7 > 2 AS staged, ['file', 'directory', 'absent'][id % 3 + 1] AS target, id % 4 = 0 AS here FROM log)"


@query(f"WITH {_JOURNAL} SELECT id, CASE WHEN state = 'prepared' AND NOT captured AND target = 'file' AND NOT staged THEN 'aborted' WHEN state IN ('prepared', 'preserved') THEN 'materialized' ELSE state END AS resumed, CASE WHEN state IN ('prepared', 'preserved') THEN 'aborted' ELSE state END AS aborted, CASE WHEN state IN ('preserved', 'materialized', 'rolling_back') AND NOT here THEN 'rolled_back' ELSE state END AS rolled_back FROM {_STEPS_OF}")
def journal_steps(spark, sf_dir):
    """Where each change ends if it is resumed, aborted or rolled back."""
    i, state = F.col("id"), F.col("state")
    return _journal(spark, sf_dir).select(
        "id", journal.resumed(state, i % 5 == 0, i % 7 > 2, _pick(("file", "directory", "absent"), i % 3)).alias("resumed"), journal.aborted(state).alias("aborted"), journal.rolled_back(state, i % 4 == 0).alias("rolled_back")
    )


@query(f"""WITH {_JOURNAL} SELECT id, issue FROM (SELECT id, CASE WHEN id % 31 = 0 THEN 'version' WHEN id % 37 = 0 THEN 'path' WHEN id % 41 = 0 THEN 'state' WHEN id % 2 = 0 AND id % 9 > 0 AND state IN ('preserved', 'materialized', 'indexed', 'committed') AND (id % 10 = 0 OR id % 6 = 0) THEN 'artifact' END AS issue FROM log) WHERE issue IS NOT NULL""")
def journal_issues(spark, sf_dir):
    """Entries of wrong versions, paths and states, and preserved ones whose object is gone or another."""
    i = F.col("id")
    log = _journal(spark, sf_dir).select(
        "id", F.when(i % 31 == 0, 2).otherwise(1).alias("version"), F.when(i % 37 == 0, "/x").otherwise(F.col("path")).alias("path"), F.when(i % 41 == 0, "lost").otherwise(F.col("state")).alias("state"), F.when(i % 2 == 0, i).alias("expected"), (i % 9 == 0).alias("metadata_only")
    )
    kept = _journal(spark, sf_dir).where(i % 10 > 0).select("id", F.when(i % 6 == 0, i + 1).otherwise(i).alias("identity"))
    return journal.entry_issues(log, kept)


@query("WITH there AS (SELECT o_orderkey || '/artifact' AS location FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT o_orderkey || '/rollback' FROM orders WHERE o_totalprice > 100000) SELECT id, kind, id || '/' || kind AS location FROM (SELECT o_orderkey AS id, unnest(['artifact', 'rollback']) AS kind FROM orders) WHERE id || '/' || kind IN (SELECT location FROM there)")
def preserved_artifacts(spark, sf_dir):
    """The objects of all changes that are still there."""
    orders = table(spark, sf_dir, "orders")
    at = lambda kind: F.concat(F.col("o_orderkey").cast("string"), F.lit(f"/{kind}")).alias("location")
    there = orders.where(F.col("o_orderkey") % 3 == 0).select(at("artifact")).unionByName(orders.where("o_totalprice > 100000").select(at("rollback")))
    return journal.preserved_objects(_journal(spark, sf_dir), there)


@query("SELECT o_orderkey, CASE WHEN stage IS NULL THEN 'prepared' WHEN stage = 'prepared' AND (p > 0 OR n = 0) THEN 'preserved' WHEN stage = 'preserved' AND m >= n THEN 'materialized' WHEN stage = 'materialized' AND o_orderkey % 2 = 0 THEN 'adopted' WHEN stage = 'adopted' THEN 'done' ELSE stage END AS next FROM (SELECT o_orderkey, [NULL, 'prepared', 'preserved', 'materialized', 'adopted'][o_orderkey % 5 + 1] AS stage, o_orderkey % 4 AS n, o_orderkey % 3 AS p, o_orderkey % 6 AS m FROM orders)")
def read_only_stages(spark, sf_dir):
    """Where interrupted read-only passes go on."""
    from ..operators.syncpass import next_stage

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", next_stage(_pick((None, "prepared", "preserved", "materialized", "adopted"), k % 5), k % 4, k % 3, k % 6, k % 2 == 0).alias("next"))


_QUIET, _LONGEST = 3_600_000, 7_200_000


def _bursts_sql(rows):
    """Bursts event by event: each key's events in order, one step of the recursion each."""
    return f"""WITH RECURSIVE src AS ({rows}), e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY moment, lost) AS rn FROM src),
  f AS (SELECT key, rn, moment AS first, moment AS last, lost, 1 AS b FROM e WHERE rn = 1 UNION ALL
   SELECT e.key, e.rn, CASE WHEN f.lost OR e.moment >= f.last + {_QUIET} OR e.moment >= f.first + {_LONGEST} THEN e.moment ELSE f.first END, e.moment, e.lost, f.b + CASE WHEN f.lost OR e.moment >= f.last + {_QUIET} OR e.moment >= f.first + {_LONGEST} THEN 1 ELSE 0 END
   FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1)"""


@query(_bursts_sql("SELECT user_id AS key, epoch_us(ts) // 1000 AS moment, event_type = 'error' AS lost FROM events") + " SELECT key, min(last) AS started_ms, max(last) AS ended_ms, count(*) AS events, bool_or(lost) AS lost FROM f GROUP BY key, b")
def debounce_max_delay(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") == "error").alias("lost"))
    return debounce.debounced(ev, "key", "at", "lost", _QUIET, _LONGEST)


@query(_bursts_sql("SELECT user_id AS key, epoch_us(ts) // 1000 AS moment, event_type = 'error' AS lost, 'dir' || event_id % 7 || '/f' || event_id % 3 AS path FROM events WHERE event_type <> 'view' AND event_id % 7 <> 3") + " SELECT f.key, min(last) AS started_ms, max(last) AS ended_ms, count(*) AS events, bool_or(f.lost) AS lost, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM f JOIN e ON e.key = f.key AND e.rn = f.rn GROUP BY f.key, b")
def watch_triggers(spark, sf_dir):
    """Native events without reads and without those below an ignored folder, debounced, with the paths they name."""
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "access").when(F.col("event_type") == "error", "error").otherwise("modify")
    path = F.concat(F.lit("dir"), (k % 7).cast("string"), F.lit("/f"), (k % 3).cast("string"))
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind"), path.alias("path"))
    return watch.triggers(ev, ["dir3"], _QUIET, _LONGEST).withColumn("paths", F.array_join("paths", ","))


@query("""WITH RECURSIVE t AS (SELECT user_id AS key, moment, max(n) AS events, bool_or(lost) AS lost, user_id % 2 = 0 AS watched FROM (SELECT user_id, epoch_us(ts) // 1000 AS moment, CASE event_type WHEN 'view' THEN 0 ELSE event_id % 5 END AS n, event_type = 'error' AS lost FROM events) GROUP BY ALL),
 e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY moment) AS rn FROM t),
 f AS (SELECT key, rn, moment, events, lost, moment + 36000000 AS np, moment + 7200000 AS nf, NOT watched OR (events > 0 AND lost) AS bad, false AS p, false AS b FROM e WHERE rn = 1 UNION ALL
  SELECT e.key, e.rn, e.moment, e.events, e.lost, CASE WHEN e.moment >= f.np THEN e.moment + 36000000 ELSE f.np END, CASE WHEN (f.bad OR (e.events > 0 AND e.lost)) AND e.moment >= f.nf THEN e.moment + 7200000 ELSE f.nf END, f.bad OR (e.events > 0 AND e.lost),
   e.moment >= f.np, (f.bad OR (e.events > 0 AND e.lost)) AND e.moment >= f.nf FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1)
SELECT key, moment AS at, CASE WHEN p THEN 'periodic_scan' WHEN b THEN 'fallback_scan' ELSE 'watch_scan' END AS event, events AS native_events, p OR b OR lost AS whole, bad AS degraded FROM f WHERE events > 0 OR p OR b""")
def watch_scans(spark, sf_dir):
    """Which scans a watch loop runs at each look at its watcher."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type") == "view", 0).otherwise(F.col("event_id") % 5).alias("n"), (F.col("event_type") == "error").alias("lost"))
    ticks = ev.groupBy("key", "at").agg(F.max("n").cast("bigint").alias("events"), F.max("lost").alias("lost")).withColumn("watched", F.col("key") % 2 == 0)
    return watch.watch_scans(ticks, 36_000_000, 7_200_000)


@query("WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events), g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e) SELECT user_id, event_id, CASE WHEN ok THEN 30 ELSE least(CAST(power(2, row_number() OVER (PARTITION BY user_id, run, ok ORDER BY event_id) - 1) AS BIGINT), 4) END AS delay_s, ok AS wakes_early FROM g")
def loop_delays(spark, sf_dir):
    """How long a continuous sync waits after each pass."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("good"))
    return watch.loop_delays(ev, "user_id", ["event_id"], F.col("good"), 30, 4).select("user_id", "event_id", "delay_s", "wakes_early")


_WORK = """cmd AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS moment, event_id AS seq, CASE event_type WHEN 'view' THEN 'tick' WHEN 'click' THEN 'changed' WHEN 'purchase' THEN 'sync' WHEN 'signup' THEN 'resume' ELSE CASE WHEN event_id % 3 = 0 THEN 'pause' ELSE 'sync' END END AS command, event_id % 4 > 0 AS ok FROM events),
 e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY moment, seq) AS rn FROM cmd)"""


@query(f"""WITH RECURSIVE {_WORK}, f AS (SELECT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS moment, CAST(NULL AS VARCHAR) AS command, false AS paused, CAST(0 AS BIGINT) AS failures, min(moment) + 3600000 AS nx, false AS ran, false AS bad, false AS said FROM e GROUP BY key UNION ALL
  SELECT key, rn, moment, command, np, CASE WHEN NOT acts THEN failures WHEN bad THEN failures + 1 ELSE 0 END, CASE WHEN NOT acts THEN nx WHEN bad THEN moment + 1000 * CAST(power(2, least(failures + 1, 6)) AS BIGINT) WHEN command = 'resume' THEN moment ELSE moment + 3600000 END, ran, bad, acts
  FROM (SELECT *, acts AND ((command = 'sync' AND paused) OR (ran AND NOT ok)) AS bad FROM (SELECT *, command IN ('pause', 'resume', 'sync') OR ran AS acts FROM (SELECT f.key, e.rn, e.moment, e.command, e.ok, f.paused, f.failures, f.nx, CASE e.command WHEN 'pause' THEN true WHEN 'resume' THEN false ELSE f.paused END AS np,
     CASE WHEN e.command = 'sync' THEN NOT f.paused WHEN e.command IN ('tick', 'changed') THEN NOT f.paused AND (e.moment >= f.nx OR (e.command = 'changed' AND f.failures = 0)) ELSE false END AS ran FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1))))
SELECT key, moment AS at, command, ran, CASE WHEN paused THEN 'paused' WHEN bad THEN 'error' WHEN ran THEN 'checked' ELSE 'idle' END AS status, failures, CASE WHEN bad AND NOT paused THEN nx END AS retry_at FROM f WHERE said""")
def worker_states(spark, sf_dir):
    """Every user's events as messages and ticks of one folder's worker."""
    t, k = F.col("event_type"), F.col("event_id")
    command = F.when(t == "view", "tick").when(t == "click", "changed").when(t == "purchase", "sync").when(t == "signup", "resume").otherwise(F.when(k % 3 == 0, "pause").otherwise("sync"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), k.alias("seq"), command.alias("command"), (k % 4 > 0).alias("ok"))
    return watch.worker_states(rows, 3_600_000)


_SEEN = "seen AS (SELECT user_id AS folder, event_id AS seq, epoch_us(ts) // 1000 AS moment, CASE event_type WHEN 'view' THEN 'peer_seen' WHEN 'click' THEN 'file_sent' WHEN 'purchase' THEN 'file_received' ELSE 'comparing' END AS event, 'f' || event_id % 9 AS path, CAST(floor(abs(value)) AS BIGINT) AS bytes FROM events)"


@query(f"WITH {_SEEN} SELECT folder, arg_max(event, seq) AS phase, arg_max(path, seq) AS path, max(moment) FILTER (event = 'peer_seen') AS peer_seen_at, CAST(coalesce(sum(bytes) FILTER (event = 'file_sent'), 0) AS BIGINT) AS sent, CAST(coalesce(sum(bytes) FILTER (event = 'file_received'), 0) AS BIGINT) AS received, count(*) FILTER (event IN ('file_sent', 'file_received')) AS activities FROM seen GROUP BY folder")
def transfer_view(spark, sf_dir):
    t = F.col("event_type")
    event = F.when(t == "view", "peer_seen").when(t == "click", "file_sent").when(t == "purchase", "file_received").otherwise("comparing")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("folder"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), event.alias("event"), F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string")).alias("path"), F.floor(F.abs("value")).cast("bigint").alias("bytes"))
    return watch.transfer_view(rows)


_TICKETS = """shares AS (SELECT n_nationkey AS share, n_nationkey * 3 AS owner FROM nation WHERE n_nationkey < 20),
 reg AS (SELECT c_nationkey AS share, c_custkey AS invitation, CASE WHEN c_custkey % 3 = 0 THEN 'read_only' ELSE 'read_write' END AS permission, c_custkey % 700 AS expires_at, CASE WHEN c_custkey % 11 = 0 THEN 5 END AS revoked_at, 'd' || c_custkey AS digest FROM customer WHERE c_custkey % 13 > 0),
 tick AS (SELECT c_custkey AS ticket, c_nationkey AS share, c_custkey AS invitation, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 17 = 0 THEN 'read_only' ELSE 'read_write' END AS permission, c_custkey % 700 AS expires_at, c_nationkey * 3 + CASE WHEN c_custkey % 19 = 0 THEN 1 ELSE 0 END AS owner, 'd' || c_custkey || CASE WHEN c_custkey % 23 = 0 THEN 'x' ELSE '' END AS digest FROM customer)"""


@query(f"WITH {_TICKETS} SELECT ticket, CASE WHEN s.share IS NULL THEN 'unknown_share' WHEN r.share IS NULL THEN 'invalid_ticket' WHEN revoked_at IS NOT NULL THEN 'invitation_revoked' WHEN r.permission <> t.permission OR r.expires_at <> t.expires_at OR r.digest <> t.digest OR s.owner <> t.owner THEN 'invalid_ticket' ELSE 'valid' END AS outcome FROM tick t LEFT JOIN shares s ON s.share = t.share LEFT JOIN reg r ON r.share = t.share AND r.invitation = t.invitation")
def ticket_issuance(spark, sf_dir):
    """Tickets held against the registry of what was issued."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    customers = table(spark, sf_dir, "customer")
    digest = F.concat(F.lit("d"), k.cast("string"))
    registry = customers.where(k % 13 > 0).select(n.alias("share"), k.alias("invitation"), F.when(k % 3 == 0, "read_only").otherwise("read_write").alias("permission"), (k % 700).alias("expires_at"), F.when(k % 11 == 0, 5).alias("revoked_at"), digest.alias("digest"))
    tickets = customers.select(k.alias("ticket"), n.alias("share"), k.alias("invitation"), F.when((k % 3 == 0) | (k % 17 == 0), "read_only").otherwise("read_write").alias("permission"), (k % 700).alias("expires_at"), (n * 3 + F.when(k % 19 == 0, 1).otherwise(0)).alias("owner"), F.concat(digest, F.when(k % 23 == 0, "x").otherwise("")).alias("digest"))
    shares = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("share"), (F.col("n_nationkey") * 3).alias("owner"))
    return access.issuance_outcomes(tickets, registry, shares)


@query("WITH log AS (SELECT o_custkey % 40 AS share, o_custkey AS invitation, CASE WHEN o_orderkey % 4 = 0 THEN 'revoke_key' ELSE 'issue' END AS event, o_orderpriority AS permission, o_orderkey % 900 AS expires_at, o_orderkey AS seq, o_orderkey * 10 AS moment FROM orders), i AS (SELECT share, invitation, min(seq) AS seq, arg_min(permission, seq) AS permission, arg_min(expires_at, seq) AS expires_at FROM log WHERE event = 'issue' GROUP BY ALL), r AS (SELECT share, invitation, min(seq) AS seq, min(moment) AS moment FROM log WHERE event = 'revoke_key' GROUP BY ALL) SELECT i.share, i.invitation, i.permission, i.expires_at, CASE WHEN r.seq > i.seq THEN r.moment END AS revoked_at FROM i LEFT JOIN r ON r.share = i.share AND r.invitation = i.invitation")
def invitation_states(spark, sf_dir):
    k = F.col("o_orderkey")
    log = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("share"), F.col("o_custkey").alias("invitation"), F.when(k % 4 == 0, "revoke_key").otherwise("issue").alias("event"), F.col("o_orderpriority").alias("permission"), (k % 900).alias("expires_at"), k.alias("seq"), (k * 10).alias("at"))
    return access.invitation_state(log)


@query("SELECT c_nationkey AS share, count(*) AS members, CASE WHEN count(*) > 60 THEN 'too_many' WHEN count(*) <> count(DISTINCT c_mktsegment || c_custkey % 97) THEN 'duplicate' END AS issue FROM customer GROUP BY ALL")
def share_guards(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("share"), F.concat("c_mktsegment", (F.col("c_custkey") % 97).cast("string")).alias("member"))
    return access.group_guards(rows, "share", "member", 1, 60)


@query("SELECT s_nationkey, count(*) AS members, CASE WHEN count(*) > 8 THEN 'too_many' WHEN count(*) <> count(DISTINCT s_suppkey % 40) THEN 'duplicate' END AS issue FROM supplier GROUP BY ALL")
def source_guards(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") % 40).alias("source"))
    return access.group_guards(rows, "s_nationkey", "source", 1, 8)


_SETTINGS = """cfg AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 29 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 31 = 0 THEN 'both' WHEN c_custkey % 2 = 0 THEN 'sync' ELSE 'receive' END AS role,
  CASE WHEN c_custkey % 37 = 0 THEN 'manage/x' WHEN c_custkey % 41 = 0 THEN 'roots/shared' ELSE 'roots/' || c_custkey END AS root, CASE WHEN c_custkey % 43 = 0 THEN 'roots/' || c_custkey || '/state' WHEN c_custkey % 47 = 0 THEN 'manage/folders/other' END AS state,
  CASE WHEN c_custkey % 4 <> 2 THEN 'ep' END AS peer, c_custkey % 5 AS addresses, CASE WHEN c_custkey % 53 = 0 THEN 0 END AS interval_s, CASE WHEN c_custkey % 59 = 0 THEN 5000 END AS connections FROM customer),
 full_ AS (SELECT *, coalesce(state, 'manage/folders/' || id || '/state') AS st, 'manage/folders/' || id || '/identity.key' AS ident FROM cfg),
 used AS (SELECT id, unnest([root, st, ident]) AS path FROM full_), ups AS (SELECT id, path, array_to_string(string_split(path, '/')[1:i], '/') AS up FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM used)),
 taken AS (SELECT a.id FROM ups a JOIN used b ON a.up = b.path AND a.id <> b.id UNION SELECT b.id FROM ups a JOIN used b ON a.up = b.path AND a.id <> b.id)"""


@query(f"""WITH {_SETTINGS} SELECT id, CASE WHEN trim(name) = '' THEN 'name' WHEN role = 'both' THEN 'role' WHEN starts_with(root, 'manage/') OR st = 'manage/folders/other' THEN 'management' WHEN starts_with(st, root || '/') THEN 'separate' WHEN id IN (SELECT id FROM taken) THEN 'taken'
  WHEN role = 'sync' AND peer IS NULL THEN 'peer' WHEN role = 'sync' AND addresses = 0 THEN 'addresses' WHEN interval_s = 0 THEN 'interval' WHEN connections = 5000 THEN 'connections' END AS issue, trim(name) AS name, st AS state, ident AS identity, coalesce(interval_s, 30) AS interval_s, coalesce(connections, 8) AS connections FROM full_""")
def folder_settings(spark, sf_dir):
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 29 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 31 == 0, "both").when(k % 2 == 0, "sync").otherwise("receive").alias("role"),
        F.when(k % 37 == 0, "manage/x").when(k % 41 == 0, "roots/shared").otherwise(F.concat(F.lit("roots/"), key)).alias("root"), F.when(k % 43 == 0, F.concat(F.lit("roots/"), key, F.lit("/state"))).when(k % 47 == 0, "manage/folders/other").alias("state"),
        F.lit(None).cast("string").alias("identity"), F.when(k % 4 != 2, "ep").alias("peer"), F.array_repeat(F.lit("1.2.3.4:5"), (k % 5).cast("int")).alias("addresses"), F.when(k % 53 == 0, 0).alias("interval_s"), F.when(k % 59 == 0, 5000).alias("connections"),
    )
    return access.folder_settings(rows, "manage")


_HELD = "held AS (SELECT DISTINCT folder AS other, path, starts_with(path, 'drafts') AS private, snap_no AS lease_until FROM index_records WHERE kind = 'directory' AND folder IS NOT NULL AND path IS NOT NULL AND NOT coalesce(tombstone, false))"


@query(f"""WITH {_HELD}, q AS (SELECT s_suppkey AS id, ['ledger', 'ledger/2011', 'drafts', 'inbox/2020/a', 'nowhere'][s_suppkey % 5 + 1] AS path FROM supplier)
 SELECT id, CASE min(CASE WHEN private THEN 0 WHEN lease_until > 3 THEN 1 ELSE 2 END) WHEN 0 THEN 'private' WHEN 1 THEN 'active' ELSE 'stale' END AS conflict FROM q JOIN held h ON q.path = h.path OR starts_with(q.path, h.path || '/') OR starts_with(h.path, q.path || '/') GROUP BY id""")
def admission_conflicts(spark, sf_dir):
    """Requested roots that overlap a held one either way, by the state of its lease."""
    k = F.col("s_suppkey")
    asked = table(spark, sf_dir, "supplier").select(k.alias("id"), _pick(("ledger", "ledger/2011", "drafts", "inbox/2020/a", "nowhere"), k % 5).alias("path"))
    rows = table(spark, sf_dir, "index_records").where("kind = 'directory' AND folder IS NOT NULL AND path IS NOT NULL AND NOT coalesce(tombstone, false)")
    held = rows.select(F.concat_ws("|", "folder", "path", F.col("snap_no").cast("string")).alias("other"), "path", F.startswith("path", F.lit("drafts")).alias("private"), F.col("snap_no").alias("lease_until")).distinct()
    return access.admission_conflicts(asked, held, F.lit(3))


@query(f"""WITH {STEPS} SELECT c.folder, c.snap_no, c.path, CASE WHEN c.tombstone THEN CASE WHEN NOT coalesce(p.tombstone, true) THEN 'still_there' ELSE 'adopt' END WHEN p.path IS NULL OR p.tombstone THEN 'absent' WHEN p.kind IS DISTINCT FROM c.kind THEN 'kind' WHEN p.readonly IS DISTINCT FROM c.readonly THEN 'readonly'
  WHEN c.kind = 'file' AND NOT (p.size IS NOT DISTINCT FROM c.size AND p.content_hash IS NOT DISTINCT FROM c.content_hash) THEN 'content' ELSE 'adopt' END AS verdict, NOT c.tombstone AND coalesce(c.kind = 'file', false) AND p.path IS NOT NULL AND NOT p.tombstone AND (p.modified_ns IS NULL OR p.id_namespace IS NULL OR p.id_object IS NULL) AS rehash FROM cur c LEFT JOIN prev p ON p.folder = c.folder AND p.snap_no = c.snap_no AND p.path = c.path""")
def verified_adoption(spark, sf_dir):
    """Taking the later snapshot's rows over, with the earlier one's as what is on disk."""
    previous, current = steps(spark, sf_dir)
    return access.adopted(current, previous.where(~F.col("tombstone")), previous, KEYS).select(*KEYS, "verdict", F.coalesce("rehash", F.lit(False)).alias("rehash"))


@query("""SELECT s_suppkey, unnest(['direct_addresses', 'identity', 'path_separation', 'peer', 'root_writable', 'state_writable']) AS check_name, unnest([s_suppkey % 3 <> 0 OR s_suppkey % 4 > 0, s_suppkey % 5 > 0, s_suppkey % 7 > 0, s_suppkey % 11 > 0, s_suppkey % 13 > 0, s_suppkey % 17 > 0]) AS passed,
 s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 AND s_suppkey % 11 > 0 AND s_suppkey % 13 > 0 AND s_suppkey % 17 > 0 AND (s_suppkey % 3 <> 0 OR s_suppkey % 4 > 0) AS healthy FROM supplier""")
def doctor_checks(spark, sf_dir):
    """Every supplier as a device with its checks."""
    k = F.col("s_suppkey")
    facts = table(spark, sf_dir, "supplier").select(
        "s_suppkey", (k % 13 > 0).alias("root_writable"), (k % 17 > 0).alias("state_writable"), F.concat(F.lit("root/"), k.cast("string")).alias("root"), F.when(k % 7 > 0, "state").otherwise(F.concat(F.lit("root/"), k.cast("string"), F.lit("/state"))).alias("state"), F.lit("key").alias("identity"),
        (k % 5 > 0).alias("identity_ok"), F.when(k % 11 == 0, False).when(k % 2 == 0, True).alias("peer_ok"), (k % 3 == 0).alias("direct_only"), (k % 4).alias("addresses"),
    )
    return dashboard.doctor(facts, ["s_suppkey"]).select("s_suppkey", "check_name", (F.col("status") == "pass").alias("passed"), "healthy")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 4 IN (1, 3) AS attention FROM events")
def report_json(spark, sf_dir):
    """Which JSON reports of scans need attention."""
    k = F.col("event_id")
    report = F.to_json(F.struct(F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues"), F.when(k % 5 == 0, F.array(F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("collisions"), (k % 2).alias("retries_queued")))
    attention = D.needs_attention(report)
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), attention.alias("attention"))


@query(f"WITH {SNAP} SELECT path, count(*) AS n, count(DISTINCT struct_pack(a := kind, b := size, c := content_hash)) > 1 AS conflicting FROM snap GROUP BY path HAVING count(*) > 1")
def union_conflicts(spark, sf_dir):
    """Paths that several sides and passes have, and whether their values differ; a union by path holds only the others."""
    return dashboard.keyed_union_conflicts(sides(spark, sf_dir).select("path", "kind", "size", "content_hash"), "path", ("kind", "size", "content_hash"))


@query(f"WITH {LATEST}, t AS (SELECT folder, string_split(path, '/')[1] AS top, path, sha256('node|' || path || '|' || sha256('state|' || coalesce(kind, '-') || '|' || coalesce(size::VARCHAR, '-') || '|' || coalesce(content_hash, '-') || '|' || CASE WHEN readonly THEN '1' ELSE '0' END || '|' || CASE WHEN tombstone THEN '1' ELSE '0' END)) AS d FROM latest) SELECT folder, top, {' || '.join(f"lower(lpad(to_hex(CAST(sum(('0x' || substring(d, {8 * i + 1}, 8))::BIGINT) % 4294967296 AS BIGINT)), 8, '0'))" for i in range(8))} AS observation, count(*) AS entries FROM t GROUP BY folder, top")
def tree_observations(spark, sf_dir):
    """One digest of all that lies below each directory of the first level."""
    rows = latest(spark, sf_dir).withColumn("top", F.split_part("path", F.lit("/"), F.lit(1)))
    return merkle.roots(rows, ["folder", "top"], R.state_hash()).select("folder", "top", F.col("root_hash").alias("observation"), F.col("record_count").alias("entries"))
