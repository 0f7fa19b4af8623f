"""Members, tickets, counters, audit: over customers, orders, provenance and the passes' vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import records as R
from ..operators import access
from ..runtime import table
from .registry import Registry
from .relations import SNAP, sides

query = Registry()

_MEMBERS = """members AS (SELECT c_nationkey AS share, c_custkey AS endpoint, CASE WHEN c_custkey % 3 = 0 THEN 'read_only' ELSE 'read_write' END AS permission, CASE WHEN c_custkey % 11 = 0 THEN 1000 + c_custkey END AS revoked_at, 1 + c_custkey % 2 AS epoch FROM customer),
  requests AS (SELECT o_orderkey AS request, c_nationkey AS share, o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 1000000 ELSE 0 END AS endpoint, o_orderstatus <> 'F' AS write, 1 + o_orderkey % 2 AS epoch FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _members(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("share"), k.alias("endpoint"), F.when(k % 3 == 0, "read_only").otherwise("read_write").alias("permission"), F.when(k % 11 == 0, k + 1000).alias("revoked_at"), (k % 2 + 1).alias("epoch")
    )


def _requests(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("share"))
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("request"), "share", (F.col("o_custkey") + F.when(k % 13 == 0, 1000000).otherwise(0)).alias("endpoint"), (F.col("o_orderstatus") != "F").alias("write"), (k % 2 + 1).alias("epoch")
    )


@query(f"WITH {_MEMBERS} SELECT q.request, CASE WHEN m.endpoint IS NULL THEN 'not_member' WHEN m.revoked_at IS NOT NULL THEN 'revoked' WHEN q.write AND m.permission <> 'read_write' THEN 'read_only' WHEN q.epoch <> m.epoch THEN 'stale_session' ELSE 'granted' END AS outcome FROM requests q LEFT JOIN members m ON m.share = q.share AND m.endpoint = q.endpoint")
def membership_authorize(spark, sf_dir):
    return access.authorize(_requests(spark, sf_dir), _members(spark, sf_dir)).select("request", "outcome")


@query(f"WITH {_MEMBERS} SELECT request FROM requests WHERE endpoint IN (SELECT endpoint FROM members WHERE revoked_at IS NULL)")
def allowed_peers(spark, sf_dir):
    allowed = _members(spark, sf_dir).where("revoked_at IS NULL").select("endpoint")
    return _requests(spark, sf_dir).join(allowed, "endpoint", "left_semi").select("request")


@query("""SELECT c_custkey, CASE WHEN v <> 3 THEN 'version' WHEN name = '' OR octet_length(encode(name)) > 255 THEN 'name' WHEN c_custkey % 23 = 0 OR c_custkey % 20 > 16 THEN 'address' WHEN c_custkey % 29 = 0 THEN 'size' WHEN e IS NOT NULL AND (e <= 500 OR e <= i) THEN 'expired' END AS issue
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 2 ELSE 3 END AS v, CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_name END AS name, c_custkey % 900 AS i, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 1300 END AS e FROM customer)""")
def ticket_validity(spark, sf_dir):
    k = F.col("c_custkey")
    issue = access.ticket_issue(
        F.when(k % 17 == 0, 2).otherwise(3), F.when(k % 19 == 0, "").otherwise(F.col("c_name")), k % 900, F.when(k % 4 > 0, k % 1300), F.lit(500), k, k + F.when(k % 23 == 0, 1).otherwise(0), k % 20, F.when(k % 29 == 0, 9000).otherwise(100)
    )
    return table(spark, sf_dir, "customer").select("c_custkey", issue.alias("issue"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'version' WHEN c_custkey % 11 = 0 THEN 'malformed' WHEN c_custkey % 13 = 0 THEN 'too_long' END AS issue, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 THEN c_name END AS decoded FROM customer")
def ticket_text(spark, sf_dir):
    """Tickets as texts, some spoiled, and what is read from them."""
    k = F.col("c_custkey")
    name = F.when((k % 13 == 0) & (k % 7 != 0) & (k % 11 != 0), F.repeat("c_name", F.lit(600))).otherwise(F.col("c_name"))
    text = access.ticket_text(F.encode(name, "UTF-8"))
    text = F.when(k % 7 == 0, F.concat(F.lit("old-"), text)).when(k % 11 == 0, F.concat(text, F.lit("0"))).otherwise(text)
    read = table(spark, sf_dir, "customer").select("c_custkey", access.parsed_ticket(text).alias("p"))
    return read.select("c_custkey", "p.issue", F.decode("p.raw", "UTF-8").alias("decoded"))


_LOG = "log AS (SELECT c_nationkey AS share, o_custkey AS endpoint, CASE o_orderstatus WHEN 'F' THEN 'revoke' WHEN 'P' THEN 'issue' ELSE 'enrol' END AS event, CASE WHEN o_orderkey % 3 = 0 THEN 'read_only' ELSE 'read_write' END AS permission, o_orderkey AS seq FROM orders JOIN customer ON c_custkey = o_custkey)"


def _log(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("share"))
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select(
        "share", F.col("o_custkey").alias("endpoint"), F.when(s == "F", "revoke").when(s == "P", "issue").otherwise("enrol").alias("event"), F.when(k % 3 == 0, "read_only").otherwise("read_write").alias("permission"), k.alias("seq")
    )


@query(f"WITH {_LOG} SELECT share, endpoint, CASE WHEN arg_max(event, seq) = 'revoke' THEN 'revoked' ELSE 'active' END AS state, arg_max(permission, seq) AS permission, count(*) FILTER (event = 'revoke') + 1 AS epoch FROM log GROUP BY ALL")
def membership_lifecycle(spark, sf_dir):
    return access.membership_state(_log(spark, sf_dir))


@query("SELECT c_nationkey AS share, c_custkey % 40 AS replica, count(DISTINCT c_custkey) AS claims FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey) > 1")
def replica_claims(spark, sf_dir):
    claims = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("share"), F.col("c_custkey").alias("endpoint"), (F.col("c_custkey") % 40).alias("replica"))
    return access.claim_conflicts(claims)


@query("SELECT o_custkey AS relationship, arg_max(o_orderpriority, o_orderkey) AS permission, count(DISTINCT o_orderstatus) > 1 AS changed_immutable FROM orders GROUP BY ALL")
def relationship_upsert(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("relationship")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("permission"), (F.count_distinct("o_orderstatus") > 1).alias("changed_immutable"))


def _entries(spark, sf_dir):
    return sides(spark, sf_dir).select("pass_id", "side", "path", F.explode("vv").alias("replica", "counter"))


@query(f"WITH {SNAP} SELECT pass_id, replica, max(n) AS ceiling FROM ent GROUP BY ALL")
def version_ceilings(spark, sf_dir):
    return access.ceilings(_entries(spark, sf_dir), ("pass_id",))


@query(f"""WITH {SNAP}, lim AS (SELECT pass_id, replica, max(n) AS ceiling FROM ent WHERE side = 'local' AND path < 'm' GROUP BY ALL), kn AS (SELECT DISTINCT replica FROM ent WHERE side = 'local' AND pass_id % 2 = 0), me AS (SELECT min(replica) AS own, max(replica) AS res FROM ent)
 SELECT pass_id, path, replica, counter, issue FROM (SELECT e.pass_id, e.path, e.replica, e.n AS counter, CASE WHEN e.replica NOT IN (SELECT replica FROM kn) THEN 'unknown_replica'
   WHEN e.replica <> (SELECT own FROM me) AND e.n > coalesce(ceiling, 0) + CASE WHEN e.replica = (SELECT res FROM me) THEN 1 ELSE 0 END THEN 'beyond_ceiling' END AS issue
   FROM ent e LEFT JOIN lim ON lim.pass_id = e.pass_id AND lim.replica = e.replica WHERE e.side = 'remote') WHERE issue IS NOT NULL""")
def ceiling_violations(spark, sf_dir):
    """Known are the replicas that passes of even numbers have on their local side, seen is what local paths before m hold; the least replica is the member's own, the greatest the resolver."""
    entries = _entries(spark, sf_dir)
    local = entries.where("side = 'local'")
    known, seen = local.where("pass_id % 2 = 0").select("replica"), local.where("path < 'm'")
    own, resolver = entries.agg(F.min("replica")).scalar(), entries.agg(F.max("replica")).scalar()
    issues = access.ceiling_issues(entries.where("side = 'remote'"), known, access.ceilings(seen, ("pass_id",)), own, resolver)
    return issues.select("pass_id", "path", "replica", "counter", "issue")


@query(f"WITH {SNAP} SELECT DISTINCT pass_id, replica FROM ent")
def known_replicas(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    both = (entries.where(F.col("side") == s).select("pass_id", "replica") for s in ("local", "remote"))
    return next(both).unionByName(next(both)).distinct()


@query("SELECT seq, path, operation FROM (SELECT DISTINCT seq, path, operation FROM provenance) ORDER BY seq DESC, path, operation LIMIT 512")
def provenance_tail(spark, sf_dir):
    log = table(spark, sf_dir, "provenance").select("seq", "path", "operation").distinct()
    return access.ring_tail(log, 512, [F.col("seq").desc(), F.col("path"), F.col("operation")])


@query("SELECT peer, count(*) AS accepted, count(DISTINCT path) AS paths, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM (SELECT DISTINCT * FROM provenance) GROUP BY ALL")
def audit_by_peer(spark, sf_dir):
    rows = table(spark, sf_dir, "provenance").distinct()
    return rows.groupBy("peer").agg(F.count("*").alias("accepted"), F.count_distinct("path").alias("paths"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))


@query("SELECT user_id AS session, max((epoch_us(ts) // 1000)) + 86400000 AS expires_ms FROM events GROUP BY ALL HAVING max((epoch_us(ts) // 1000)) + 86400000 > (SELECT max((epoch_us(ts) // 1000)) FROM events) - 3600000")
def live_sessions(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max(ms) - 3600000).scalar()
    return events.groupBy(F.col("user_id").alias("session")).agg((F.max(ms) + 86400000).alias("expires_ms")).where(F.col("expires_ms") > now)


@query("SELECT c_custkey, CASE WHEN trim(n) = '' THEN 'empty' WHEN length(trim(n)) > 100 THEN 'too_long' END AS issue FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN repeat(c_name, 6) ELSE c_name END AS n FROM customer)")
def name_validation(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, " ").when(k % 7 == 0, F.repeat("c_name", F.lit(6))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", D.name_issue(text).alias("issue"))


_STATES = "CASE o_orderstatus WHEN 'O' THEN 'prepared' WHEN 'P' THEN 'materialized' ELSE 'committed' END"


@query(f"SELECT o_custkey AS journal, arg_max({_STATES}, o_orderkey) AS state, max(o_orderkey) AS seq FROM orders GROUP BY ALL")
def journal_latest_state(spark, sf_dir):
    from ..streaming.journal import latest_states

    return latest_states(_journal(spark, sf_dir)).select(F.col("id").alias("journal"), "state", "seq")


def _journal(spark, sf_dir):
    s = F.col("o_orderstatus")
    state = F.when(s == "O", "prepared").when(s == "P", "materialized").otherwise("committed")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), state.alias("state"), F.col("o_orderkey").alias("seq"))


@query(f"WITH j AS (SELECT o_custkey AS journal, o_orderkey AS seq, {_STATES} AS to_state FROM orders), k AS (SELECT *, lag(to_state) OVER (PARTITION BY journal ORDER BY seq) AS from_state FROM j) SELECT journal, seq, coalesce(from_state, 'none') AS from_state, to_state FROM k WHERE coalesce(from_state, 'none') || '>' || to_state NOT IN ('none>prepared', 'prepared>preserved', 'prepared>materialized', 'prepared>aborted', 'preserved>materialized', 'preserved>aborted', 'preserved>rolling_back', 'materialized>indexed', 'materialized>rolling_back', 'indexed>committed', 'rolling_back>rolled_back')")
def illegal_transitions(spark, sf_dir):
    from ..streaming.journal import illegal_steps

    return illegal_steps(_journal(spark, sf_dir)).select(F.col("id").alias("journal"), "seq", "from_state", "to_state")


@query("SELECT c_custkey, sha256('root|' || c_name) AS root_binding FROM customer")
def root_bindings(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", R.digest("root", F.col("c_name")).alias("root_binding"))
