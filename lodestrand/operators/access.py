"""Members, invitations, tickets, counters and the audit of accepted changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.display import name_issue


def authorize(requests: DataFrame, members: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """outcome per request (share, endpoint, write, epoch?): unknown_share (where shares are given), not_member, revoked, read_only, stale_session, granted."""
    m = members.select("share", "endpoint", "permission", "revoked_at", F.col("epoch").alias("_epoch"), F.lit(True).alias("_m"))
    joined = requests.join(m, ["share", "endpoint"], "left")
    known = F.lit(True)
    if shares is not None:
        joined = joined.join(shares.select("share").distinct().withColumn("_s", F.lit(True)), "share", "left")
        known = F.col("_s").isNotNull()
    outcome = (
        F.when(~known, "unknown_share").when(F.col("_m").isNull(), "not_member").when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("write") & (F.col("permission") != "read_write"), "read_only")
        .when(F.col("epoch") != F.col("_epoch"), "stale_session").otherwise("granted")
    )
    return joined.withColumn("outcome", outcome).select(*requests.columns, "outcome")


# Limits of a ticket.
MAX_TICKET_BYTES, MAX_ADDRESSES = 8192, 16


def ticket_issue(version: Column, name: Column, issued_at: Column, expires_at: Column, now: Column, owner: Column | None = None, address_id: Column | None = None, addresses: Column | None = None, size: Column | None = None) -> Column:
    """null, version, name, address (of another endpoint than the owner, or too many), size or expired; expired is at its time or before its issue."""
    no = F.lit(False)
    other = ~address_id.eqNullSafe(owner) if owner is not None else no
    many = addresses > MAX_ADDRESSES if addresses is not None else no
    large = size > MAX_TICKET_BYTES if size is not None else no
    return (
        F.when(version != 3, "version").when((name == "") | (F.octet_length(name) > 255) | name.rlike(r"[\x00-\x1f\x7f-\x9f]"), "name").when(other | many, "address").when(large, "size")
        .when(expires_at.isNotNull() & ((expires_at <= now) | (expires_at <= issued_at)), "expired")
    )


#: Fixed value: how a ticket's text begins; its bytes follow as hex digits.
TICKET_PREFIX = "share1-"


def ticket_text(raw: Column) -> Column:
    return F.concat(F.lit(TICKET_PREFIX), F.lower(F.hex(raw)))


def parsed_ticket(text: Column) -> Column:
    """(issue, raw) of a ticket's text: version (another prefix), too_long or malformed, else the bytes; they give the same text again."""
    body = F.substring(text, len(TICKET_PREFIX) + 1, 1_000_000)
    issue = F.when(F.octet_length(text) > 2 * MAX_TICKET_BYTES + len(TICKET_PREFIX), "too_long").when(~F.startswith(text, F.lit(TICKET_PREFIX)), "version").when(~body.rlike("^([0-9a-f]{2})+$"), "malformed")
    return F.struct(issue.alias("issue"), F.when(issue.isNull(), F.unhex(body)).alias("raw"))


def issuance_outcomes(tickets: DataFrame, registry: DataFrame, shares: DataFrame) -> DataFrame:
    """(ticket, outcome) against what was issued: unknown_share, invalid_ticket (never issued, or other than issued), invitation_revoked, valid.

    tickets: (ticket, share, invitation, permission, expires_at, owner, digest); registry: (share, invitation, permission, expires_at, revoked_at,
    digest); shares: (share, owner).
    """
    issued = registry.select("share", "invitation", F.struct(F.lit(True).alias("here"), "permission", "expires_at", "revoked_at", "digest").alias("i"))
    owners = shares.select("share", F.struct(F.lit(True).alias("here"), "owner").alias("s"))
    same = F.lit(True)
    for f in ("permission", "expires_at", "digest"):
        same = same & F.col(f"i.{f}").eqNullSafe(F.col(f))
    outcome = (
        F.when(F.col("s.here").isNull(), "unknown_share").when(F.col("i.here").isNull(), "invalid_ticket").when(F.col("i.revoked_at").isNotNull(), "invitation_revoked")
        .when(~(same & F.col("s.owner").eqNullSafe(F.col("owner"))), "invalid_ticket").otherwise("valid")
    )
    return tickets.join(owners, "share", "left").join(issued, ["share", "invitation"], "left").select("ticket", outcome.alias("outcome"))


def invitation_state(log: DataFrame) -> DataFrame:
    """(share, invitation, permission, expires_at, revoked_at) from an append-only log of issue and revoke_key events (share, invitation, event, permission, expires_at, seq, at).

    The first issue counts, a revocation stays as a tombstone from its first time on, and one of a key that was never issued is nothing.
    """
    first = F.min(F.when(F.col("event") == "issue", F.struct("seq", "permission", "expires_at"))).alias("i")
    state = log.groupBy("share", "invitation").agg(first, F.min(F.when(F.col("event") == "revoke_key", F.struct("seq", "at"))).alias("r"))
    return state.where(F.col("i.seq").isNotNull()).select("share", "invitation", "i.permission", "i.expires_at", F.when(F.col("r.seq") > F.col("i.seq"), F.col("r.at")).alias("revoked_at"))


def membership_state(log: DataFrame) -> DataFrame:
    """Current members from an append-only log (share, endpoint, event, permission, seq): the last event counts, the epoch is revocations + 1."""
    last = F.max_by(F.struct("event", "permission", "seq"), "seq").alias("last")
    return log.groupBy("share", "endpoint").agg(last, (F.count_if(F.col("event") == "revoke") + 1).alias("epoch")).select(
        "share", "endpoint", F.when(F.col("last.event") == "revoke", "revoked").otherwise("active").alias("state"), "last.permission", "epoch"
    )


def ceilings(entries: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Greatest counter seen of each replica. entries: (*group, replica, counter)."""
    return entries.groupBy(*group, "replica").agg(F.max("counter").alias("ceiling"))


def ceiling_issues(entries: DataFrame, known: DataFrame, limit: DataFrame, own: Column, resolver: Column) -> DataFrame:
    """Vector entries a member may not claim: of a replica that isn't known, or beyond what was seen of it, 0 if nothing was (one more for the resolver; its own are free).

    known: (*group, replica); limit: (*group, replica, ceiling).
    """
    on = [c for c in known.columns]
    joined = entries.join(known.distinct().withColumn("_known", F.lit(True)), on, "left").join(limit, [c for c in limit.columns if c != "ceiling"], "left")
    room = F.coalesce("ceiling", F.lit(0)) + F.when(F.col("replica") == resolver, 1).otherwise(0)
    issue = F.when(F.col("_known").isNull(), "unknown_replica").when((F.col("replica") != own) & (F.col("counter") > room), "beyond_ceiling")
    return joined.withColumn("issue", issue).where(F.col("issue").isNotNull()).drop("ceiling", "_known")


def _overlapping(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (id, other) of asked (id, path) and held (other, path) of which one path lies at or below the other: two equal joins on exploded ancestors."""
    up = lambda df, key: df.select(key, F.explode(P.ancestors(F.col("path"))).alias("path"))
    below = up(asked, "id").join(held, "path").select("id", "other")
    above = asked.join(up(held, "other"), "path").select("id", "other")
    return below.unionByName(above).distinct()


def admission_conflicts(asked: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    """(id, conflict): requested roots that overlap one that is held: active (its lease runs), stale (it has run out and can be taken over), private.

    asked: (id, path); held: (other, path, private, lease_until). The strictest of a request counts; a request overlapping nothing gives no row.
    """
    met = _overlapping(asked, held.select("other", "path")).join(held.select("other", "private", "lease_until").distinct(), "other")
    rank = F.when(F.col("private"), 0).when(F.col("lease_until") > now, 1).otherwise(2)
    worst = met.groupBy("id").agg(F.min(rank).alias("_r"))
    return worst.select("id", F.when(F.col("_r") == 0, "private").when(F.col("_r") == 1, "active").otherwise("stale").alias("conflict"))


# What a folder's settings may be, and what they are when nothing is said.
ROLES, INTERVALS, CONNECTIONS = ("sync", "receive"), (1, 86_400), (1, 1024)


def folder_settings(folders: DataFrame, data_dir: str, poll_s: int = 30) -> DataFrame:
    """(id, issue, and the settings with their defaults): the first rule a folder breaks, null if none.

    folders: (id, name, role, root, state, identity, peer, addresses, interval_s, connections). Paths are portable and below one base; state and
    identity default to the folder's own place in the management folder. In order: name, role, root, management (root in it, or a private path in
    another folder's part of it), separate (the three overlap), taken (they overlap another folder's), peer, addresses, interval, connections.
    """
    own = F.concat(F.lit(f"{data_dir}/folders/"), F.col("id").cast("string"))
    full = folders.withColumns({
        "name": F.trim("name"), "state": F.coalesce("state", F.concat(own, F.lit("/state"))), "identity": F.coalesce("identity", F.concat(own, F.lit("/identity.key"))),
        "interval_s": F.coalesce("interval_s", F.lit(poll_s)), "connections": F.coalesce("connections", F.lit(8)),
    })
    parts = full.select("id", F.explode(F.array("root", "state", "identity")).alias("path")).where(F.col("path") != "")
    taken = _overlapping(parts, parts.select(F.col("id").alias("other"), "path")).where("id <> other").select("id", F.lit(True).alias("_taken")).distinct()
    c, base = F.col, F.lit(data_dir)
    private = lambda p: P.overlap(c(p), base) & ~P.under(c(p), own)
    issue = (
        F.when(name_issue(c("name")).isNotNull(), "name").when(~c("role").isin(*ROLES) | c("role").isNull(), "role").when(F.coalesce(F.trim("root"), F.lit("")) == "", "root")
        .when(P.overlap(c("root"), base) | private("state") | private("identity"), "management")
        .when(P.overlap(c("root"), c("state")) | P.overlap(c("root"), c("identity")) | P.overlap(c("state"), c("identity")), "separate").when(c("_taken"), "taken")
        .when((c("role") == "sync") & c("peer").isNull(), "peer").when((c("role") == "sync") & (F.coalesce(F.size("addresses"), F.lit(0)) < 1), "addresses")
        .when(~c("interval_s").between(*INTERVALS), "interval").when(~c("connections").between(*CONNECTIONS), "connections")
    )
    return full.join(taken, "id", "left").select("id", issue.alias("issue"), "name", "state", "identity", "interval_s", "connections")


def group_guards(rows: DataFrame, group: str, member: str, least: int, most: int) -> DataFrame:
    """(group, members, issue): too_few, too_many or duplicate members of each group, as of the sources of a fetch or the members of a share."""
    counted = rows.groupBy(group).agg(F.count("*").alias("members"), F.count_distinct(member).alias("_d"))
    return counted.select(group, "members", F.when(F.col("members") < least, "too_few").when(F.col("members") > most, "too_many").when(F.col("members") != F.col("_d"), "duplicate").alias("issue"))


def adopted(incoming: DataFrame, observed: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, verdict, id_namespace, id_object, rehash): may a replica's record be taken over as the indexed row, given what is there now?

    incoming: records; observed: (*keys, kind, size, modified_ns, readonly, content_hash, id_namespace, id_object) of what is on disk, absent
    for nothing; previous: the indexed rows' identities. A tombstone needs nothing there (still_there) and keeps the old identity; a live row needs its kind,
    permission and, of a file, size and content (absent, kind, readonly, content). rehash tells whether a file's content had to be read:
    not where the observation has all of the record's fields and known times.
    """
    o = observed.select(*keys, F.struct(F.lit(True).alias("here"), "kind", "size", "modified_ns", "readonly", "content_hash", "id_namespace", "id_object").alias("o"))
    p = previous.select(*keys, F.struct("id_namespace", "id_object").alias("p"))
    met = incoming.join(o, keys, "left").join(p, keys, "left")
    dead, file = F.col("tombstone"), F.col("kind") == "file"
    live = (
        F.when(F.col("o.here").isNull(), "absent").when(~F.col("o.kind").eqNullSafe(F.col("kind")), "kind").when(~F.col("o.readonly").eqNullSafe(F.col("readonly")), "readonly")
        .when(file & ~(F.col("o.size").eqNullSafe(F.col("size")) & F.col("o.content_hash").eqNullSafe(F.col("content_hash"))), "content").otherwise("adopt")
    )
    verdict = F.when(dead, F.when(F.col("o.here"), "still_there").otherwise("adopt")).otherwise(live)
    trusted = F.col("o.modified_ns").isNotNull() & F.col("o.id_namespace").isNotNull() & F.col("o.id_object").isNotNull()
    known = lambda f: F.when(dead, F.col(f"p.{f}")).otherwise(F.col(f"o.{f}")).alias(f)
    return met.select(*keys, verdict.alias("verdict"), known("id_namespace"), known("id_object"), (~dead & file & F.col("o.here").isNotNull() & ~trusted).alias("rehash"))


def ring_tail(log: DataFrame, size: int, order: list[Column], group: tuple[str, ...] = ()) -> DataFrame:
    """The last rows of a log. Ungrouped, a top-k per task is merged; grouped, the rank filter is pushed below the shuffle by the planner."""
    if not group:
        return log.orderBy(*order).limit(size)
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return log.withColumn("_at", at).where(F.col("_at") <= size).drop("_at")


def claim_conflicts(enrolments: DataFrame) -> DataFrame:
    """Replicas that several endpoints of a share claim."""
    return enrolments.groupBy("share", "replica").agg(F.count_distinct("endpoint").alias("claims")).where("claims > 1")
