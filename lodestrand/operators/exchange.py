"""Pushing and pulling records between replicas: what a receiver or sender accepts, and the receipts it gives.

Every function is a batch over any number of exchanges: requests in, verdicts and receipts out. A verdict names the first
rule that a request breaks, ``accept`` none. Null fields equal nothing but null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import records as R
from ..runtime import cut
from .merge import paired

# Limits of an exchange.
MAX_FILE, MAX_CHUNKS, MAX_CHUNK = 16 << 40, 250_000, 16 << 20

_ROW = ("kind", "size", "content_hash", "readonly", "tombstone", "vv", "vtext")


def _record_issue() -> Column:
    bad = P.path_issue(F.col("path")).isNotNull() | R.record_issue(F.col("kind"), F.col("size"), F.col("content_hash"), F.col("tombstone")).isNotNull()
    return F.when(F.coalesce(bad, F.lit(False)), "invalid_record")


def _causal(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, causal): null, stale, concurrent or divergent against the row that is there."""
    pair = paired(current, incoming, keys).where(F.col("r.here"))
    rel = R.relation(F.col("l.vv"), F.col("r.vv"))
    why = F.when(F.col("l.here").isNull() | (rel == "before"), None).when(rel == "after", "stale").when(rel == "concurrent", "concurrent").when(~R.same("l", "r"), "divergent")
    return pair.select(*keys, why.alias("causal"))


def _receipt(verdict: Column, value: Column) -> Column:
    return F.when(verdict == "accept", value)


def metadata_push(incoming: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, verdict, record_hash): a receiver's answer to directories and tombstones; no content moves."""
    told = incoming.join(_causal(current, incoming, keys), list(keys), "left")
    verdict = F.coalesce(_record_issue(), F.when(~(F.col("tombstone") | (F.col("kind") == "directory")), "unsupported"), F.col("causal"), F.lit("accept"))
    return told.withColumn("verdict", verdict).select(*keys, "verdict", _receipt(F.col("verdict"), R.logical_hash()).alias("record_hash"))


def need(extents: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, missing, missing_bytes, reused_extents) of each manifest: distinct chunks to ask for with their bytes, and extents that needn't be sent.

    A hash that many manifests use is looked up once.
    """
    known = extents.select("hash").distinct().join(stored.select("hash"), "hash", "left_semi").withColumn("_k", F.lit(True))
    uses = extents.groupBy(*keys, "hash").agg(F.max("length").alias("length"), F.count("*").alias("_n")).join(known, "hash", "left")
    here = F.col("_k").isNotNull()
    return uses.groupBy(*keys).agg(F.count_if(~here).alias("missing"), F.coalesce(F.sum(F.when(~here, F.col("length"))), F.lit(0)).alias("missing_bytes"), F.coalesce(F.sum(F.when(here, F.col("_n"))), F.lit(0)).alias("reused_extents"))


def record_push(incoming: DataFrame, manifests: DataFrame, needs: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, verdict, record_hash, transferred_bytes, reused_extents): a receiver's answer to a file's record with its manifest.

    manifests: (*keys, size, chunks, file_hash, issue), issue null if it is valid; needs: see ``need``. In order: invalid_record, no_manifest,
    invalid_manifest, not_live_file, manifest_differs, too_large, too_many_chunks, stale, concurrent, divergent.
    """
    m = manifests.select(*keys, F.struct(F.lit(True).alias("here"), "size", "chunks", "file_hash", "issue").alias("m"))
    told = incoming.join(m, list(keys), "left").join(needs, list(keys), "left").join(_causal(current, incoming, keys), list(keys), "left")
    agree = F.col("m.size").eqNullSafe(F.col("size")) & F.col("m.file_hash").eqNullSafe(F.col("content_hash"))
    verdict = F.coalesce(
        _record_issue(), F.when(F.col("m.here").isNull(), "no_manifest"), F.when(F.col("m.issue").isNotNull(), "invalid_manifest"), F.when(F.col("tombstone") | (F.col("kind") != "file"), "not_live_file"),
        F.when(~agree, "manifest_differs"), F.when(F.col("m.size") > MAX_FILE, "too_large"), F.when(F.col("m.chunks") > MAX_CHUNKS, "too_many_chunks"), F.col("causal"), F.lit("accept"),
    )
    told = told.withColumn("verdict", verdict)
    of = lambda c: _receipt(F.col("verdict"), c)
    return told.select(*keys, "verdict", of(R.logical_hash()).alias("record_hash"), of(F.coalesce("missing_bytes", F.lit(0))).alias("transferred_bytes"), of(F.coalesce("reused_extents", F.lit(0))).alias("reused_extents"))


def record_pull(expected: DataFrame, current: DataFrame, manifests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, verdict): a sender's answer: the row asked for must be a live file and still the indexed one, history included, and its content as told.

    In order: invalid_record, not_live_file, absent, changed, content_changed.
    """
    now = current.select(*keys, F.struct(F.lit(True).alias("here"), *(c for c in _ROW if c != "vv")).alias("c"))
    m = manifests.select(*keys, F.struct(F.lit(True).alias("here"), "size", "file_hash").alias("m"))
    told = expected.join(now, list(keys), "left").join(m, list(keys), "left")
    same = F.col("c.vtext") == F.col("vtext")
    for f in R.STATE:
        same = same & F.col(f"c.{f}").eqNullSafe(F.col(f))
    content = F.col("m.size").eqNullSafe(F.col("size")) & F.col("m.file_hash").eqNullSafe(F.col("content_hash"))
    verdict = F.coalesce(
        _record_issue(), F.when(F.col("tombstone") | (F.col("kind") != "file"), "not_live_file"), F.when(F.col("c.here").isNull(), "absent"), F.when(~same, "changed"), F.when(F.col("m.here").isNull() | ~content, "content_changed"), F.lit("accept")
    )
    return told.select(*keys, verdict.alias("verdict"))


def receipt_issues(receipts: DataFrame, recomputed: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(*keys, field) in which a receipt differs from what the other side worked out itself; ``receipt`` where there is none."""
    side = lambda df, n: df.select(*keys, F.struct(F.lit(True).alias("here"), *fields).alias(n))
    met = side(recomputed, "want").join(side(receipts, "got"), list(keys), "left")
    unlike = F.filter(F.array(*(F.when(~F.col(f"got.{f}").eqNullSafe(F.col(f"want.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return met.select(*keys, F.explode(F.when(F.col("got.here").isNull(), F.array(F.lit("receipt"))).otherwise(unlike)).alias("field"))


def requested_frames(requests: DataFrame, extents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, pos, hash, length, bytes_before, issue): the chunks of each request in the order asked for. issue: duplicate, unknown (not in the manifest).

    requests: (*keys, pos, hash). An exchange's frames are one manifest's chunks.
    """
    from pyspark.sql import Window

    known = extents.groupBy(*keys, "hash").agg(F.max("length").alias("length"))
    first = requests.groupBy(*keys, "hash").agg(F.min("pos").alias("_first"))
    asked = requests.join(first, [*keys, "hash"]).join(known, [*keys, "hash"], "left")
    issue = F.when(F.col("pos") > F.col("_first"), "duplicate").when(F.col("length").isNull(), "unknown")
    sent = asked.withColumn("issue", issue).withColumn("_sent", F.when(issue.isNull(), F.col("length")).otherwise(F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return sent.select(*keys, "pos", "hash", "length", F.coalesce(F.sum("_sent").over(before), F.lit(0)).alias("bytes_before"), "issue")


def request_issues(requests: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """(*keys, asked, issue) of each request for chunks (*keys, hash): too_many, duplicate, null if it may be answered."""
    counted = requests.groupBy(*keys, "hash").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("asked"), F.max("_n").alias("_most"))
    return counted.select(*keys, "asked", F.when(F.col("asked") > most, "too_many").when(F.col("_most") > 1, "duplicate").alias("issue"))


def received_issues(frames: DataFrame, requests: DataFrame, extents: DataFrame, keys: Sequence[str], most: int = MAX_CHUNK) -> DataFrame:
    """(*keys, pos, issue) of frames as they came in (pos, hash, length): order, unknown, length, too_long, surplus; and not_sent for requests without one."""
    known = extents.groupBy(*keys, "hash").agg(F.max("length").alias("_length"))
    met = requests.select(*keys, "pos", F.col("hash").alias("_asked")).join(frames.withColumn("_here", F.lit(True)), [*keys, "pos"], "full_outer").join(known, [*keys, "hash"], "left")
    issue = (
        F.when(F.col("_here").isNull(), "not_sent").when(F.col("_asked").isNull(), "surplus").when(F.col("hash") != F.col("_asked"), "order").when(F.col("_length").isNull(), "unknown")
        .when(F.col("length") != F.col("_length"), "length").when(F.col("length") > most, "too_long")
    )
    return met.withColumn("issue", issue).where(F.col("issue").isNotNull()).select(*keys, "pos", "issue")


def file_receipts(manifests: DataFrame, needs: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, manifest_hash, file_hash, size, transferred_bytes, reused_extents), or why not (issue): a single file pushed without history.

    manifests: (*keys, size, file_hash, manifest_hash); sizes: (*keys, size) of the files as put together. In order: incomplete, size_differs.
    """
    built = sizes.select(*keys, F.col("size").alias("_built"))
    met = manifests.join(needs, list(keys), "left").join(built, list(keys), "left")
    issue = F.when(F.col("_built").isNull(), "incomplete").when(F.col("_built") != F.col("size"), "size_differs")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return met.select(*keys, "manifest_hash", "file_hash", "size", zero("missing_bytes"), zero("reused_extents"), issue.alias("issue")).withColumnRenamed("missing_bytes", "transferred_bytes")


def unresolved(requested: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested hashes that still aren't stored; empty if a fill is complete."""
    lost = requested.select("hash").distinct().join(stored.select("hash"), "hash", "left_anti")
    return requested.select(*keys, "hash").distinct().join(lost, "hash", "left_semi").select(*keys, "hash")


def fallback_totals(partial: DataFrame, full: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, transferred_bytes, sources): what a broken fill from several sources had brought counts to the full pull after it.

    partial: (*keys, peer, bytes); full: (*keys, transferred_bytes).
    """
    brought = partial.groupBy(*keys).agg(F.sum("bytes").alias("_b"), F.count_distinct("peer").alias("_s"))
    met = full.join(brought, list(keys), "left")
    return met.select(*keys, (F.col("transferred_bytes") + F.coalesce("_b", F.lit(0))).alias("transferred_bytes"), F.coalesce("_s", F.lit(0)).alias("sources"))


FAILURES_ALLOWED = 1


def fill(needed: DataFrame, offers: DataFrame, outcome: Column, keys: Sequence[str], most_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(delivered, open) after fetching from several sources in rounds; nothing is open if every chunk came.

    needed: (*keys, hash, length); offers: (*keys, hash, peer, cost). In a round each open chunk is asked from its cheapest source with the
    fewest chunks so far (cost + count, then peer). outcome, an expression over (*keys, hash, peer, attempt), is ok, missing (the peer lacks
    it: the next source is asked) or failed. A first failure of a chunk is tried again at the same source; a second disables the source for
    the exchange, and its chunks go to others. A chunk without a source left is open. The rounds are few: each one delivers a chunk, takes an offer
    away, uses up a second try or disables a source; offers are never listed in one place.
    """
    on = [*keys, "hash"]
    offers = cut(offers.join(needed, on).select(*on, "peer", "cost", "length").withColumn("attempt", F.lit(1)))
    done = None
    load = offers.select(*keys, "peer").limit(0).withColumn("_load", F.lit(0).cast("bigint"))
    for _ in range(most_rounds):
        rated = offers.join(load, [*keys, "peer"], "left").withColumn("_load", F.coalesce("_load", F.lit(0)))
        # a chunk tried once goes back to the same source; else the least cost counts
        pick = F.min(F.struct(-F.col("attempt"), (F.col("cost") + F.col("_load")).alias("c"), F.col("_load").alias("l"), "peer", "length", "attempt")).alias("p")
        asked = rated.groupBy(*on).agg(pick).select(*on, "p.peer", "p.length", "p.attempt").withColumn("outcome", outcome)
        asked = cut(asked)
        if asked.isEmpty():
            break
        came = asked.where("outcome = 'ok'").select(*on, "peer", "length")
        done = came if done is None else done.unionByName(came)
        done = cut(done)
        load = done.groupBy(*keys, "peer").agg(F.count("*").alias("_load"))
        off = asked.where(f"outcome = 'failed' AND attempt > {FAILURES_ALLOWED}").select(*keys, "peer").distinct()
        again = asked.where("outcome = 'failed'").select(*on, "peer", F.lit(True).alias("_again"))
        gone = asked.where("outcome = 'missing'").select(*on, "peer")
        left = offers.join(came.select(*on), on, "left_anti").join(gone, [*on, "peer"], "left_anti").join(off, [*keys, "peer"], "left_anti")
        offers = cut(left.join(again, [*on, "peer"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("_again"), 1).otherwise(0)).drop("_again"))
    done = done if done is not None else needed.select(*on, F.lit(None).cast(dict(offers.dtypes)["peer"]).alias("peer"), "length").limit(0)
    return done, needed.join(done.select(*on), on, "left_anti")
