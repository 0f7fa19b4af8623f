"""Manifests, deltas, storage and swarm scheduling: over extents, inventory, plans, suppliers and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import records as R
from ..functions.pyfuncs import content_chunks
from ..functions.text import digest_bytes
from ..operators import delta, exchange, swarm
from ..runtime import spread, table
from .registry import Registry
from .relations import EXTENTS, MANIFESTS, STORED, extents, sql_key, stored

query = Registry()
HIGH = 8 << 20
#: Chunk sizes for texts of a few thousand bytes.
SMALL = (64, 256, 1024)

_AT = f"WITH {EXTENTS}, placed AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS expected FROM ext)"


@query(_AT + " SELECT path, idx, chunk_offset, expected, chunk_offset = expected AS contiguous FROM placed")
def manifest_contiguity(spark, sf_dir):
    return delta.contiguity(extents(spark, sf_dir)).select("path", "idx", "chunk_offset", "expected", (F.col("chunk_offset") == F.col("expected")).alias("contiguous"))


@query(
    _AT
    + f""", f AS (SELECT path, bool_or(chunk_offset <> expected) AS gap, bool_or(length <= 0) AS empty_chunk, bool_or(length > {HIGH}) AS chunk_too_long, max(idx) + 1 <> count(*) AS index_gap FROM placed GROUP BY ALL),
  t AS (SELECT path, bool_or(d) AS length_differs FROM (SELECT path, hash, min(length) <> max(length) AS d FROM ext GROUP BY ALL) GROUP BY ALL)
SELECT path, 'gap' AS issue FROM f WHERE gap UNION ALL SELECT path, 'empty_chunk' FROM f WHERE empty_chunk UNION ALL SELECT path, 'chunk_too_long' FROM f WHERE chunk_too_long
UNION ALL SELECT path, 'index_gap' FROM f WHERE index_gap UNION ALL SELECT path, 'length_differs' FROM t WHERE length_differs"""
)
def manifest_violations(spark, sf_dir):
    return delta.manifest_issues(extents(spark, sf_dir), HIGH)


@query(f"WITH {EXTENTS}, {STORED}, u AS (SELECT path, hash, max(length) AS length, count(*) AS uses FROM ext GROUP BY ALL) SELECT path, count(*) FILTER (s.hash IS NULL) AS missing, CAST(coalesce(sum(u.length) FILTER (s.hash IS NULL), 0) AS BIGINT) AS transfer_bytes, CAST(coalesce(sum(uses) FILTER (s.hash IS NOT NULL), 0) AS BIGINT) AS reused_extents FROM u LEFT JOIN stored s ON u.hash = s.hash GROUP BY ALL")
def delta_plan(spark, sf_dir):
    return delta.delta_plan(extents(spark, sf_dir), stored(spark, sf_dir))


@query(f"WITH {EXTENTS}, {STORED} SELECT path, hash, min(idx) AS first_idx, max(length) AS length FROM ext WHERE hash NOT IN (SELECT hash FROM stored) GROUP BY ALL")
def missing_chunks(spark, sf_dir):
    return delta.missing(extents(spark, sf_dir), stored(spark, sf_dir)).select("path", "hash", "first_idx", "length")


@query(f"WITH {EXTENTS}, {STORED}, m AS (SELECT hash, max(length) AS length FROM ext WHERE hash NOT IN (SELECT hash FROM stored) GROUP BY ALL) SELECT count(*) AS chunks, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes FROM m")
def unique_missing_bytes(spark, sf_dir):
    lost = extents(spark, sf_dir).groupBy("hash").agg(F.max("length").alias("length")).join(stored(spark, sf_dir).select("hash"), "hash", "left_anti")
    return lost.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


@query(f"WITH {EXTENTS} SELECT count(*) AS extents, count(DISTINCT hash) AS chunks, CAST(sum(length) AS BIGINT) AS bytes, (SELECT CAST(sum(l) AS BIGINT) FROM (SELECT max(length) AS l FROM ext GROUP BY hash)) AS unique_bytes FROM ext")
def dedup_ratio(spark, sf_dir):
    per_hash = extents(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.max("length").alias("l"))
    return per_hash.agg(F.sum("n").alias("extents"), F.count("*").alias("chunks"), F.sum("b").alias("bytes"), F.sum("l").alias("unique_bytes"))


@query(f"WITH {EXTENTS}, {STORED}, i AS (SELECT hash, max(length) AS length FROM ext GROUP BY ALL) SELECT substring(i.hash, 1, 2) AS shard, count(*) FILTER (s.hash IS NULL) AS new_chunks, count(*) FILTER (s.hash IS NOT NULL) AS present_chunks FROM i LEFT JOIN stored s ON i.hash = s.hash GROUP BY ALL")
def store_put(spark, sf_dir):
    put = delta.put_chunks(stored(spark, sf_dir), extents(spark, sf_dir))
    return put.groupBy(delta.shard(F.col("hash")).alias("shard")).agg(F.count_if("is_new").alias("new_chunks"), F.count_if(~F.col("is_new")).alias("present_chunks"))


_ASKED = f"asked AS (SELECT plan_id, CAST(pos - 1 AS INTEGER) AS pos, {sql_key('h')} AS hash FROM (SELECT plan_id, unnest(range(1, len(missing) + 1)) AS pos, unnest(missing) AS h FROM delta_plans) WHERE {sql_key('h')} IS NOT NULL)"


def _asked(spark, sf_dir):
    rows = table(spark, sf_dir, "delta_plans").select("plan_id", F.posexplode("missing").alias("pos", "h"))
    return rows.select("plan_id", "pos", F.lower(F.hex(digest_bytes(F.col("h")))).alias("hash")).where("hash IS NOT NULL")


@query(f"WITH {STORED}, {_ASKED} SELECT plan_id, pos, asked.hash, stored.hash IS NOT NULL AS available FROM asked LEFT JOIN stored ON asked.hash = stored.hash")
def availability_bits(spark, sf_dir):
    have = stored(spark, sf_dir).select("hash", F.lit(True).alias("_h"))
    return _asked(spark, sf_dir).join(have, "hash", "left").select("plan_id", "pos", "hash", F.col("_h").isNotNull().alias("available"))


@query(f"WITH {STORED}, {_ASKED} SELECT plan_id, count(*) FILTER (stored.hash IS NOT NULL) AS sent, count(*) FILTER (stored.hash IS NULL) AS reported_missing, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes FROM asked LEFT JOIN stored ON asked.hash = stored.hash GROUP BY ALL")
def requested_send(spark, sf_dir):
    sent = _asked(spark, sf_dir).join(stored(spark, sf_dir).withColumn("_h", F.lit(True)), "hash", "left")
    return sent.groupBy("plan_id").agg(F.count_if(F.col("_h").isNotNull()).alias("sent"), F.count_if(F.col("_h").isNull()).alias("reported_missing"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


@query(f"WITH {_ASKED} SELECT plan_id, count(*) AS asked, CASE WHEN count(*) > 12 THEN 'too_many' WHEN count(*) <> count(DISTINCT hash) THEN 'duplicate' END AS issue FROM asked GROUP BY ALL")
def request_guards(spark, sf_dir):
    """Plans as requests for chunks, of which one may ask for a dozen."""
    return exchange.request_issues(_asked(spark, sf_dir), ["plan_id"], 12)


@query(f"WITH {_ASKED} SELECT plan_id, hash, count(*) AS n FROM asked GROUP BY ALL HAVING count(*) > 1")
def duplicate_requests(spark, sf_dir):
    return _asked(spark, sf_dir).groupBy("plan_id", "hash").agg(F.count("*").alias("n")).where("n > 1")


@query(
    f"""WITH {STORED}, {_ASKED}, q AS (SELECT DISTINCT plan_id, hash FROM asked), pr AS (SELECT q.* FROM q JOIN stored USING (hash) WHERE substring(q.hash, 1, 1) <> '0'),
 ab AS (SELECT * FROM q WHERE hash NOT IN (SELECT hash FROM stored) OR substring(hash, 1, 2) = 'ff'), an AS (SELECT plan_id, hash, count(*) AS n FROM (SELECT * FROM pr UNION ALL SELECT * FROM ab) GROUP BY ALL)
SELECT plan_id, hash, 'duplicate' AS issue FROM an WHERE n > 1 UNION ALL SELECT plan_id, hash, 'unanswered' FROM q WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.plan_id = q.plan_id AND an.hash = q.hash)"""
)
def chunk_outcome_violations(spark, sf_dir):
    """Answers in which what is stored under '0' is forgotten and what begins with 'ff' is reported missing whatever is stored."""
    asked = _asked(spark, sf_dir).select("plan_id", "hash").distinct()
    have = stored(spark, sf_dir).select("hash")
    present = asked.join(have, "hash", "left_semi").where("substring(hash, 1, 1) <> '0'")
    absent = asked.join(have, "hash", "left_anti").unionByName(asked.join(have, "hash", "left_semi").where("substring(hash, 1, 2) = 'ff'"))
    return delta.outcome_issues(asked, present, absent, ["plan_id"])


@query(f"WITH {EXTENTS}, {MANIFESTS} SELECT path, manifest_hash, size, chunks, sha256('operation|' || path || '|' || manifest_hash) AS operation_id FROM mani")
def manifest_hashes(spark, sf_dir):
    return delta.manifest_hash(extents(spark, sf_dir)).withColumn("operation_id", R.digest("operation", F.col("path"), F.col("manifest_hash")))


@query(f"WITH {EXTENTS}, p AS (SELECT path, arg_max(plan_id, plan_id) AS plan_id, arg_max(reused_extents, plan_id) AS reused, arg_max(len(list_distinct(list_filter(list_transform(missing, lambda h: {sql_key('h')}), lambda x: x IS NOT NULL))), plan_id) AS planned FROM delta_plans WHERE missing IS NOT NULL GROUP BY ALL) SELECT p.path, plan_id, planned, reused, count(*) AS extents_now, count(*) < planned + reused AS shrunk FROM p JOIN ext ON ext.path = p.path GROUP BY p.path, plan_id, planned, reused")
def plan_against_manifest(spark, sf_dir):
    """The last plan of a path beside the extents there are now."""
    distinct = F.size(F.array_distinct(F.filter(F.transform("missing", digest_bytes), lambda x: x.isNotNull())))
    plans = table(spark, sf_dir, "delta_plans").where("missing IS NOT NULL").select("path", "plan_id", "reused_extents", distinct.cast("bigint").alias("planned"))
    last = plans.groupBy("path").agg(F.max(F.struct("plan_id", "planned", F.col("reused_extents").alias("reused"))).alias("m")).select("path", "m.*")
    now = extents(spark, sf_dir).groupBy("path").agg(F.count("*").alias("extents_now"))
    return last.join(now, "path").withColumn("shrunk", F.col("extents_now") < F.col("planned") + F.col("reused"))


_LINES = "lines AS (SELECT doc_id, i - 1 AS idx, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"


def _lines(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))


@query(f"WITH {_LINES} SELECT doc_id AS path, CAST(idx AS INTEGER) AS idx, CAST(octet_length(encode(line)) AS BIGINT) AS length, sha256(line) AS hash, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk_offset FROM lines")
def line_extents(spark, sf_dir):
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line").cast("bigint")
    return _lines(spark, sf_dir).select(F.col("doc_id").alias("path"), "idx", size.alias("length"), F.sha2("line", 256).alias("hash"), F.coalesce(F.sum(size + 1).over(before), F.lit(0)).alias("chunk_offset"))


@query("SELECT doc_id AS path, sha256(text) AS file_hash, sha256(text) AS materialised_hash, true AS complete FROM documents WHERE text IS NOT NULL")
def materialise_check(spark, sf_dir):
    """Files put together again from their stored lines have the digest of the whole."""
    parts = _lines(spark, sf_dir).select(F.col("doc_id").alias("path"), "idx", F.when(F.col("idx") == 0, F.col("line")).otherwise(F.concat(F.lit("\n"), F.col("line"))).alias("piece")).withColumn("hash", F.sha2("piece", 256))
    store = parts.groupBy("hash").agg(F.first("piece").cast("binary").alias("content"))
    whole = delta.reassembled(parts, store).select("path", F.sha2("content", 256).alias("materialised_hash"), "complete")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("file_hash"))
    return docs.join(whole, "path").select("path", "file_hash", "materialised_hash", "complete")


@query("SELECT doc_id AS path, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, true AS contiguous, true AS within_bounds FROM documents WHERE text <> ''")
def cdc_chunk_invariants(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")))
    chunks = content_chunks(docs, profile=SMALL)
    at = delta.contiguity(chunks)
    last = at.groupBy("path").agg(F.max("idx").alias("_last"))
    joined = at.join(last, "path")
    fine = (F.col("length") <= 1024) & ((F.col("length") >= 64) | (F.col("idx") == F.col("_last")))
    return joined.groupBy("path").agg(F.sum("length").alias("bytes"), F.min(F.col("chunk_offset") == F.col("expected")).alias("contiguous"), F.min(fine).alias("within_bounds"))


@query("SELECT doc_id AS path, doc_id % 5 <> 0 OR text = '' AS matches FROM documents WHERE text IS NOT NULL")
def files_against_manifests(spark, sf_dir):
    """Texts cut by content and read again by place; in every fifth a blank has come in front, so that it isn't what its manifest says."""
    docs = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")))
    moved = F.when((F.col("path") % 5 == 0) & (F.octet_length("content") > 0), F.concat(F.lit(b" "), "content")).otherwise(F.col("content"))
    return delta.files_match(docs.withColumn("content", moved), content_chunks(docs, profile=SMALL))


@query(_AT + f""", d AS (SELECT path, CASE WHEN ascii(path[-5:]) % 11 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN ascii(path[-6:]) % 7 = 0 THEN 0 ELSE sum(length) + CASE WHEN ascii(path[-7:]) % 5 = 0 THEN 1 ELSE 0 END END AS size FROM ext GROUP BY path
   UNION ALL SELECT 'none/' || n_nationkey, 1, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 5 END FROM nation),
 f AS (SELECT path, bool_or(chunk_offset <> expected) AS gap, bool_or(length <= 0) AS empty_chunk, bool_or(length > {HIGH}) AS long, max(idx) + 1 <> count(*) AS index_gap, CAST(sum(length) AS BIGINT) AS total FROM placed GROUP BY ALL), t AS (SELECT path, bool_or(d) AS twice FROM (SELECT path, hash, min(length) <> max(length) AS d FROM ext GROUP BY ALL) GROUP BY ALL)
SELECT path, issue FROM (SELECT d.path, CASE WHEN version <> 1 THEN 'version' WHEN size = 0 AND f.path IS NOT NULL THEN 'chunks_for_empty_file' WHEN size = 0 AND ends_with(d.path, '4') THEN 'empty_hash' WHEN size <> 0 AND f.path IS NULL THEN 'missing_chunks'
  WHEN long THEN 'chunk_too_long' WHEN empty_chunk THEN 'empty_chunk' WHEN gap THEN 'gap' WHEN index_gap THEN 'index_gap' WHEN twice THEN 'length_differs' WHEN coalesce(total, 0) <> size THEN 'size' END AS issue FROM d LEFT JOIN f ON f.path = d.path LEFT JOIN t ON t.path = d.path) WHERE issue IS NOT NULL""")
def manifest_rules(spark, sf_dir):
    """Manifests with what they declare, some wrongly, and some of files without a chunk."""
    ext = extents(spark, sf_dir)
    at = lambda n: F.ascii(F.substring("path", -n, n))
    total = ext.groupBy("path").agg(F.sum("length").alias("_s"))
    declared = total.select("path", F.when(at(5) % 11 == 0, 2).otherwise(1).alias("version"), F.when(at(6) % 7 == 0, 0).otherwise(F.col("_s") + F.when(at(7) % 5 == 0, 1).otherwise(0)).alias("size"), F.lit("00").alias("file_hash"))
    k = F.col("n_nationkey")
    path = F.concat(F.lit("none/"), k.cast("string"))
    empty = table(spark, sf_dir, "nation").select(path.alias("path"), F.lit(1).alias("version"), F.when(k % 2 == 0, 0).otherwise(5).alias("size"), F.when(F.endswith(path, F.lit("4")), "00").otherwise(delta.EMPTY).alias("file_hash"))
    return delta.declared_issues(declared.unionByName(empty), ext, HIGH)


@query(None)
def content_chunk_sharing(spark, sf_dir):
    """How many chunks, and how many different ones, the texts have when they are cut by content."""
    docs = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")))
    per_hash = content_chunks(docs, profile=SMALL).groupBy("hash").agg(F.count("*").alias("n"))
    return per_hash.agg(F.sum("n").alias("chunks"), F.count("*").alias("different"))


@query("SELECT path, size, CASE WHEN size >= 8589934592 THEN 1048576 ELSE 16384 END AS min_size, CASE WHEN size >= 8589934592 THEN 4194304 ELSE 65536 END AS avg_size, CASE WHEN size >= 8589934592 THEN 16777216 ELSE 262144 END AS max_size FROM (SELECT DISTINCT path, size * 20000 AS size FROM index_records WHERE size IS NOT NULL AND path IS NOT NULL)")
def profile_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "index_records").where("size IS NOT NULL AND path IS NOT NULL").select("path", (F.col("size") * 20000).alias("size")).distinct()
    return rows.select("path", "size", R.profile_for(F.col("size")).alias("p")).select("path", "size", "p.*")


@query("SELECT p_partkey, CASE WHEN v <> 1 THEN 'version' WHEN NOT (lo BETWEEN 64 AND 1048576) THEN 'minimum' WHEN NOT (me BETWEEN 256 AND 4194304) THEN 'average' WHEN NOT (hi BETWEEN 1024 AND 16777216) THEN 'maximum' WHEN NOT (lo < me AND me < hi) THEN 'order' WHEN lo % 2 <> 0 OR me % 2 <> 0 OR hi % 2 <> 0 THEN 'odd' END AS issue FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 1 END AS v, p_size * 3 AS lo, p_size * 40 AS me, p_partkey * 5 AS hi FROM part)")
def profile_validation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, 2).otherwise(1).alias("v"), (F.col("p_size") * 3).alias("lo"), (F.col("p_size") * 40).alias("me"), (F.col("p_partkey") * 5).alias("hi"))
    return p.select("p_partkey", R.profile_issue(F.col("v"), F.col("lo"), F.col("me"), F.col("hi")).alias("issue"))


_PEERS = "peers AS (SELECT s_suppkey AS peer, 5 + s_suppkey * 37 % 190 AS rtt_ms, s_suppkey * 7919 % 5000000 AS queued_bytes, CAST(greatest(floor(s_acctbal), 0) * 1000 AS BIGINT) AS goodput_bps, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 0 END AS failure_penalty FROM supplier), avail AS (SELECT DISTINCT l_suppkey AS peer, l_partkey AS hash FROM lineitem), miss AS (SELECT p_partkey AS hash FROM part)"


def _peers(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("peer"), (F.lit(5) + k * 37 % 190).alias("rtt_ms"), (k * 7919 % 5000000).alias("queued_bytes"), (F.greatest(F.floor("s_acctbal"), F.lit(0)) * 1000).cast("bigint").alias("goodput_bps"), F.when(k % 5 == 0, 2).otherwise(0).alias("failure_penalty")
    )


def _avail(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("peer"), F.col("l_partkey").alias("hash"))


def _miss(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash"))


@query(f"WITH {_PEERS} SELECT miss.hash, count(peer) AS providers FROM miss LEFT JOIN avail ON avail.hash = miss.hash GROUP BY ALL")
def provider_counts(spark, sf_dir):
    return swarm.provider_counts(_miss(spark, sf_dir), _avail(spark, sf_dir))


@query(f"WITH {_PEERS} SELECT miss.hash, count(peer) AS providers FROM miss LEFT JOIN avail ON avail.hash = miss.hash GROUP BY ALL ORDER BY providers, miss.hash LIMIT 100")
def rarest_first(spark, sf_dir):
    return swarm.provider_counts(_miss(spark, sf_dir), _avail(spark, sf_dir)).orderBy("providers", "hash").limit(100)


@query(f"WITH {_PEERS}, c AS (SELECT miss.hash, count(peer) AS providers FROM miss LEFT JOIN avail ON avail.hash = miss.hash GROUP BY ALL) SELECT hash, providers, row_number() OVER (ORDER BY providers, hash) AS rank FROM c")
def rarest_order(spark, sf_dir):
    """The whole order, of which rarest_first shows the first 100."""
    return swarm.rarest_order(_miss(spark, sf_dir), _avail(spark, sf_dir))


@query(f"WITH {_PEERS}, c AS (SELECT miss.hash, peer, rtt_ms + queued_bytes * 1000 // greatest(goodput_bps, 1) + failure_penalty * 500 AS cost_ms FROM miss JOIN avail ON avail.hash = miss.hash JOIN peers USING (peer)) SELECT hash, peer, CAST(cost_ms AS BIGINT) AS cost_ms FROM c QUALIFY row_number() OVER (PARTITION BY hash ORDER BY cost_ms, peer) = 1")
def min_cost_peer(spark, sf_dir):
    return swarm.cheapest_peer(_miss(spark, sf_dir), _avail(spark, sf_dir), _peers(spark, sf_dir))


@query("WITH c AS (SELECT n_nationkey AS self_id, CAST(n_nationkey * 7 AS BIGINT) AS n FROM nation WHERE n_nationkey > 0), t AS (SELECT *, CASE WHEN n <= 1 THEN n WHEN n <= 10 THEN least(6, n) WHEN n <= 100 THEN least(8, n) ELSE least(12, n) END AS a FROM c), u AS (SELECT *, CASE WHEN n <= 1 THEN 0 WHEN n <= 10 THEN least(12, n - a) WHEN n <= 100 THEN least(32, n - a) ELSE least(64, n - a) END AS p FROM t), e AS (SELECT self_id, a, p, sha256(self_id || ':' || i) AS peer FROM (SELECT *, unnest(range(0, n)) AS i FROM u)), k AS (SELECT *, row_number() OVER (PARTITION BY self_id ORDER BY peer) AS rank FROM e) SELECT self_id, peer, rank, CASE WHEN rank <= a THEN 'active' ELSE 'passive' END AS band FROM k WHERE rank <= a + p")
def overlay_bands(spark, sf_dir):
    counts = table(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("self_id"), (F.col("n_nationkey") * 7).cast("bigint").alias("n"))
    return swarm.overlay_bands(counts)


@query(None)
def greedy_schedule(spark, sf_dir):
    jobs = _miss(spark, sf_dir).withColumn("job", F.col("hash") % 10)
    return swarm.greedy_schedule(jobs, _avail(spark, sf_dir), _peers(spark, sf_dir))


@query(f"WITH {_PEERS}, d AS (SELECT peer, hash FROM avail) SELECT peer, count(*) AS chunks, CAST(sum(hash % 1000 + 1) AS BIGINT) AS bytes FROM d GROUP BY ALL")
def source_receipts(spark, sf_dir):
    done = _avail(spark, sf_dir).distinct()
    return done.groupBy("peer").agg(F.count("*").alias("chunks"), F.sum(F.col("hash") % 1000 + 1).alias("bytes"))


@query("SELECT s_suppkey, sha256('source|' || s_suppkey || '|' || s_nationkey) AS source_id, CAST(least(620, ceil(s_suppkey * 1000 / 4096) * 10 + 10) AS BIGINT) AS timeout_s FROM supplier")
def source_tags(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.digest("source", k, F.col("s_nationkey")).alias("source_id"), D.page_timeout_s(k * 1000).alias("timeout_s"))


@query("SELECT s_suppkey, CASE WHEN shared AND least(a, b) < w + v + r THEN 'shared' WHEN NOT shared AND a < w + r THEN 'state' WHEN NOT shared AND b < v + r THEN 'destination' END AS issue FROM (SELECT s_suppkey, s_suppkey % 2 = 0 AS shared, s_suppkey * 131 % 1000 AS a, s_suppkey * 71 % 1000 AS b, s_suppkey * 17 % 400 AS w, s_suppkey * 29 % 400 AS v, 50 AS r FROM supplier)")
def space_budget(spark, sf_dir):
    k = F.col("s_suppkey")
    issue = D.budget_issue(k % 2 == 0, k * 131 % 1000, k * 71 % 1000, k * 17 % 400, k * 29 % 400, F.lit(50))
    return table(spark, sf_dir, "supplier").select("s_suppkey", issue.alias("issue"))
