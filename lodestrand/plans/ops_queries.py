"""Dashboards, searches, histories, streams: over events, reports, customers, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import paths as P
from ..functions.text import tidy
from ..operators import dashboard
from ..runtime import table
from ..streaming import debounce, fold
from .registry import Registry
from .relations import sql_tidy

query = Registry()

_STATUS = "CASE c_custkey % 5 WHEN 0 THEN 'paused' WHEN 1 THEN 'error' WHEN 2 THEN 'syncing' WHEN 3 THEN 'stopped' ELSE 'checked' END"
_FOLDERS = f"folders AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS root, {_STATUS} AS status, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 + 1 END AS device_id, 'ep-' || c_nationkey AS peer_endpoint, ['ep-' || (c_custkey % 7), 'ep-' || (c_custkey % 11)] AS allowed_peers, c_custkey % 50 AS files, CAST(floor(abs(c_acctbal)) AS BIGINT) AS bytes, '{{\"conflicts\": [' || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1' ELSE '1, 2' END || ']}}' AS last_report FROM customer)"


def _folders(spark, sf_dir):
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, "paused").when(k % 5 == 1, "error").when(k % 5 == 2, "syncing").when(k % 5 == 3, "stopped").otherwise("checked")
    report = F.concat(F.lit('{"conflicts": ['), F.when(k % 3 == 0, "").when(k % 3 == 1, "1").otherwise("1, 2"), F.lit("]}"))
    ep = lambda c: F.concat(F.lit("ep-"), c.cast("string"))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("root"), status.alias("status"), F.when(k % 3 == 0, k % 100 + 1).alias("device_id"), ep(F.col("c_nationkey")).alias("peer_endpoint"),
        F.array(ep(k % 7), ep(k % 11)).alias("allowed_peers"), (k % 50).alias("files"), F.floor(F.abs("c_acctbal")).cast("bigint").alias("bytes"), report.alias("last_report"),
    )


def _devices(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("ep-"), F.col("s_nationkey").cast("string")).alias("endpoint"))


_DEVICES = "devices AS (SELECT s_suppkey AS id, s_name AS name, 'ep-' || s_nationkey AS endpoint FROM supplier)"
_EVENTS = "ev AS (SELECT event_id AS seq, ts, user_id AS folder, event_type AS phase, CAST(floor(abs(value)) AS BIGINT) AS bytes, props FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("folder"), F.col("event_type").alias("phase"), F.floor(F.abs("value")).cast("bigint").alias("bytes"), "props")


@query(f"WITH {_FOLDERS} SELECT count(*) AS folders, count(*) FILTER (status NOT IN ('paused', 'stopped', 'error')) AS active, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(id % 3) AS BIGINT) AS conflicts FROM folders")
def dashboard_totals(spark, sf_dir):
    conflicts = F.size(F.from_json("last_report", "conflicts array<int>")["conflicts"])
    return _folders(spark, sf_dir).agg(F.count("*").alias("folders"), F.count_if(~F.col("status").isin("paused", "stopped", "error")).alias("active"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum(conflicts).alias("conflicts"))


@query(f"WITH {_FOLDERS} SELECT root, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'syncing') AS syncing, count(*) FILTER (status = 'checked') AS checked, bool_and(status = 'paused') AS all_paused FROM folders GROUP BY ALL")
def status_counts(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s).alias
    return _folders(spark, sf_dir).groupBy("root").agg(n("error")("errors"), n("syncing")("syncing"), n("checked")("checked"), F.bool_and(F.col("status") == "paused").alias("all_paused"))


@query(f"WITH {_FOLDERS} SELECT id, name FROM folders WHERE contains(lower(name || ' ' || root || ' ' || peer_endpoint), 'building') AND status = 'error'")
def folder_search(spark, sf_dir):
    return dashboard.search(_folders(spark, sf_dir).where("status = 'error'"), "Building", "name", "root", "peer_endpoint").select("id", "name")


@query(f"WITH {_DEVICES} SELECT id, name FROM devices WHERE contains(lower(name || ' ' || endpoint || ' ' || id), 'ep-1')")
def device_search(spark, sf_dir):
    return dashboard.search(_devices(spark, sf_dir), "EP-1", "name", "endpoint", "id").select("id", "name")


@query(f"WITH {_FOLDERS}, {_DEVICES} SELECT DISTINCT d.id AS device, f.id AS folder FROM folders f JOIN devices d ON f.device_id = d.id OR f.peer_endpoint = d.endpoint OR list_contains(f.allowed_peers, d.endpoint)")
def device_folders(spark, sf_dir):
    return dashboard.linked_folders(_devices(spark, sf_dir), _folders(spark, sf_dir))


@query(f"WITH {_FOLDERS}, {_DEVICES} SELECT f.id, CASE WHEN d.id IS NULL THEN 'dangling' ELSE 'endpoint_changed' END AS issue FROM folders f LEFT JOIN devices d ON f.device_id = d.id WHERE f.device_id IS NOT NULL AND (d.id IS NULL OR d.endpoint <> f.peer_endpoint)")
def device_reference_issues(spark, sf_dir):
    d = _devices(spark, sf_dir).select(F.col("id").alias("device_id"), "endpoint", F.lit(True).alias("_d"))
    joined = _folders(spark, sf_dir).where("device_id IS NOT NULL").join(d, "device_id", "left")
    issue = F.when(F.col("_d").isNull(), "dangling").when(F.col("endpoint") != F.col("peer_endpoint"), "endpoint_changed")
    return joined.select("id", issue.alias("issue")).where("issue IS NOT NULL")


@query(f"WITH {_EVENTS} SELECT CAST(folder % 100 AS BIGINT) AS device, max((epoch_us(ts) // 1000)) AS last_seen_ms FROM ev GROUP BY ALL")
def device_last_seen(spark, sf_dir):
    return _events(spark, sf_dir).groupBy((F.col("folder") % 100).alias("device")).agg(F.max(F.unix_millis("ts")).alias("last_seen_ms"))


@query(f"WITH {_FOLDERS}, {_EVENTS} SELECT f.id, f.name, count(*) AS activities, CAST(sum(ev.bytes) AS BIGINT) AS bytes FROM folders f JOIN ev ON ev.folder = f.id GROUP BY ALL")
def folder_activities(spark, sf_dir):
    per = _events(spark, sf_dir).groupBy(F.col("folder").alias("id")).agg(F.count("*").alias("activities"), F.sum("bytes").alias("moved"))
    return _folders(spark, sf_dir).join(per, "id").select("id", "name", "activities", F.col("moved").alias("bytes"))


@query(f"WITH {_EVENTS} SELECT CAST(epoch_ms(date_trunc('day', ts)) AS BIGINT) AS day_ms, CAST(coalesce(sum(bytes) FILTER (seq % 2 = 0), 0) AS BIGINT) AS pushed_bytes, CAST(coalesce(sum(bytes) FILTER (seq % 2 = 1), 0) AS BIGINT) AS pulled_bytes FROM ev GROUP BY ALL")
def transfer_history(spark, sf_dir):
    total = lambda odd: F.coalesce(F.sum(F.when(F.col("seq") % 2 == odd, F.col("bytes"))), F.lit(0))
    return _events(spark, sf_dir).groupBy(F.unix_millis(F.date_trunc("day", "ts")).alias("day_ms")).agg(total(0).alias("pushed_bytes"), total(1).alias("pulled_bytes"))


@query(f"WITH {_EVENTS}, h AS (SELECT date_trunc('day', ts) AS d, coalesce(sum(bytes) FILTER (seq % 2 = 0), 0) AS pu, coalesce(sum(bytes) FILTER (seq % 2 = 1), 0) AS pl FROM ev GROUP BY ALL) SELECT CAST(sum(pu) AS BIGINT) AS pushed, CAST(sum(pl) AS BIGINT) AS pulled, CAST(greatest(1, max(greatest(pu, pl))) AS BIGINT) AS axis FROM h")
def chart_scale(spark, sf_dir):
    return transfer_history(spark, sf_dir).agg(F.sum("pushed_bytes").alias("pushed"), F.sum("pulled_bytes").alias("pulled"), F.greatest(F.lit(1), F.max(F.greatest("pushed_bytes", "pulled_bytes"))).alias("axis"))


@query(f"WITH {_EVENTS} SELECT folder, seq, phase FROM ev QUALIFY row_number() OVER (PARTITION BY folder ORDER BY ts DESC, seq DESC) <= 5")
def history_ring(spark, sf_dir):
    from ..operators.access import ring_tail

    return ring_tail(_events(spark, sf_dir), 5, [F.col("ts").desc(), F.col("seq").desc()], ("folder",)).select("folder", "seq", "phase")


@query(f"WITH {_EVENTS} SELECT seq, folder, phase FROM ev ORDER BY ts DESC, seq DESC LIMIT 4")
def latest_activities(spark, sf_dir):
    return _events(spark, sf_dir).orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(4).select("seq", "folder", "phase")


@query(f"WITH {_EVENTS} SELECT seq FROM ev WHERE phase = 'click' AND folder % 2 = 0 AND contains(lower(folder || ' ' || phase || ' ' || props), '\"k\": 1')")
def activity_search(spark, sf_dir):
    rows = _events(spark, sf_dir).where("phase = 'click' AND folder % 2 = 0")
    return dashboard.search(rows, '"k": 1', "folder", "phase", "props").select("seq")


@query(f"WITH {_EVENTS} SELECT seq, folder FROM ev ORDER BY ts DESC, seq DESC LIMIT 25 OFFSET 50")
def activity_page(spark, sf_dir):
    return dashboard.page(_events(spark, sf_dir), 3, 25, F.col("ts").desc(), F.col("seq").desc()).select("seq", "folder")


@query(f"WITH {_EVENTS} SELECT DISTINCT phase FROM ev")
def activity_kinds(spark, sf_dir):
    return _events(spark, sf_dir).select("phase").distinct()


@query(f"WITH {_EVENTS} SELECT folder, arg_max(phase, seq) AS phase, max(seq) AS seq FROM ev GROUP BY ALL")
def folder_phases(spark, sf_dir):
    return fold.latest_view(_events(spark, sf_dir), "folder", "seq", "phase").select("folder", "phase", "seq")


@query(f"WITH {_EVENTS}, v AS (SELECT folder, max(seq) AS seq FROM ev GROUP BY ALL), s AS (SELECT folder, max(seq) AS seq FROM ev WHERE seq % 10 <> 0 GROUP BY ALL) SELECT v.folder, v.seq FROM v LEFT JOIN s USING (folder) WHERE v.seq IS DISTINCT FROM s.seq")
def changed_revisions(spark, sf_dir):
    ev = _events(spark, sf_dir)
    view = ev.groupBy("folder").agg(F.max("seq").alias("seq"))
    return fold.changed_revisions(view, ev.where("seq % 10 <> 0").groupBy("folder").agg(F.max("seq").alias("seq")), "folder", "seq")


@query(f"WITH {_EVENTS}, g AS (SELECT *, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY folder ORDER BY ts) < 3600000 THEN 0 ELSE 1 END AS nw FROM ev), b AS (SELECT *, sum(nw) OVER (PARTITION BY folder ORDER BY ts RANGE UNBOUNDED PRECEDING) AS b FROM g) SELECT folder AS key, min((epoch_us(ts) // 1000)) AS started_ms, max((epoch_us(ts) // 1000)) AS ended_ms, count(*) AS events FROM b GROUP BY folder, b")
def debounce_sessions(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("at", F.unix_millis("ts"))
    return debounce.bursts(ev, "folder", "at", 3_600_000)


@query(f"WITH {_EVENTS} SELECT CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT) AS hour_ms, phase, count(*) AS n FROM ev GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    counted = fold.windowed_counts(_events(spark, sf_dir), "ts", "phase")
    return counted.select(F.unix_millis("window.start").alias("hour_ms"), "phase", "n")


@query(f"WITH {_EVENTS}, f AS (SELECT folder, seq, phase = 'error' AS bad, sum(CASE WHEN phase = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY folder ORDER BY seq) AS run FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY folder, run, bad ORDER BY seq) AS n FROM f WHERE bad) SELECT folder, seq, n AS failures, CAST(power(2, least(n, 6)) AS BIGINT) AS delay_s FROM r")
def worker_backoff(spark, sf_dir):
    from ..operators.scan import failure_runs

    runs = failure_runs(_events(spark, sf_dir), "folder", ["seq"], F.col("phase") == "error")
    return runs.select("folder", "seq", F.col("attempts").alias("failures"), D.worker_delay_s(F.col("attempts")).alias("delay_s"))


@query(f"WITH {_EVENTS} SELECT phase, seq, CAST((SELECT greatest(count(*) - 8, 0) FROM ev e WHERE e.phase = ev.phase) AS BIGINT) AS omitted FROM ev QUALIFY row_number() OVER (PARTITION BY phase ORDER BY seq) <= 8")
def diagnostics_bounded(spark, sf_dir):
    return dashboard.bounded_sections(_events(spark, sf_dir).select("phase", "seq"), "phase", "seq").select("phase", "seq", "omitted")


@query("SELECT o_orderpriority AS operation, round(median(o_totalprice) FILTER (o_orderkey % 2 = 0), 4) AS before_median, round(median(o_totalprice) FILTER (o_orderkey % 2 = 1), 4) AS after_median, round((median(o_totalprice) FILTER (o_orderkey % 2 = 1) / median(o_totalprice) FILTER (o_orderkey % 2 = 0) - 1) * 100, 3) AS percent FROM orders GROUP BY ALL")
def bench_median_compare(spark, sf_dir):
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("operation"), F.when(F.col("o_orderkey") % 2 == 0, "before").otherwise("after").alias("phase"), F.col("o_totalprice").alias("ms"))
    stats = dashboard.compare_medians(samples, ["operation"], "phase", "ms")
    return stats.select("operation", F.round("before_median", 4).alias("before_median"), F.round("after_median", 4).alias("after_median"), "percent")


@query(f"WITH {_EVENTS} SELECT folder, CAST(sum(bytes) FILTER (phase IN ('view', 'click')) AS BIGINT) AS queued_bytes FROM ev GROUP BY ALL")
def queued_bytes(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("folder").agg(F.sum(F.when(F.col("phase").isin("view", "click"), F.col("bytes"))).alias("queued_bytes"))


_N = "(SELECT p_partkey, CAST(p_partkey AS BIGINT) * p_partkey * p_partkey * (p_size % 7 + 1) AS n FROM part)"


@query(f"SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' bytes' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0::DOUBLE) || ' KiB (' || n || ' bytes)' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0::DOUBLE) || ' MiB (' || n || ' bytes)' ELSE printf('%.1f', n / 1073741824.0::DOUBLE) || ' GiB (' || n || ' bytes)' END AS shown FROM {_N}")
def format_bytes(spark, sf_dir):
    k = F.col("p_partkey").cast("decimal(20,0)")  # as bigint the product overflows from key 1,096,303 on
    sizes = table(spark, sf_dir, "part").select("p_partkey", (k * k * k * (F.col("p_size") % 7 + 1)).alias("n"))
    return sizes.select("p_partkey", D.format_bytes(F.col("n"), ("KiB", "MiB", "GiB")).alias("shown"))


@query("SELECT p_partkey, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' h ago' ELSE s // 86400 || ' d ago' END AS shown FROM (SELECT p_partkey, p_partkey * 311 AS s FROM part)")
def relative_time(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", D.ago(F.col("p_partkey") * 311).alias("shown"))


_RISKY = "p_name || chr(10) || p_type || chr(9) || '\\' || chr(8238) || CASE WHEN p_size % 2 = 0 THEN chr(27) || '[2J' ELSE chr(133) END"


@query(f"SELECT p_partkey, replace(replace(replace(replace(replace(t, chr(10), '\\n'), chr(9), '\\t'), chr(8238), '\\u{{202e}}'), chr(27), '\\u{{001b}}'), chr(133), '\\u{{0085}}') AS shown FROM (SELECT p_partkey, {_RISKY} AS t FROM part)")
def escaped_text(spark, sf_dir):
    text = F.concat("p_name", F.lit("\n"), "p_type", F.lit("\t\\\u202e"), F.when(F.col("p_size") % 2 == 0, "\x1b[2J").otherwise("\x85"))
    return table(spark, sf_dir, "part").select("p_partkey", D.escaped(text).alias("shown"))


@query("""SELECT p_partkey, CASE k WHEN 'endpoint_id' THEN 'Endpoint ID' WHEN 'relay_urls' THEN 'Relay URLs' WHEN 'local_before_root' THEN 'Local before root' WHEN 'size' THEN 'Size' ELSE k END AS label,
 CASE WHEN length(p_name || ' ' || p_type) > 20 THEN (p_name || ' ' || p_type)[1:20] || '... [' || (length(p_name || ' ' || p_type) - 20) || ' characters omitted]' ELSE p_name || ' ' || p_type END AS bounded
 FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN 'endpoint_id' WHEN 1 THEN 'relay_urls' WHEN 2 THEN 'local_before_root' WHEN 3 THEN 'size' ELSE 'a_' || p_name END AS k FROM part)""")
def labels(spark, sf_dir):
    m = F.col("p_size") % 5
    key = F.when(m == 0, "endpoint_id").when(m == 1, "relay_urls").when(m == 2, "local_before_root").when(m == 3, "size").otherwise(F.concat(F.lit("a_"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", D.label(key).alias("label"), D.bounded(F.concat_ws(" ", "p_name", "p_type"), 20).alias("bounded"))


@query("SELECT p_partkey, CASE WHEN s < 3600 THEN s // 60 || 'm' ELSE s // 3600 || 'h ' || (s % 3600) // 60 || 'm' END AS uptime, strftime(make_timestamp(1700000000000000 + s * 1000000), '%b %-d %H:%M') AS at FROM (SELECT p_partkey, p_partkey * 311 AS s FROM part)")
def uptimes(spark, sf_dir):
    s = F.col("p_partkey") * 311
    return table(spark, sf_dir, "part").select("p_partkey", D.uptime(s).alias("uptime"), D.day_time(F.timestamp_seconds(s + 1_700_000_000)).alias("at"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 9223372036854775807 ELSE 2 * p_partkey END AS total FROM part")
def saturating_sums(spark, sf_dir):
    k = F.col("p_partkey").cast("bigint")
    a = F.when(k % 3 == 0, F.lit((1 << 63) - 1)).otherwise(k)
    return table(spark, sf_dir, "part").select("p_partkey", D.saturating_add(a, k).alias("total"))


@query(
    """WITH t AS (SELECT p_partkey, ['watch', 'scan', 'sync', 'push', 'manifest', 'self-test'][p_partkey % 6 + 1] AS command, CASE WHEN p_partkey % 10 = 0 THEN 'stopped' WHEN p_partkey % 10 = 1 THEN 'failed' WHEN p_partkey % 10 = 2 THEN 'ready' END AS status, CASE WHEN p_partkey % 14 = 3 THEN 'sync_error' END AS event,
 p_size % 4 = 0 AS attention, p_size % 3 = 0 AS fallback, p_size % 5 = 0 AS conflicts FROM part)
SELECT p_partkey, CASE WHEN status = 'stopped' THEN 'Stopped' WHEN event = 'sync_error' THEN 'Retrying synchronization' WHEN status = 'failed' THEN CASE WHEN command = 'self-test' THEN 'Self-test failed' ELSE 'Operation failed' END WHEN status = 'ready' THEN 'Ready to receive'
 WHEN command = 'watch' THEN CASE WHEN fallback AND attention THEN 'Polling fallback · scan needs attention' WHEN fallback THEN 'Polling fallback · watching for changes' WHEN attention THEN 'Watching · scan needs attention' ELSE 'Watching for changes' END
 WHEN command = 'manifest' THEN 'Manifest ready' WHEN command = 'push' THEN 'Transfer verified' WHEN command = 'scan' THEN CASE WHEN attention THEN 'Scan complete · needs attention' ELSE 'Scan complete' END
 WHEN command = 'sync' THEN CASE WHEN conflicts THEN 'Folders reconciled · conflicts recorded' WHEN attention THEN 'Synchronization needs attention' ELSE 'Folders synchronized · roots verified' END ELSE 'Self-test passed' END AS title FROM t"""
)
def report_titles(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    command = F.element_at(F.array(*(F.lit(c) for c in ("watch", "scan", "sync", "push", "manifest", "self-test"))), (k % 6 + 1).cast("int"))
    status = F.when(k % 10 == 0, "stopped").when(k % 10 == 1, "failed").when(k % 10 == 2, "ready")
    title = D.report_title(command, status, F.when(k % 14 == 3, "sync_error"), s % 4 == 0, s % 3 == 0, s % 5 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))


_CAUSES = ("path", "manifest", "record", "encoding", "directory_not_empty", "permission_denied", "io", "none")
_TEXTS = ("incoming record is causally stale", "requested path is absent", "requested path changed after snapshot", "disk /private/x is gone")
_SAID = {
    "path": "Invalid destination path; choose a portable relative path and retry.", "manifest": "Invalid file manifest; regenerate it from the source and retry.", "record": "Invalid causal record; refresh the snapshot and reconcile before retrying.",
    "encoding": "Malformed protocol message; check peer compatibility before retrying.", "directory_not_empty": "Destination directory is not empty; synchronize or move its contents before retrying.",
    "permission_denied": "Receiver permission denied; check destination and state permissions before retrying.", "io": "Receiver storage or transport failed; check storage, permissions, and connectivity before retrying.",
}


def _pick(values, by):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (by + 1).cast("int"))


@query(f"""SELECT event_id, CASE {' '.join(f"WHEN cause = '{c}' THEN '{t}'" for c, t in _SAID.items())} WHEN said = 'incoming record is causally stale' THEN 'Incoming record is causally stale; refresh the snapshot and reconcile before retrying.'
  WHEN said LIKE 'requested path%' THEN 'Requested path changed or is absent; refresh the snapshot before retrying.' ELSE 'Operation rejected; check the destination and receiver storage, then refresh the snapshot and retry.' END AS told,
  CASE WHEN cls IN ('local_changed', 'busy', 'expired') THEN cls ELSE 'transfer_failed' END AS class
 FROM (SELECT event_id, {list(_CAUSES)}[event_id % 8 + 1] AS cause, {list(_TEXTS)}[event_id % 4 + 1] AS said, ['local_changed', 'busy', 'expired', 'segfault', NULL][event_id % 5 + 1] AS cls FROM events)""")
def error_classes(spark, sf_dir):
    """What a peer is told of each failure, and the class a managed sync gives it."""
    k = F.col("event_id")
    told = D.public_message(_pick(_CAUSES, k % 8), _pick(_TEXTS, k % 4))
    return table(spark, sf_dir, "events").select("event_id", told.alias("told"), D.failure_class(_pick(("local_changed", "busy", "expired", "segfault", None), k % 5)).alias("class"))


_REPORT = "{'status': p_name, 'size': p_size, 'report': {'a': 1}, 'profile': {'b': 2}, 'records': [1], 'issues': [p_size], 'readonly': p_size % 2 = 0, 'peer': p_type, 'attempts': p_partkey, 'error': NULL}"


@query(f"""SELECT p_partkey, field, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN field IN ('status', 'event') THEN 0 WHEN field IN ('size', 'attempts') THEN 1 WHEN field = 'readonly' THEN 2 WHEN field IN ('peer', 'error') THEN 3 WHEN field = 'report' THEN 4
  WHEN field = 'profile' THEN 5 WHEN field = 'records' THEN 7 ELSE 6 END, field) AS position FROM (SELECT p_partkey, unnest(json_keys(to_json({_REPORT}))) AS field FROM part)""")
def field_order(spark, sf_dir):
    """The fields of a JSON report in the order they are shown, by the kind of their values."""
    size = F.col("p_size")
    fields = {"status": F.col("p_name"), "size": size, "report": F.struct(F.lit(1).alias("a")), "profile": F.struct(F.lit(2).alias("b")), "records": F.array(F.lit(1)), "issues": F.array(size), "readonly": size % 2 == 0, "peer": F.col("p_type"), "attempts": F.col("p_partkey"), "error": F.lit(None).cast("string")}
    report = F.to_json(F.struct(*(v.alias(n) for n, v in fields.items())), {"ignoreNullFields": "false"})
    return dashboard.ordered_fields(table(spark, sf_dir, "part").select("p_partkey", report.alias("report")), "report", ["p_partkey"])


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL")
def record_caps(spark, sf_dir):
    """No supplier may have more than 100,000 lines; one that had would be an error, not a shorter answer."""
    return dashboard.capped(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), "n", 100_000, "too many lines")


@query("SELECT folder, path, total FROM (SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY path) AS n, count(*) OVER (PARTITION BY folder) AS total FROM (SELECT DISTINCT folder, path FROM index_records WHERE folder IS NOT NULL AND path IS NOT NULL)) WHERE n <= 200")
def bounded_listing(spark, sf_dir):
    """The first 200 paths of every folder with how many there are."""
    rows = table(spark, sf_dir, "index_records").where("folder IS NOT NULL AND path IS NOT NULL").select("folder", "path").distinct()
    return dashboard.first_of(rows, ["folder"], ["path"], 200).select("folder", "path", "total")


_ROOTS = "roots AS (SELECT DISTINCT folder AS id, path FROM index_records WHERE kind = 'directory' AND folder IS NOT NULL AND path IS NOT NULL AND NOT coalesce(tombstone, false))"


@query(f"WITH {_ROOTS} SELECT a.id, a.path AS outer_path, b.path AS inner_path FROM roots a JOIN roots b ON a.id = b.id AND starts_with(b.path, a.path || '/')")
def root_overlaps(spark, sf_dir):
    """Directories of a folder of which one lies in the other: an equal join on exploded ancestors, no comparison of all pairs."""
    roots = table(spark, sf_dir, "index_records").where("kind = 'directory' AND folder IS NOT NULL AND path IS NOT NULL AND NOT coalesce(tombstone, false)").select(F.col("folder").alias("id"), "path").distinct()
    inner = roots.select("id", F.col("path").alias("inner_path"), F.explode(P.ancestors(F.col("path"), proper=True)).alias("outer_path"))
    return inner.join(roots.select("id", F.col("path").alias("outer_path")), ["id", "outer_path"]).select("id", "outer_path", "inner_path")


@query("SELECT CAST(sum(merkle_queries) AS BIGINT) AS merkle_queries, CAST(sum(local_actions) AS BIGINT) AS local_actions, CAST(sum(remote_actions) AS BIGINT) AS remote_actions, CAST(sum(pulled_bytes) AS BIGINT) AS pulled, CAST(sum(pushed_bytes) AS BIGINT) AS pushed, count(*) AS passes FROM (SELECT DISTINCT * FROM sync_reports)")
def sync_totals(spark, sf_dir):
    s = lambda c, n: F.sum(c).alias(n)
    return table(spark, sf_dir, "sync_reports").distinct().agg(s("merkle_queries", "merkle_queries"), s("local_actions", "local_actions"), s("remote_actions", "remote_actions"), s("pulled_bytes", "pulled"), s("pushed_bytes", "pushed"), F.count("*").alias("passes"))


@query("SELECT CAST(n_regionkey AS INTEGER) AS n_regionkey, count(*) AS nations, '{\"region\":' || n_regionkey || ',\"nations\":' || count(*) || '}' AS report FROM nation GROUP BY n_regionkey")
def json_reports(spark, sf_dir):
    counted = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    return counted.withColumn("report", F.to_json(F.struct(F.col("n_regionkey").alias("region"), "nations")))
