"""Column expressions for reports: bytes, times, delays, budgets, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import whole_division

_UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
_LONG_MAX = (1 << 63) - 1


def _one_decimal(x: Column) -> Column:
    """A double from 1 below 2^63 with one decimal, as Rust, C and DuckDB print it: by its exact value, ties to even. Java's ``%.1f`` rounds its shortest digits, ties up."""
    whole = F.floor(x)
    part = ((x - whole) * float(1 << 52)).cast("bigint") * 10  # exact: a double from 1 on has at most 52 binary places
    tenth, rest, half = F.shiftright(part, 52), part.bitwiseAND(F.lit((1 << 52) - 1)), 1 << 51
    tenth = tenth + F.when((rest > half) | ((rest == half) & (tenth % 2 == 1)), 1).otherwise(0)
    return F.concat((whole + F.when(tenth == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenth % 10).cast("string"))


def format_bytes(n: Column, units: tuple[str, ...] = _UNITS) -> Column:
    """Bytes, and from 1024 on the greatest of the units that isn't above them; n: whole numbers, decimals too, since a size may be beyond a bigint."""
    size = n.cast("double")
    scale, unit = F.lit(1024.0), F.lit(units[0])
    for k, name in enumerate(units[1:], 2):
        scale, unit = (F.when(size >= float(1024**k), value).otherwise(below) for value, below in ((float(1024**k), scale), (name, unit)))
    text = F.concat(_one_decimal(size / scale), F.lit(" "), unit, F.lit(" ("), n.cast("string"), F.lit(" bytes)"))
    return F.when(size < 1024, F.concat(n.cast("string"), F.lit(" bytes"))).otherwise(text)


def ago(seconds: Column) -> Column:
    """just now, N min ago, N h ago, N d ago."""
    s = F.greatest(seconds, F.lit(0))
    whole = lambda d: F.floor(s / d).cast("string")
    return (
        F.when(s < 60, "just now").when(s < 3600, F.concat(whole(60), F.lit(" min ago"))).when(s < 86400, F.concat(whole(3600), F.lit(" h ago"))).otherwise(F.concat(whole(86400), F.lit(" d ago")))
    )


def uptime(seconds: Column) -> Column:
    """Minutes below an hour, else hours and minutes."""
    whole = lambda c: F.floor(c).cast("string")
    return F.when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m"))).otherwise(F.concat(whole(seconds / 3600), F.lit("h "), whole(F.pmod(seconds, F.lit(3600)) / 60), F.lit("m")))


def day_time(at: Column, none: str = "no record yet") -> Column:
    """Month, day, hour and minute."""
    return F.coalesce(F.date_format(at, "MMM d HH:mm"), F.lit(none))


#: Characters that a terminal would obey, direction marks and overrides among them.
CONTROLS = (*range(0x00, 0x20), *range(0x7F, 0xA0), 0x061C, 0x200E, 0x200F, *range(0x2028, 0x202F), *range(0x2066, 0x206A))
_NAMED = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escaped(text: Column) -> Column:
    """Control and direction characters as their escapes: the usual three by name, the others by code point."""
    shown = F.create_map(*(F.lit(v) for c in CONTROLS for v in (chr(c), _NAMED.get(chr(c), f"\\u{{{c:04x}}}"))))
    risky = "[" + "".join(f"\\x{{{c:x}}}" for c in CONTROLS) + "]"
    by_character = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(shown, c), c)), "")
    return F.when(text.rlike(risky), by_character).otherwise(text)


# The fields of reports, whose names are put in words; other keys are someone's data.
FIELDS = (
    "architecture attempts avg_size barrier bundle changes chunks collision_key collisions conflict_path conflicts content_hash created desired_root "
    "destination direct_addresses error event faults file file_hash files_hashed final_merkle_root final_size first_transfer_bytes from generation hash "
    "identity identity_file index_initial_records index_rename_detected index_restart_verified index_tombstones issues killed_process kind last_error "
    "length live_records local_actions local_before_root local_change_detection loser_hash manifest_hash max_size merkle_queries message min_size "
    "modified_ns native_events not_before_ms offset operating_system operations path paths peer peer_logs pid profile pulled_bytes pulled_remote_files "
    "pushed_bytes readonly reason records remote_actions remote_before_root remote_poll_seconds report rescan_required restart_local_actions "
    "restart_remote_actions retries retries_queued retry_in_seconds reused_extents root roots schema_version second_transfer_bytes seed sequence size "
    "staged_local_files states status sync_bidirectional_verified sync_conflicts_preserved sync_delete_verified sync_restart_actions sync_verified_root "
    "temporary_data to tombstone tombstones transferred_bytes unchanged verified_local_root verified_remote_root version watcher_degraded watcher_error "
    "winner_hash "
).split()


def label(key: Column) -> Column:
    """A report field's name as words, the first capitalised; any other key as it is, escaped."""
    words = F.replace(key, F.lit("_"), F.lit(" "))
    named = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))
    return F.when(key == "endpoint_id", "Endpoint ID").when(key == "relay_urls", "Relay URLs").when(key.isin(*FIELDS), named).otherwise(escaped(key))


def field_rank(key: Column, kind: Column) -> Column:
    """Where a field stands in a report; equal ranks go by name. kind: number, boolean, text (or null), object or list."""
    return (
        F.when(key.isin("status", "event"), 0).when(kind == "number", 1).when(kind == "boolean", 2).when(~kind.isin("object", "list"), 3)
        .when(key == "report", 4).when(kind == "object", 5).when(key.isin("records", "chunks", "operations"), 7).otherwise(6)
    )


def json_kind(value: Column) -> Column:
    """The kind of a variant: number, boolean, text (null among them), object or list."""
    schema = F.schema_of_variant(value)
    return (
        F.when(F.startswith(schema, F.lit("OBJECT")), "object").when(F.startswith(schema, F.lit("ARRAY")), "list").when(schema == "BOOLEAN", "boolean")
        .when(schema.isin("STRING", "VOID") | value.isNull(), "text").otherwise("number")
    )


def message(text: Column) -> Column:
    """The first 1,024 characters."""
    return F.left(text, F.lit(1024))


def bounded(text: Column, limit: int = 256) -> Column:
    """At most so many characters, and how many were left out."""
    over = F.char_length(text) - limit
    return F.when(over > 0, F.concat(F.left(text, F.lit(limit)), F.lit("... ["), over.cast("string"), F.lit(" characters omitted]"))).otherwise(text)


# What a peer is told of a failure, by its cause, and by its message where the cause has none of its own.
CAUSES = {
    "path": "Invalid destination path; choose a portable relative path and retry.",
    "manifest": "Invalid file manifest; regenerate it from the source and retry.",
    "record": "Invalid causal record; refresh the snapshot and reconcile before retrying.",
    "encoding": "Malformed protocol message; check peer compatibility before retrying.",
    "directory_not_empty": "Destination directory is not empty; synchronize or move its contents before retrying.",
    "permission_denied": "Receiver permission denied; check destination and state permissions before retrying.",
    "io": "Receiver storage or transport failed; check storage, permissions, and connectivity before retrying.",
}
MESSAGES = {
    "incoming record advances the local replica counter": "Incoming record advances the local replica counter; refresh the snapshot and reconcile before retrying.",
    "incoming record is causally stale": "Incoming record is causally stale; refresh the snapshot and reconcile before retrying.",
    "incoming record is concurrent; reconcile it before applying": "Incoming record is concurrent; refresh the snapshot and reconcile before retrying.",
    "incoming record reuses an existing causal version for different state": "Incoming record reuses a causal version for different state; reconcile before retrying.",
    "requested path is absent": "Requested path changed or is absent; refresh the snapshot before retrying.",
    "requested path changed after snapshot": "Requested path changed or is absent; refresh the snapshot before retrying.",
}
OTHER_FAILURE = "Operation rejected; check the destination and receiver storage, then refresh the snapshot and retry."
#: Classes a managed sync reports as they are; all else is a failed transfer.
PRESERVATION = ("recovery_unavailable", "local_changed", "state_unavailable")
SHARE = (
    "unsupported_version", "invalid_ticket", "expired", "invitation_revoked", "member_revoked", "permission_denied", "unknown_share", "not_member", "replica_claim_rejected", "invalid_record", "busy", "offline",
    "share_state_unavailable", "protocol", "owner_mismatch",
)


def public_message(cause: Column, text: Column) -> Column:
    """What may be told of a failure: by the first known cause in its chain, else by its message; never the message itself."""
    table = lambda d: F.create_map(*(F.lit(v) for kv in d.items() for v in kv))
    return F.coalesce(F.try_element_at(table(CAUSES), cause), F.try_element_at(table(MESSAGES), text), F.lit(OTHER_FAILURE))


def failure_class(error: Column) -> Column:
    """The class of a managed sync's failure."""
    return F.when(error.isin(*PRESERVATION, *SHARE), error).otherwise("transfer_failed")


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(_LONG_MAX)))


def retry_delay_ms(attempts: Column) -> Column:
    """Doubling from 500 ms, at most 300 s."""
    return F.least(F.lit(500) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(31))), F.lit(300_000)).cast("bigint")


def worker_delay_s(failures: Column) -> Column:
    return F.pow(F.lit(2.0), F.least(failures, F.lit(6))).cast("bigint")


def queue_delay_ms(queued_bytes: Column, goodput: Column) -> Column:
    """Saturating, as are the costs made of it."""
    return whole_division(F.coalesce(F.try_multiply(queued_bytes, F.lit(1000).cast("bigint")), F.when(queued_bytes.isNotNull(), F.lit(_LONG_MAX))), F.greatest(goodput, F.lit(1)))


def source_cost_ms(rtt: Column, queued_bytes: Column, goodput: Column, penalty: Column) -> Column:
    return saturating_add(saturating_add(rtt.cast("bigint"), queue_delay_ms(queued_bytes.cast("bigint"), goodput)), (penalty * 500).cast("bigint"))


def cli_delays_s(failures: Column, most: Column) -> Column:
    """Doubling from 1 s with each failure in a row, at most so many."""
    return F.least(F.pow(F.lit(2.0), F.least(failures - 1, F.lit(62))), most).cast("bigint")


def page_timeout_s(hashes: Column) -> Column:
    """10 s and 10 s for each page of 4,096 hashes, at most 620."""
    return F.least(F.lit(620), F.ceil(hashes / 4096) * 10 + 10).cast("bigint")


def budget_issue(shared: Column, state_free: Column, target_free: Column, state_write: Column, target_write: Column, reserve: Column) -> Column:
    """null, shared, state or destination: where free space is short."""
    return (
        F.when(shared & (F.least(state_free, target_free) < state_write + target_write + reserve), "shared")
        .when(~shared & (state_free < state_write + reserve), "state")
        .when(~shared & (target_free < target_write + reserve), "destination")
    )


def name_issue(text: Column) -> Column:
    """null, empty, too_long or control: names have 1 to 100 characters."""
    t = F.trim(text)
    return F.when(t.isNull() | (t == ""), "empty").when(F.char_length(t) > 100, "too_long").when(t.rlike(r"[\x00-\x1f\x7f-\x9f]"), "control")


# Titles of reports.
def report_title(command: Column, status: Column, event: Column, attention: Column, fallback: Column, conflicts: Column) -> Column:
    failed = F.when(command == "self-test", "Self-test failed").when(command == "fault-test", "Fault test failed").otherwise("Operation failed")
    watching = (
        F.when(fallback & attention, "Polling fallback · scan needs attention").when(fallback, "Polling fallback · watching for changes")
        .when(attention, "Watching · scan needs attention").otherwise("Watching for changes")
    )
    sync = command.isin("sync", "sync-once")
    return (
        F.when((status == "stopped") | (event == "shutdown"), "Stopped")
        .when((status == "retrying") | (event == "sync_error"), "Retrying synchronization")
        .when(status.isin("fail", "failed", "forced_failure"), failed)
        .when(status == "ready", "Ready to receive")
        .when((status == "synchronizing") | (event == "local_change"), "Synchronizing local changes")
        .when((command == "watch") | (event == "sync_started"), watching)
        .when(command == "manifest", "Manifest ready")
        .when(command == "push", "Transfer verified")
        .when((command == "scan") & attention, "Scan complete · needs attention")
        .when(command == "scan", "Scan complete")
        .when(sync & conflicts, "Folders reconciled · conflicts recorded")
        .when(sync & attention, "Synchronization needs attention")
        .when(sync, "Folders synchronized · roots verified")
        .when(command == "self-test", "Self-test passed")
        .when(command == "fault-test", "Fault test passed")
        .otherwise("Result")
    )


def needs_attention(report: Column) -> Column:
    """Whether a scan's JSON report names issues, colliding paths or queued retries."""
    r = F.from_json(report, "issues array<string>, collisions array<string>, retries_queued bigint")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return some(r["issues"]) | some(r["collisions"]) | (F.coalesce(r["retries_queued"], F.lit(0)) > 0)
