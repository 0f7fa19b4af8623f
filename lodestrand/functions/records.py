"""Column expressions on records, version vectors and digests.

A vector is an array<struct<replica, counter>>; an absent replica and a counter of 0 are the same. Comparisons of
records take null as equal to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tidy

STATE = ("kind", "size", "content_hash", "readonly", "tombstone")
RESOLVER = "resolver"

KINDS = ("file", "directory", "symlink", "other")


def vector(version: Column) -> Column:
    """Replica to counter, positive counters only; of several entries of a replica the greatest counts."""
    entries = F.array_sort(F.filter(F.transform(version, lambda e: F.struct(tidy(e["replica"]).alias("replica"), e["counter"].alias("counter"))), lambda e: (e["counter"] > 0) & e["replica"].isNotNull()))
    replicas = F.array_distinct(F.transform(entries, lambda e: e["replica"]))
    greatest = F.transform(replicas, lambda r: F.array_max(F.transform(F.filter(entries, lambda e: e["replica"] == r), lambda e: e["counter"])))
    return F.coalesce(F.map_from_arrays(replicas, greatest), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))


def counter(v: Column, replica: Column | str) -> Column:
    return F.coalesce(F.try_element_at(v, F.lit(replica) if isinstance(replica, str) else replica), F.lit(0))


def merged(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def observed(v: Column, replica: Column | str, n: Column) -> Column:
    """The vector with the replica's counter raised to n."""
    one = F.create_map(F.lit(replica) if isinstance(replica, str) else replica, n.cast("bigint"))
    return merged(v, one)


def incremented(v: Column, replica: str) -> Column:
    """Raises on overflow."""
    return observed(v, replica, counter(v, replica) + F.lit(1).cast("bigint"))


def relation(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    ahead, behind = F.exists(pairs, lambda d: d > 0), F.exists(pairs, lambda d: d < 0)
    return F.when(ahead & behind, "concurrent").when(ahead, "after").when(behind, "before").otherwise("equal")


def vector_text(v: Column) -> Column:
    """One string for equal vectors."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(v)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def vector_of(text: Column) -> Column:
    """The vector of such a string."""
    entries = F.filter(F.split(text, ","), lambda e: e != "")
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(F.split_part(e, F.lit("="), F.lit(1)).alias("key"), F.split_part(e, F.lit("="), F.lit(2)).cast("bigint").alias("value"))))


def same(a: str, b: str, fields=STATE) -> Column:
    """Null-safe equality of fields of two structs or aliases."""
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def both_known_and_equal(a: Column, b: Column) -> Column:
    """For change times: unknown equals nothing."""
    return F.coalesce(a == b, F.lit(False))


def trusts(o: str, f: str, r: str) -> Column:
    """Whether a file needn't be read again: what was observed when it was put there (o) is what its metadata (f) and the record (r) say.

    Struct columns; times of change must be known and equal, all else may be null on both sides.
    """
    c = lambda s, n: F.col(f"{s}.{n}")
    out = both_known_and_equal(c(o, "changed_ns"), c(f, "changed_ns")) & c(o, "content_hash").eqNullSafe(c(r, "content_hash"))
    for n in ("size", "readonly"):
        out = out & c(o, n).eqNullSafe(c(f, n)) & c(o, n).eqNullSafe(c(r, n))
    for n in ("modified_ns", "id_namespace", "id_object"):
        out = out & c(o, n).eqNullSafe(c(f, n))
    return out


def digest(*parts: Column | str) -> Column:
    """SHA-256 over parts joined by '|'; null is '-'."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts)), 256)


def _bit(c: Column) -> Column:
    return F.when(c, "1").otherwise("0")


def state_hash(r: str = "") -> Column:
    """Identity of a record's state, without path and history."""
    c = lambda f: F.col(f"{r}.{f}" if r else f)
    return digest("state", c("kind"), c("size"), c("content_hash"), _bit(c("readonly")), _bit(c("tombstone")))


def logical_hash(r: str = "", vtext: str = "vtext") -> Column:
    """Identity of a record with path and history."""
    c = lambda f: F.col(f"{r}.{f}" if r else f)
    return digest("record", c("path"), c("kind"), c("size"), c("content_hash"), _bit(c("readonly")), _bit(c("tombstone")), c(vtext))


def record_issue(kind: Column, size: Column, content_hash: Column, tombstone: Column) -> Column:
    """null, file_without_hash or payload_on_non_file; a tombstone is exempt."""
    live = ~F.coalesce(tombstone, F.lit(False))
    return F.when(live & (kind == "file") & content_hash.isNull(), "file_without_hash").when(live & (kind != "file") & ((size != 0) | content_hash.isNotNull()), "payload_on_non_file")


def profile_issue(version: Column, low: Column, mean: Column, high: Column) -> Column:
    """The first rule a chunking profile breaks."""
    return (
        F.when(version != 1, "version")
        .when(~low.between(64, 1_048_576), "minimum")
        .when(~mean.between(256, 4_194_304), "average")
        .when(~high.between(1_024, 16_777_216), "maximum")
        .when(~((low < mean) & (mean < high)), "order")
        .when((low % 2 != 0) | (mean % 2 != 0) | (high % 2 != 0), "odd")
    )


#: (minimum, average, maximum) of chunks, and those for files from 8 GiB on.
PROFILE, LARGE_PROFILE, LARGE_FILE = (16 << 10, 64 << 10, 256 << 10), (1 << 20, 4 << 20, 16 << 20), 8 << 30


def profile_for(size: Column) -> Column:
    make = lambda p: F.struct(*(F.lit(v).cast("bigint").alias(n) for v, n in zip(p, ("min_size", "avg_size", "max_size"), strict=True)))
    return F.when(size >= LARGE_FILE, make(LARGE_PROFILE)).otherwise(make(PROFILE))
