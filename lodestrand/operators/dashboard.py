"""Totals, searches, pages and histories for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.display import field_rank, json_kind


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows in which the columns, side by side, contain the text, whatever its case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page, clamped to those there are: a page beyond the last is the last. Only the rows up to the page are kept, as top-k of each task."""
    at = max(number, 1)
    placed = df.orderBy(*order).limit(at * size).withColumn("_id", F.monotonically_increasing_id())
    ranked = placed.withColumn("_n", F.row_number().over(Window.orderBy("_id")))  # at most number * size rows
    met = ranked.withColumn("_all", F.count("*").over(Window.orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = F.greatest(F.least(F.lit(at), F.ceil(F.col("_all") / size)) - 1, F.lit(0)) * size
    return met.where(F.col("_n") > first).drop("_id", "_n", "_all")


def first_of(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """The first rows of each group with the group's ``total``. The rank filter is pushed below the shuffle, so a large group stays small."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    shown = df.withColumn("_n", at).where(F.col("_n") <= size).drop("_n")
    return shown.join(df.groupBy(*group).agg(F.count("*").alias("total")), group)


def capped(df: DataFrame, count: str, most: int, what: str) -> DataFrame:
    """The rows as they are; one with more than so many is an error."""
    return df.withColumn(count, F.when(F.col(count) <= most, F.col(count)).otherwise(F.raise_error(F.lit(what)).cast("bigint")))


def ordered_fields(df: DataFrame, report: str, keys: list[str]) -> DataFrame:
    """(*keys, field, position from 1): the fields of a JSON report in the order they are shown."""
    parsed = df.select(*keys, F.try_parse_json(report).alias("_v"))
    fields = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(*keys, F.col("key").alias("field"), field_rank(F.col("key"), json_kind(F.col("value"))).alias("_r"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_r", "field"))  # one report's fields
    return fields.select(*keys, "field", place.cast("bigint").alias("position"))


#: Ids of a block, about. Two blocks give the square of it in rows, which Spark holds at once while it takes them apart.
LINKED = 128


def _blocks(members: DataFrame, of: str, name: str) -> DataFrame:
    """(of, _<name>s: array): the names of each value in blocks of about LINKED, by their hashes, so that a task that runs again makes the same ones."""
    counts = members.groupBy(of).agg(F.count("*").alias("_n"))
    block = F.pmod(F.xxhash64(name), F.ceil(F.col("_n") / LINKED))
    nulls = F.array_repeat(F.lit(None).cast(members.schema[name].dataType), F.count_if(F.col(name).isNull()).cast("int"))  # collect_list leaves them out
    return members.join(counts, of).groupBy(of, block.alias(f"_{name}_block")).agg(F.concat(F.collect_list(name), nulls).alias(f"_{name}s"))


def linked_folders(devices: DataFrame, folders: DataFrame) -> DataFrame:
    """(device, folder), once each, by id, by endpoint or by being allowed; ids that stand more than once, or are null, count as one.

    Devices of an endpoint pair with all folders that name it, so the result grows with the square. Pairs are therefore neither shuffled nor compared:
    an endpoint's devices and folders meet as blocks of ids, which are spread over the tasks and taken apart last. A pair could stand twice only where
    the device has several endpoints (those pairs are made distinct) or is named by its id as well (left out there).
    """
    named = F.array_compact(F.concat(F.array("peer_endpoint"), F.coalesce("allowed_peers", F.array().cast("array<string>"))))
    f = folders.groupBy(F.col("id").alias("folder")).agg(F.array_distinct(F.flatten(F.collect_list(named))).alias("_named"), F.collect_set("device_id").alias("_ids"))
    d = devices.groupBy(F.col("id").alias("device")).agg(F.collect_set("endpoint").alias("_has"))
    by_id = f.select("folder", "_named", F.explode("_ids").alias("_id")).join(d, F.col("_id") == F.col("device")).where(~F.arrays_overlap("_named", "_has"))
    naming = f.select("folder", F.explode("_named").alias("endpoint"))
    several = d.where(F.size("_has") > 1).select("device", F.explode("_has").alias("endpoint")).join(naming, "endpoint")
    one = d.where(F.size("_has") == 1).select("device", F.col("_has")[0].alias("endpoint"))
    met = _blocks(one, "endpoint", "device").join(_blocks(naming, "endpoint", "folder"), "endpoint").repartition("endpoint", "_device_block", "_folder_block")
    by_endpoint = met.select("_devices", F.explode("_folders").alias("folder")).select(F.explode("_devices").alias("device"), "folder")
    pair = lambda x: x.select("device", "folder")
    return by_endpoint.unionByName(pair(by_id)).unionByName(pair(several).distinct())


def bounded_sections(rows: DataFrame, group: str, text: str, size: int = 8) -> DataFrame:
    """The first entries of every section and how many more there are; a section is kept as its smallest entries while it is aggregated."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(text))
    shown = rows.withColumn("_n", first).where(F.col("_n") <= size).drop("_n")
    counted = rows.groupBy(group).agg(F.greatest(F.count("*") - size, F.lit(0)).alias("omitted"))
    return shown.join(counted, group)


def compare_medians(samples: DataFrame, group: list[str], phase: str, value: str) -> DataFrame:
    """Median, least and greatest before and after, and the change in percent."""
    is_ = lambda p: F.when(F.col(phase) == p, F.col(value))
    stats = samples.groupBy(*group).agg(*(a.alias(f"{p}_{n}") for p in ("before", "after") for n, a in (("median", F.median(is_(p))), ("min", F.min(is_(p))), ("max", F.max(is_(p))))))
    return stats.withColumn("percent", F.round((F.col("after_median") / F.nullif("before_median", F.lit(0.0)) - 1) * 100, 3))


def doctor(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, check_name, status, action, healthy): the named checks of a device, what to do where one fails, and whether all pass.

    facts: (*keys, root_writable, state_writable, root, state, identity, identity_ok, peer_ok, direct_only, addresses); peer_ok null: no peer given.
    """
    apart = ~P.overlap(F.col("root"), F.col("state")) & ~P.under(F.col("identity"), F.col("root")) & ~P.under(F.col("identity"), F.col("state"))
    checks = {
        "root_writable": (F.col("root_writable"), "Grant write access or select a writable root."), "state_writable": (F.col("state_writable"), "Grant write access or select a writable state folder."),
        "path_separation": (apart, "Place state and identity outside the root, with the identity outside the state."), "identity": (F.col("identity_ok"), "Create an identity, then retry."),
        "peer": (F.coalesce("peer_ok", F.lit(True)), "Copy the peer's endpoint exactly."), "direct_addresses": (~F.col("direct_only") | (F.col("addresses") > 0), "Add at least one address, or allow others than direct ones."),
    }
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), F.when(c, "pass").otherwise("fail").alias("status"), F.when(~c, action).alias("action")) for n, (c, action) in checks.items()))
    healthy = F.lit(True)
    for c, _ in checks.values():
        healthy = healthy & c
    return facts.select(*keys, F.explode(rows).alias("c"), healthy.alias("healthy")).select(*keys, "c.*", "healthy")


def keyed_union_conflicts(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, n, conflicting) of keys that stand more than once: a union by key holds them only where all rows carry the same values."""
    value = F.struct(*fields)
    return rows.groupBy(key).agg(F.count("*").alias("n"), (~F.min(value).eqNullSafe(F.max(value))).alias("conflicting")).where("n > 1")
