"""Keyed tables, versioned snapshots and the chunk store, on Parquet.

Spark has no transactions over files: a snapshot is written beside the others under a new number and becomes
current when its number's marker appears, so a reader sees the old one or the new one, never a part.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.pyfuncs import content_chunks
from ..operators.delta import chunk_contents, shard
from ..operators.scan import state_delta
from ..runtime import Folder, cut


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class SnapshotTable:
    """Whole snapshots by number; the greatest number whose write has ended is current."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def versions(self) -> list[int]:
        fs, at = _fs(self.spark, self.path)
        if not fs.exists(at):
            return []
        found = []
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")):
                found.append(int(name[1:]))
        return sorted(found)

    def read(self, version: int | None = None) -> DataFrame | None:
        there = self.versions()
        at = there[-1] if version is None and there else version
        return self.spark.read.parquet(f"{self.path}/v{at}") if at in there else None

    def commit(self, rows: DataFrame) -> int:
        """Refuses two rows of one key; sorts by key within files, so that ranges of keys prune."""
        if not rows.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError("two rows of one key")
        number = (self.versions() or [0])[-1] + 1
        rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{self.path}/v{number}")
        return number

    def replace(self, rows: DataFrame, seen: DataFrame) -> int:
        """Commit an authoritative snapshot, if its live keys are just those that were seen; else an error and nothing is written."""
        live, there = rows.where("NOT tombstone").select(*self.keys), seen.select(*self.keys).distinct()
        if not live.join(there, self.keys, "left_anti").limit(1).unionByName(there.join(live, self.keys, "left_anti").limit(1)).isEmpty():
            raise ValueError("what is there isn't the snapshot")
        return self.commit(rows)


def checked_records(rows: DataFrame, schema_version: Column, collision_key: Column) -> DataFrame:
    """Index rows as they were stored; reading one of another schema, of a path that breaks the rules or with a stale collision key is an error."""
    issue = F.when(schema_version != 1, "unsupported schema").when(P.path_issue(F.col("path")).isNotNull(), "invalid path").when(~collision_key.eqNullSafe(F.col("collision_key")), "stale collision key")
    return rows.withColumn("path", F.when(issue.isNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("index record: "), issue)).cast("string")))


class IndexStore:
    """Records, retries and counters that are committed together: a commit writes the rows that changed, and its marker makes all of it current.

    records: a base and the deltas since, the last of a key counting; after ``merge_every`` commits they become a new base. retries are small and
    written whole. The marker is one small file with the commit's parts and counters, so a reader sees a commit or doesn't.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, retries_schema: str, merge_every: int = 16):
        self.spark, self.keys, self.schema, self.retries_schema, self.merge_every = spark, list(keys), schema, retries_schema, merge_every
        self.folder = Folder(spark, path)

    def _current(self) -> dict:
        marks = [int(n[1:].removesuffix(".json")) for n in self.folder.names() if n.startswith("c") and n.endswith(".json")]
        return json.loads(self.folder.read(f"c{max(marks)}.json")) if marks else {"number": 0, "parts": [], "retries": None, "counters": {}}

    def counters(self) -> dict[str, int]:
        return self._current()["counters"]

    def records(self) -> DataFrame:
        return self._records(self._current())

    def _records(self, current: dict) -> DataFrame:
        rows = None
        for n in current["parts"]:
            part = self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/records-{n}").withColumn("_n", F.lit(n))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        if len(current["parts"]) == 1:
            return rows.drop("_n")
        columns = [c for c in rows.columns if c not in (*self.keys, "_n")]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "_n").alias("_r")).select(*self.keys, "_r.*")

    def retries(self) -> DataFrame:
        at = self._current()["retries"]
        return self.spark.createDataFrame([], self.retries_schema) if at is None else self.spark.read.schema(self.retries_schema).parquet(f"{self.folder.path}/retries-{at}")

    def commit(self, rows: DataFrame, retries: DataFrame, counters: dict[str, int]) -> int:
        """The next state of the index; only records that are new or differ from the stored ones are written. Gives the commit's number."""
        now = self._current()
        number = now["number"] + 1
        fields = [c for c in rows.columns if c not in self.keys]
        merge = len(now["parts"]) >= self.merge_every
        changed = rows if merge or not now["parts"] else state_delta(self._records(now), rows, self.keys, fields)
        changed.select(*self.keys, *fields).write.mode("overwrite").parquet(f"{self.folder.path}/records-{number}")
        retries.write.mode("overwrite").parquet(f"{self.folder.path}/retries-{number}")
        parts = [number] if merge else [*now["parts"], number]
        self.folder.write(f"c{number}.json", json.dumps({"number": number, "parts": parts, "retries": number, "counters": counters}))
        return number


class Catalogue:
    """One small document that many read and few change: a change is made to what is there now, and lost if somebody was faster."""

    def __init__(self, spark: SparkSession, path: str, most_bytes: int = 4 << 20):
        self.folder, self.most = Folder(spark, path), most_bytes

    def _last(self) -> int:
        return max((int(n[1:].removesuffix(".json")) for n in self.folder.names() if n.startswith("v") and n.endswith(".json")), default=0)

    def read(self) -> dict:
        last = self._last()
        return json.loads(self.folder.read(f"v{last}.json")) if last else {}

    def update(self, change: Callable[[dict], dict]) -> dict:
        last = self._last()
        new = change(json.loads(self.folder.read(f"v{last}.json")) if last else {})
        text = json.dumps(new)
        if len(text.encode()) > self.most:
            raise ValueError("the catalogue is too large")
        self.folder.write(f"v{last + 1}.json", text)  # an error if that number was taken meanwhile
        return new


class KeyedTable:
    """Append-only puts; a get sees the last put of a key."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def put(self, rows: DataFrame, sequence: int) -> None:
        rows.withColumn("_sequence", F.lit(sequence).cast("bigint")).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        rows = self.spark.read.schema(self.schema + ", _sequence bigint").parquet(self.path)
        columns = [c for c in rows.columns if c not in (self.key, "_sequence")]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "_sequence").alias("_r")).select(self.key, "_r.*")

    def get(self, key) -> DataFrame:
        rows = self.spark.read.schema(self.schema + ", _sequence bigint").parquet(self.path).where(F.col(self.key) == F.lit(key))
        last = F.row_number().over(Window.partitionBy(self.key).orderBy(F.col("_sequence").desc()))
        return rows.withColumn("_n", last).where("_n = 1").drop("_n", "_sequence")


class ChunkStore:
    """Chunks by digest, in folders by the first two digits; what is there isn't written again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        fs, at = _fs(self.spark, self.path)
        empty = self.spark.createDataFrame([], "hash string, content binary, shard string")
        return self.spark.read.schema("hash string, content binary, shard string").parquet(self.path) if fs.exists(at) else empty

    def put(self, chunks: DataFrame) -> int:
        """How many were new. chunks: (hash, content); a content that isn't its hash's is an error."""
        checked = chunks.withColumn("hash", F.when(F.sha2("content", 256) == F.lower("hash"), F.lower("hash")).otherwise(F.raise_error(F.lit("a chunk isn't what its hash says"))))
        distinct = checked.groupBy("hash").agg(F.first("content").alias("content"))
        new = distinct.join(self.rows().select("hash"), "hash", "left_anti").withColumn("shard", shard(F.col("hash"))).persist()
        try:
            count = new.count()
            if count:
                new.write.mode("append").partitionBy("shard").parquet(self.path)
        finally:
            new.unpersist()
        return count

    def ingest(self, files: DataFrame, admitted_bytes: int, profile: tuple[int, int, int] | None = None) -> DataFrame:
        """Cut files (path, content) by content, store what is new, and give their extents; if the new chunks have more than the admitted bytes, nothing is stored."""
        extents = cut(content_chunks(files, profile=profile))
        lost = extents.select("hash", "length").distinct().join(self.rows().select("hash"), "hash", "left_anti")
        needed = lost.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        if needed > admitted_bytes:
            raise ValueError(f"{needed} bytes are new, {admitted_bytes} are admitted")
        self.put(chunk_contents(files, extents).join(lost.select("hash"), "hash", "left_semi").select("hash", "content"))
        return extents

    def get(self, hashes: DataFrame, most: int) -> DataFrame:
        """Verified chunks of at most so many bytes; the shards asked for prune the folders."""
        asked = hashes.select(F.lower("hash").alias("hash")).distinct().withColumn("shard", shard(F.col("hash")))
        return self.rows().join(asked, ["shard", "hash"]).where((F.octet_length("content") <= most) & (F.sha2("content", 256) == F.col("hash"))).select("hash", "content")


def cached_manifests(wanted: DataFrame, cache: DataFrame, fingerprint: Sequence[str]) -> DataFrame:
    """Wanted files with the cached manifest if the whole fingerprint is the cached one, null-safe; else null, to be computed."""
    c = cache.alias("c")
    same = F.col("w.path") == F.col("c.path")
    for f in fingerprint:
        same = same & F.col(f"w.{f}").eqNullSafe(F.col(f"c.{f}"))
    return wanted.alias("w").join(c, same, "left").select("w.*", F.col("c.manifest_hash").alias("manifest_hash"))
