"""Has this key been seen before? An exact ledger of keys, hash-bucketed on disk.

The history lies in the shared folder in hash buckets: a base with one sorted file for each bucket, and a
delta with the batches since. A batch of new keys is shuffled once to the ledger's bucketing and joined by
sort-merge, bucket by bucket; the ledger is read without a shuffle, and its base without a sort. When the
delta has grown to a share of the base both are merged into a new base, with more buckets if there are many
keys. Memory holds a sort buffer, never the keys.

A batch is first reduced to its distinct keys with the smallest order of each (rank 1 by arrival); that
combines on the map side, so a key with a third of all rows costs one row per task. Keys that the ledger
lacks are appended to it. A row has been seen unless it is the first row of such a new key, so the rows
are told apart by an anti-join on (order, key), which spreads evenly however hot a key is.

A ledger is opened again by its path: the number of its buckets is kept with it, and batches are counted on
from the last one. A batch's number names it: given again, as after a failure, it gets the same answers again
and stores nothing.

Defined results
* null or malformed key (not 64 hex digits after trimming): no key; never seen, never stored.
* null order: no arrival; such a row is asked against the ledger only and stores nothing.
* rows of one key and one order: all of them are first, none has a smaller one.
* a batch processed twice without its number: the second time everything is seen. Empty ledger or batch: nothing seen.
* opened with another number of buckets than it has: an error.
The answers are exact, so the rate of wrong answers is zero; ``p2_report`` measures it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digest_bytes
from ..runtime import Folder, scratch_path

#: Keys of one bucket when the base is written anew.
ROWS_PER_BUCKET = 2_000_000
#: After how many batches it is asked whether to merge, and the delta's share of the base from which on it is done.
MERGE_EVERY, MERGE_SHARE = 8, 0.25

_COLUMNS = "key BINARY, first_order BIGINT, batch INT"


class KeyLedger:
    """Rows (key binary, first_order long, batch int) in generations g0, g1, ...; the last that was finished counts."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or scratch_path(spark, "ledger")).rstrip("/")
        self.folder = Folder(spark, self.path)
        finished = [int(n[1:].removesuffix(".json")) for n in self.folder.names() if n.startswith("g") and n.endswith(".json")]
        self.generation = max(finished, default=0)
        if finished:
            self.buckets = json.loads(self.folder.read(f"g{self.generation}.json"))["buckets"]
            if buckets not in (None, self.buckets):
                raise ValueError(f"the ledger at {self.path} has {self.buckets} buckets, not {buckets}; open it without a number")
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._finish(0)
        # a base file holds one sorted bucket, so the scan gives its order
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.batches = (self.rows().agg(F.max("batch")).first()[0] or 0) if finished else 0
        self._since = 0

    def _finish(self, generation: int) -> None:
        self.folder.write(f"g{generation}.json", json.dumps({"buckets": self.buckets}))
        self.generation = generation

    def _has(self, part: str) -> bool:
        return "_SUCCESS" in Folder(self.spark, f"{self.path}/g{self.generation}/{part}").names()

    def _table(self, generation: int, part: str) -> str:
        """A catalogue entry for a part's files, as bucketed reads and writes need one; the caller drops it."""
        name = f"ledger_{uuid.uuid4().hex}"
        at = f"{self.path}/g{generation}/{part}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({_COLUMNS}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        return name

    def _part(self, part: str) -> DataFrame:
        name = self._table(self.generation, part)
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _parts(self) -> list[DataFrame]:
        return [self._part(p) for p in ("base", "delta") if self._has(p)]

    def rows(self) -> DataFrame:
        parts = self._parts() or [self.spark.createDataFrame([], _COLUMNS)]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _append(self, rows: DataFrame, part: str, generation: int) -> None:
        # one sorted file per bucket: the rows come hash-partitioned by key into as many parts as there are buckets
        name = self._table(generation, part)
        try:
            rows.select("key", "first_order", "batch").repartition(self.buckets, "key").sortWithinPartitions("key").write.insertInto(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _new(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct keys that the ledger lacks."""
        for part in self._parts():
            known = part.select("key", F.lit(True).alias("_known"))
            keys = keys.join(known.hint("merge"), "key", "left").where(F.col("_known").isNull()).drop("_known")
        return keys

    def load(self, keys: DataFrame) -> None:
        """Earlier keys, as batch 0."""
        fresh = self._new(keys.where(F.col("key").isNotNull()).select("key").distinct())
        rows = fresh.select("key", F.lit(None).cast("long").alias("first_order"), F.lit(0).alias("batch"))
        self._append(rows, "delta" if self._parts() else "base", self.generation)

    def absorb(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """Append the batch's new keys; (key, first_order) of just these, read back from the ledger. batch: (key, order).

        number: the batch's own, from 1; by default the next. What a number has stored before isn't stored again.
        """
        at = self.batches + 1 if number is None else number
        if at > self.batches:
            firsts = batch.where(F.col("key").isNotNull() & F.col("order").isNotNull()).groupBy("key").agg(F.min("order").alias("first_order"))
            self._append(self._new(firsts).withColumn("batch", F.lit(at)), "delta", self.generation)
            self.batches = at
            self._since += 1
        fresh = self.rows().where(F.col("batch") == at).select("key", "first_order")
        if self._since >= MERGE_EVERY:
            self._since = 0
            if self._part("delta").count() >= MERGE_SHARE * (self._part("base").count() if self._has("base") else 0):
                self.compact()
        return fresh

    def compact(self) -> None:
        """Merge base and delta into the next generation's base. Earlier generations stay for those who still read them."""
        rows = self.rows()
        held = self.buckets
        wanted = -(-rows.count() // ROWS_PER_BUCKET)
        while self.buckets < wanted:
            self.buckets *= 2
        try:
            self._append(rows, "base", self.generation + 1)
        except BaseException:
            self.buckets = held
            Folder(self.spark, f"{self.path}/g{self.generation + 1}").remove()
            raise
        self._finish(self.generation + 1)

    def vacuum(self) -> None:
        """Remove earlier generations, and what an unfinished one left behind. Nobody may be reading them."""
        for n in self.folder.names():
            if n.startswith("g") and n.removesuffix(".json") != f"g{self.generation}":
                self.folder.remove(n)

    def seen(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """Rows of the batch whose key is in the ledger or in a row of smaller order; the ledger grows by the batch."""
        fresh = self.absorb(batch, number).select(F.col("key").alias("_key"), F.col("first_order").alias("_first"))
        keyed = batch.where(F.col("key").isNotNull() & F.col("order").isNotNull())
        return keyed.join(fresh, (F.col("order") == F.col("_first")) & (F.col("key") == F.col("_key")), "left_anti")

    def holds(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows whose key is in the ledger (in batches up to ``before``); nothing is stored."""
        distinct = rows.where(F.col("key").isNotNull()).select("key").distinct()
        found = None
        for part in self._parts():  # a key lies in one of them
            at = part if before is None else part.where(F.col("batch") <= before)
            known = distinct.join(at.select("key").hint("merge"), "key", "left_semi")
            found = known if found is None else found.unionByName(known)
        known = distinct.limit(0) if found is None else found
        return rows.join(known, "key", "left_semi")  # a hot key's partition is split by adaptive execution: the left side streams


def digest_key(c: Column) -> Column:
    return digest_bytes(c)
