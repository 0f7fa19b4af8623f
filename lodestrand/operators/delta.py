"""Manifests, chunk deltas, content-addressed storage: over extents (path, idx, chunk_offset, length, hash)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contiguity(extents: DataFrame) -> DataFrame:
    """expected offset of every extent: the lengths before it in its file, a file's extents being one manifest."""
    before = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return extents.withColumn("expected", F.coalesce(F.sum("length").over(before), F.lit(0)))


def manifest_issues(extents: DataFrame, high: int) -> DataFrame:
    """(path, issue): gap (offset isn't the sum before), empty_chunk, chunk_too_long, length_differs (one hash, two lengths), index_gap."""
    at = contiguity(extents)
    per_file = at.groupBy("path").agg(
        F.max(F.col("chunk_offset") != F.col("expected")).alias("gap"), F.max(F.col("length") <= 0).alias("empty_chunk"), F.max(F.col("length") > high).alias("chunk_too_long"),
        (F.max("idx") + 1 != F.count("*")).alias("index_gap"),
    )
    twice = extents.groupBy("path", "hash").agg((F.min("length") != F.max("length")).alias("d")).groupBy("path").agg(F.max("d").alias("length_differs"))
    flags = ("gap", "empty_chunk", "chunk_too_long", "index_gap", "length_differs")
    named = F.filter(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)), lambda x: x.isNotNull())
    return per_file.join(twice, "path").select("path", F.explode(named).alias("issue"))


#: Fixed value: the digest of nothing.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def declared_issues(declared: DataFrame, extents: DataFrame, high: int) -> DataFrame:
    """(path, issue), the first rule a manifest breaks, by what it declares and by its extents; none if it is valid.

    declared: (path, version, size, file_hash). In order: version, chunks_for_empty_file, empty_hash, missing_chunks, those of ``manifest_issues``
    (the first by name), size (the extents' lengths don't add up to the declared one).
    """
    total = extents.groupBy("path").agg(F.sum("length").alias("_sum"))
    inner = manifest_issues(extents, high).groupBy("path").agg(F.min("issue").alias("_inner"))
    met = declared.join(total, "path", "left").join(inner, "path", "left")
    none = F.col("_sum").isNull()
    issue = (
        F.when(F.col("version") != 1, "version").when((F.col("size") == 0) & ~none, "chunks_for_empty_file").when((F.col("size") == 0) & (F.col("file_hash") != EMPTY), "empty_hash")
        .when((F.col("size") != 0) & none, "missing_chunks").when(F.col("_inner").isNotNull(), F.col("_inner")).when(F.coalesce("_sum", F.lit(0)) != F.col("size"), "size")
    )
    return met.withColumn("issue", issue).where(F.col("issue").isNotNull()).select("path", "issue")


def chunk_contents(files: DataFrame, extents: DataFrame) -> DataFrame:
    """(path, idx, hash, content, ok) of each extent, read from its file's content by place; ok tells whether it is what its hash says."""
    met = extents.join(files.select("path", F.col("content").alias("_whole")), "path")
    part = F.substring("_whole", (F.col("chunk_offset") + 1).cast("int"), F.col("length").cast("int"))
    read = met.withColumn("content", part)
    return read.select("path", "idx", "hash", "content", ((F.octet_length("content") == F.col("length")) & (F.sha2("content", 256) == F.col("hash"))).alias("ok"))


def files_match(files: DataFrame, extents: DataFrame) -> DataFrame:
    """(path, matches): whether a file has the manifest's size and each of its chunks."""
    read = chunk_contents(files, extents).groupBy("path").agg(F.bool_and("ok").alias("_ok"))
    size = extents.groupBy("path").agg(F.sum("length").alias("_size"))
    met = files.select("path", F.octet_length("content").cast("bigint").alias("_n")).join(size, "path", "left").join(read, "path", "left")
    return met.select("path", ((F.col("_n") == F.coalesce("_size", F.lit(0))) & F.coalesce("_ok", F.lit(True))).alias("matches"))


def first_uses(extents: DataFrame) -> DataFrame:
    """Each file's distinct hashes with the place of first use."""
    return extents.groupBy("path", "hash").agg(F.min("idx").alias("first_idx"), F.max("length").alias("length"), F.count("*").alias("uses"))


def missing(extents: DataFrame, available: DataFrame) -> DataFrame:
    """Distinct hashes of each file that aren't available, with first use. A hash that many files use is looked up once."""
    known = extents.select("hash").distinct().join(available.select("hash"), "hash", "left_semi")
    return first_uses(extents).join(known, "hash", "left_anti")


def delta_plan(extents: DataFrame, available: DataFrame) -> DataFrame:
    """Per file: distinct missing hashes, their bytes, and the extents that are reused; a repeated missing extent is neither."""
    known = extents.select("hash").distinct().join(available.select("hash"), "hash", "left_semi").withColumn("known", F.lit(True))
    uses = first_uses(extents).join(known, "hash", "left")
    here = F.col("known").isNotNull()
    return uses.groupBy("path").agg(
        F.count_if(~here).alias("missing"), F.coalesce(F.sum(F.when(~here, F.col("length"))), F.lit(0)).alias("transfer_bytes"), F.coalesce(F.sum(F.when(here, F.col("uses"))), F.lit(0)).alias("reused_extents")
    )


def put_chunks(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each distinct incoming hash: new or already there."""
    distinct = incoming.groupBy("hash").agg(F.max("length").alias("length"))
    return distinct.join(store.select("hash", F.lit(True).alias("_s")), "hash", "left").select("hash", "length", F.col("_s").isNull().alias("is_new"))


def shard(hash_: Column) -> Column:
    """The folder of a chunk: the first two digits; partition the store by it."""
    return F.substring(hash_, 1, 2)


def outcome_issues(requested: DataFrame, present: DataFrame, absent: DataFrame, group: Sequence[str]) -> DataFrame:
    """present and missing must partition the requested hashes: duplicate, unasked, unanswered."""
    on = [*group, "hash"]
    answers = present.select(*on).unionByName(absent.select(*on))
    counted = answers.groupBy(*on).agg(F.count("*").alias("n"))
    asked = requested.select(*on).distinct()
    return (
        counted.where("n > 1").select(*on, F.lit("duplicate").alias("issue"))
        .unionByName(counted.join(asked, on, "left_anti").select(*on, F.lit("unasked").alias("issue")))
        .unionByName(asked.join(counted, on, "left_anti").select(*on, F.lit("unanswered").alias("issue")))
    )


#: Extents whose texts are digested together; a manifest's identity is the digest of these digests, so no list grows with the file.
BLOCK = 4096


def manifest_hash(extents: DataFrame) -> DataFrame:
    """(path, manifest_hash, size, chunks): identity of each file's manifest, its size, and its chunks in order."""

    def joined(at: str, text: Column, by: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(at, text.alias("t"))))
        return F.array_join(F.transform(listed, lambda c: c["t"]), by)

    chunk = F.concat_ws(":", F.col("chunk_offset").cast("string"), F.col("length").cast("string"), "hash")
    blocks = extents.groupBy("path", F.floor(F.col("idx") / BLOCK).alias("block")).agg(F.sha2(joined("idx", chunk, ";"), 256).alias("_d"), F.sum("length").alias("_s"), F.count("*").alias("_n"))
    whole = blocks.groupBy("path").agg(joined("block", F.col("_d"), ";").alias("_t"), F.sum("_s").alias("size"), F.sum("_n").alias("chunks"))
    return whole.select("path", F.sha2(F.concat_ws("|", F.lit("manifest"), F.col("size").cast("string"), F.col("chunks").cast("string"), "_t"), 256).alias("manifest_hash"), "size", "chunks")


def reassembled(extents: DataFrame, store: DataFrame) -> DataFrame:
    """Each file from its chunks: (path, content, complete). store: (hash, content binary); a chunk that isn't there leaves the file incomplete."""
    joined = extents.join(store.select("hash", "content"), "hash", "left")
    # each content is copied once, as hex text; adding to a growing content would copy it once for every chunk
    parts = F.array_sort(F.collect_list(F.struct("idx", F.hex("content").alias("t"))))
    whole = F.unhex(F.array_join(F.transform(parts, lambda c: F.coalesce(c["t"], F.lit(""))), ""))
    return joined.groupBy("path").agg(whole.alias("content"), (F.count("content") == F.count("*")).alias("complete"))
