"""Files and directories as records, reports and logs as JSON, measurements as CSV."""

from __future__ import annotations

import hashlib
import json
import os
import stat
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions import paths as P
from ..functions.pyfuncs import profile_of, stream_chunks
from ..runtime import cut

LISTING = "path string, kind string, size long, modified_ns decimal(38,0), readonly boolean, issue string"


def _under(path: str, prefixes: Sequence[str]) -> bool:
    return any(path == p or path.startswith(p + "/") for p in prefixes)


def _described(root: str, path: str) -> tuple:
    """One entry's row; nothing is read but its metadata, and a link is not followed."""
    from decimal import Decimal

    at = os.path.join(root, path)
    try:
        path.encode()
        st = os.lstat(at)
    except UnicodeEncodeError:
        return (path.encode(errors="surrogateescape").decode(errors="replace"), "other", 0, None, False, "name")
    except OSError:
        return (path, "other", 0, None, False, "unreadable")
    if stat.S_ISREG(st.st_mode):
        return (path, "file", st.st_size, Decimal(st.st_mtime_ns), not st.st_mode & 0o200, None)
    if stat.S_ISDIR(st.st_mode):
        return (path, "directory", 0, None, False, None if os.access(at, os.R_OK | os.X_OK) else "unreadable")
    return (path, "symlink" if stat.S_ISLNK(st.st_mode) else "other", 0, None, False, None)


def _walk(root: str, path: str, ignored: Sequence[str]) -> Iterator[tuple]:
    """A row for the entry and, depth first and in order, for all below it."""
    waiting = [path]
    while waiting:
        here = waiting.pop()
        row = _described(root, here)
        if row[1] == "directory" and row[5] is None:
            try:
                names = sorted(os.listdir(os.path.join(root, here)), reverse=True)
            except OSError:
                names, row = [], (*row[:5], "unreadable")
            waiting.extend(c for n in names if not _under(c := f"{here}/{n}", ignored))
        yield row


class DirectorySource(DataSource):
    """Entries below a directory on a file system that all executors mount, as rows: options path, ignored (a JSON list of prefixes).

    Links are rows and are never followed. A directory that can't be read is a row with the issue 'unreadable', so that what was below it
    isn't taken for deleted; a name that is no UTF-8 has the issue 'name'. One task lists one entry of the first level; ``list_directory`` spreads
    deeper trees. As a stream it gives the files that were modified since the last look, as hints for a scan.
    """

    @classmethod
    def name(cls) -> str:
        return "directory"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(self.options["path"], json.loads(self.options.get("ignored", "[]")))

    def simpleStreamReader(self, schema) -> DirectoryChanges:
        return DirectoryChanges(self.options["path"], json.loads(self.options.get("ignored", "[]")))


class DirectoryReader(DataSourceReader):
    def __init__(self, root: str, ignored: list[str]):
        self.root, self.ignored = root.removeprefix("file://"), ignored

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.listdir(self.root))
        return [InputPartition(n) for n in names if not _under(n, self.ignored)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from _walk(self.root, partition.value, self.ignored)


class DirectoryChanges(SimpleDataSourceStreamReader):
    """The offset is the latest modification seen, in nanoseconds, with the paths that have it: a file is given once for each of its times."""

    def __init__(self, root: str, ignored: list[str]):
        self.root, self.ignored = root.removeprefix("file://"), ignored

    def initialOffset(self) -> dict:
        return {"ns": -1, "paths": []}

    def _newer(self, since: int, seen: Sequence[str], until: int | None = None) -> list[tuple]:
        rows = []
        for name in sorted(os.listdir(self.root)):
            if not _under(name, self.ignored):
                rows += [r for r in _walk(self.root, name, self.ignored) if r[3] is not None]
        known = set(seen)
        return [r for r in rows if (r[3] > since or (r[3] == since and r[0] not in known)) and (until is None or r[3] <= until)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._newer(start["ns"], start["paths"])
        last = max((int(r[3]) for r in rows), default=start["ns"])
        at = [r[0] for r in rows if r[3] == last] + (start["paths"] if last == start["ns"] else [])
        return iter(rows), {"ns": last, "paths": sorted(at)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._newer(start["ns"], start["paths"], end["ns"]))


def list_directory(spark: SparkSession, root: str, ignored: Sequence[str] = (), levels: int = 1) -> DataFrame:
    """The entries of ``DirectorySource``; contents aren't read.

    levels: how many levels are listed one after the other, each in parallel over the directories of the one before, until whole subtrees are
    walked by a task each. With one, a task walks an entry of the first level; a deep tree under one folder needs more.
    """
    if levels <= 1:
        spark.dataSource.register(DirectorySource)
        return spark.read.format("directory").option("path", root).option("ignored", json.dumps(list(ignored))).load()
    base, skip = root.removeprefix("file://"), list(ignored)

    def one_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(r for p in batch.column(0).to_pylist() for n in _names(base, p) if not _under(c := f"{p}/{n}" if p else n, skip) for r in (_described(base, c),))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(r for p in batch.column(0).to_pylist() for n in _names(base, p) if not _under(c := f"{p}/{n}", skip) for r in _walk(base, c, skip))

    at = spark.createDataFrame([("",)], "path string")
    found = None
    for _ in range(levels):
        level = cut(at.mapInArrow(one_level, LISTING))
        found = level if found is None else found.unionByName(level)
        folders = level.where("kind = 'directory' AND issue IS NULL").select("path")
        at = folders.repartition(F.col("path"))
    return found.unionByName(at.mapInArrow(subtrees, LISTING))


def _names(base: str, path: str) -> list[str]:
    try:
        return sorted(os.listdir(os.path.join(base, path) if path else base))
    except OSError:
        return []  # the directory's own row tells that it is unreadable


def _rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    types = (pa.string(), pa.string(), pa.int64(), pa.decimal128(38, 0), pa.bool_(), pa.string())
    names = ("path", "kind", "size", "modified_ns", "readonly", "issue")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


#: Fixed value: a directory with more folders isn't listed.
MAX_LISTED = 10_000


def browse(spark: SparkSession, root: str, path: str = "", denied: Sequence[str] = ()) -> DataFrame:
    """(name, path) of the folders in a folder, by name, without those that lie in, or hold, a denied one; in a denied one, or with more than 10,000, an error."""
    if _under(path, denied):
        raise PermissionError(f"{path} can't be listed")
    base = root.removeprefix("file://")
    entries = []
    with os.scandir(os.path.join(base, path)) as found:
        for e in found:
            at = f"{path}/{e.name}" if path else e.name
            if e.is_dir(follow_symlinks=False) and not _under(at, denied) and not any(_under(d, [at]) for d in denied):
                entries.append((e.name, at))
                if len(entries) > MAX_LISTED:
                    raise ValueError("too many folders")
    return spark.createDataFrame(sorted(entries), "name string, path string")


def compare_trees(left: DataFrame, right: DataFrame, columns: Sequence[str] = ("path", "kind", "content_hash")) -> DataFrame:
    """(side, *columns): rows that only one of two independently read trees has; empty if they are the same."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right"))).select("side", *columns)


def chunk_files(files: DataFrame, root: str, profile: tuple[int, int, int] | None = None) -> DataFrame:
    """(path, idx, chunk_offset, length, hash) of the files' chunks, read from disk in order; two of the largest chunks are held at most. profile: see ``content_chunks``."""
    base = root.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                at = os.path.join(base, p)
                with open(at, "rb") as f:
                    found = list(enumerate(stream_chunks(f.read, profile or profile_of(os.path.getsize(at)))))
                rows = [(p, i, o, n, h) for i, (o, n, h) in found]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "idx", "chunk_offset", "length", "hash"])

    return files.select("path").repartition("path").mapInArrow(run, "path string, idx int, chunk_offset long, length long, hash string")


def hash_files(files: DataFrame, root: str) -> DataFrame:
    """(path, content_hash, issue): digests read in pieces; a file whose size or time moved meanwhile has the issue 'changed', one that is gone or closed 'unreadable'."""
    base = root.removeprefix("file://")

    def digest(path: str) -> tuple[str | None, str | None]:
        at = os.path.join(base, path)
        try:
            before = os.stat(at)
            with open(at, "rb") as f:
                value = hashlib.file_digest(f, "sha256").hexdigest()
            after = os.stat(at)
        except OSError:
            return None, "unreadable"
        return (value, None) if (before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns) else (None, "changed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in found], pa.string()), pa.array([i for _, i in found], pa.string())], names=["path", "content_hash", "issue"])

    return files.select("path").repartition("path").mapInArrow(run, "path string, content_hash string, issue string")


def scan_directory(spark: SparkSession, root: str, ignored: Sequence[str] = (), known: DataFrame | None = None) -> DataFrame:
    """(path, kind, size, modified_ns, readonly, content_hash, issue) of all entries below the root.

    known: records of an earlier scan. A file whose size and time are as there keeps its stored hash, and only the others'
    contents are read. issue also names the rule a path breaks.
    """
    listed = list_directory(spark, root, ignored)
    files = listed.where("kind = 'file'")
    columns = ["path", "size", "modified_ns"]
    if known is None:
        reused = files.limit(0).select("path", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("issue"))
    else:
        stored = known.where("content_hash IS NOT NULL").select(*columns, "content_hash")
        reused = files.join(stored, columns).select("path", "content_hash", F.lit(None).cast("string").alias("issue"))
    fresh = hash_files(files.join(reused.select("path"), "path", "left_anti"), root)
    hashed = reused.unionByName(fresh).withColumnRenamed("issue", "_hash_issue")
    rows = listed.join(hashed, "path", "left")
    return rows.select("path", "kind", "size", "modified_ns", "readonly", "content_hash", F.coalesce("issue", "_hash_issue", P.path_issue(F.col("path"))).alias("issue"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strictly by schema: a row that doesn't fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Measurements with comment lines."""
    return spark.read.schema(schema).option("header", "true").option("comment", "#").option("mode", "FAILFAST").csv(path)
