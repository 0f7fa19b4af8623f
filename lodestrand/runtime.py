"""Session-level helpers: the shared folder, materialised stages, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where that is unset, and only on a local master, a temporary folder is set; on a
    cluster an unset folder is an error, since a machine-local path would lose data with a machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if configured:
        if current.isEmpty():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; ``scratch`` removes what was made within it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving the stages that were stored within. Results are lazy: consume them before."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            Folder(spark, path).remove()
        del _made[before:]


class Folder:
    """A folder on whichever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Sorted; empty if there is no such folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at())) if self._fs.exists(self._at()) else []

    def write(self, name: str, text: str) -> None:
        """A small file that appears whole or not at all."""
        part = self._at(f".{name}.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(part, self._at(name)):
            raise OSError(f"{self.path}/{name} is there already")

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: lineage is cut, loss of an executor is survived."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the files alone give fewer tasks than there are cores; else as they are, without a shuffle.

    Only for plans without an exchange: to ask others for their partitions would run them, and they are spread already.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
