"""Numbering rows in order, however few groups there are.

A window numbers a group in one task. Here the rows are range-sorted over all tasks and stored; a row's place in its file
gives its number within the file, and the counts of each (file, group), as many as files and groups together, give the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise

_PLACES = (1 << 33) - 1


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """The rows with a column of numbers from 1 within each group, by the given order; ties are numbered in any order."""
    by = [*group, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    stored = materialise(ranged, "ranked").withColumn("_file", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit(_PLACES)))
    counts = stored.groupBy(*group, "_file").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).drop("_n", "_first")
    same = F.col("s._file") == F.col("o._file")
    for g in group:
        same = same & F.col(f"s.{g}").eqNullSafe(F.col(f"o.{g}"))
    return stored.alias("s").join(offsets.alias("o"), same).select(*(F.col(f"s.{c}").alias(c) for c in df.columns), (F.col("s._place") + F.col("o._offset")).alias(name))


#: Numbered rows that one task goes through for a running value.
BLOCK = 100_000


def running_max(df: DataFrame, group: Sequence[str], number: str, value: str, name: str) -> DataFrame:
    """The greatest value up to each row of a group, in the order of its numbers from 1: within blocks of rows, and over the blocks before."""
    block = F.floor((F.col(number) - 1) / BLOCK)
    rows = df.withColumn("_block", block)
    inside = Window.partitionBy(*group, "_block").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*group, "_block").agg(F.max(value).alias("_m")).withColumn("_before", F.max("_m").over(earlier)).drop("_m")
    same = F.col("r._block") == F.col("b._block")
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"b.{g}"))
    return rows.withColumn("_here", F.max(value).over(inside)).alias("r").join(before.alias("b"), same).select(*(F.col(f"r.{c}").alias(c) for c in df.columns), F.greatest("r._here", "b._before").alias(name))
