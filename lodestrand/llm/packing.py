"""Filling fixed-capacity containers with items: bulk-synchronous best fit.

Documents are range-sorted by size, largest first, and so are the gaps of the open containers. In every round the
waiting documents of a band of sizes look for their successor, the smallest gap that holds them, all at once:
documents and gaps lie on the executors in blocks of neighbouring sizes, and a sweep over each block, from large to small,
gives every document the latest gap it has passed that is still free. Where documents meet at one gap, rank decides: the larger one,
and of equal ones the first, has it, the others fall back to the next greater gap. What a block can't match
goes on to a sweep over the blocks' borders. Then the gaps are updated, and the next round begins; when a band's
documents find no gap any more, containers are opened for all that wait in it, and below the last band the work is done.

Documents of one size are alike, and so are containers of one gap, so a round moves runs: (size, ranks from i on) into
(gap, containers from k on). A container takes as many of one size as its gap holds, which is what best fit does with them
one by one. The runs, whose number depends on the capacity and not on the corpus, are what goes to the executors and comes
back in each round; the driver keeps them in between and decides on bands and openings. Rows are touched twice: when
they are sized and sorted into the shared folder, and when each looks up its container by its rank in that order; nothing of
them is shuffled between rounds, and no size is hot, since the sort splits rows of one size by their key.

Defined results
* An item longer than the capacity is cut into pieces of the capacity and a rest; no other item is split.
* Size 0 (null and empty texts): placed evenly over the containers there are; if none, in one container.
* Repeated rows are items of their own. Empty table: no rows. Containers are numbered from 0 without gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, scratch_path

CAPACITY = 2048
#: A band's least size as a share of its greatest; sizes up to the last share of the capacity are one band.
BAND, LAST_BAND = 0.75, 1 / 8
#: Blocks of neighbouring sizes that are swept on their own.
BLOCKS = 4

_LOCAL = (1 << 33) - 1

#: (value, is a gap, first rank or container, how many)
Run = tuple[int, bool, int, int]
#: (size, gap, first rank, first container, containers, of this size in each)
Match = tuple[int, int, int, int, int, int]


@dataclass
class Plan:
    """Runs: the items with ranks from ``rank[i]`` on go to containers from ``first[i]`` on, ``each[i]`` to one."""

    rank: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    containers: int = 0
    rounds: int = 0
    sized: int = 0  # items of a size above 0; the others follow in rank


def sweep(runs: list[Run]) -> tuple[list[Match], list[Run]]:
    """Matches of documents with their successors among the gaps, and the runs that are left, from large to small."""
    free: list[list[int]] = []  # gaps passed and not taken, the smallest last
    found: list[Match] = []
    left: list[Run] = []
    for value, is_gap, first, n in sorted(runs, key=lambda r: (-r[0], not r[1], r[2])):
        if is_gap:
            free.append([value, first, n])
            continue
        while n and free:
            gap = free[-1]
            each = gap[0] // value
            take = [(min(n // each, gap[2]), each)]
            rest = n - take[0][0] * each
            if rest < each and gap[2] > take[0][0]:
                take.append((1, rest))
            for m, k in take:
                if m and k:
                    found.append((value, gap[0], first, gap[1], m, k))
                    first, n, gap[1], gap[2] = first + m * k, n - m * k, gap[1] + m, gap[2] - m
            if not gap[2]:
                free.pop()
        if n:
            left.append((value, False, first, n))
    return found, left + [(g, True, c, m) for g, c, m in free]


def cluster_sweep(spark: SparkSession, capacity: int) -> Callable[[list[Run]], tuple[list[Match], list[Run]]]:
    """A sweep over runs on the executors: a task for each block of sizes, then one for what is left at the borders of the blocks.

    The runs are a few thousand at most and imperative work, so they go as plain tasks: a planned query would take several times as long.
    """
    context, width = spark.sparkContext, -(-(capacity + 1) // BLOCKS)

    def run(runs: list[Run]) -> tuple[list[Match], list[Run]]:
        blocks: dict[int, list[Run]] = {}
        for r in runs:
            blocks.setdefault(r[0] // width, []).append(r)
        swept = context.parallelize(list(blocks.values()), len(blocks)).map(sweep).collect()
        found, left = [m for f, _ in swept for m in f], [r for _, rest in swept for r in rest]
        if max((r[0] for r in left if r[1]), default=0) >= min((r[0] for r in left if not r[1]), default=capacity + 1):
            [(more, left)] = context.parallelize([left], 1).map(sweep).collect()
            found += more
        return found, left

    return run


def best_fit(counts: dict[int, int], capacity: int = CAPACITY, swept: Callable[[list[Run]], tuple[list[Match], list[Run]]] = sweep) -> Plan:
    """The rounds, over the number of items of each size."""
    plan, matches = Plan(), []
    waiting: dict[int, tuple[int, int]] = {}  # size: (first rank, how many)
    rank = 0
    for size in sorted((s for s in counts if s > 0), reverse=True):
        waiting[size] = (rank, counts[size])
        rank += counts[size]
    plan.sized = rank
    gaps: list[Run] = []
    while waiting:
        most = max(waiting)
        least = int(most * BAND) + 1 if most > capacity * LAST_BAND else 1
        while band := [(s, False, *waiting[s]) for s in waiting if s >= least]:
            usable = [g for g in gaps if g[0] >= least]
            if max((g[0] for g in usable), default=0) >= min(r[0] for r in band):
                plan.rounds += 1
                found, left = swept(band + usable)
                gaps = [g for g in gaps if g[0] < least] + [r for r in left if r[1]]
                waiting = {s: w for s, w in waiting.items() if s < least} | {s: (r, n) for s, is_gap, r, n in left if not is_gap}
                gaps += [(g - s * k, True, c, m) for s, g, _, c, m, k in found if g > s * k]
                matches += found
                continue
            # no gap holds them: a container for each that no two can share, else as many as full ones take
            large = sum(n for s, _, _, n in band if 2 * s > capacity)
            m = large or -(-sum(s * n for s, _, _, n in band) // capacity)
            gaps.append((capacity, True, plan.containers, m))
            plan.containers += m
    for _, _, r, c, _, k in sorted(matches, key=lambda x: x[2]):
        plan.rank.append(r)
        plan.first.append(c)
        plan.each.append(k)
    if counts.get(0) and not plan.containers:
        plan.containers = 1
    return plan


def pieces(items: DataFrame, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Items cut to the capacity: column ``piece`` from 0, and ``n_tokens`` of the piece."""
    n = F.coalesce(F.col(size), F.lit(0))
    last = F.greatest(F.lit(0), F.ceil(n / F.lit(capacity)) - 1)
    cut = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece")
    return items.withColumn("_n", n).select(*items.columns, "_n", cut).withColumn(
        "n_tokens", F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity)
    ).drop("_n", *([size] if size != "n_tokens" else []))


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, n_tokens, container), one row per item or piece."""
    spark = items.sparkSession
    path = scratch_path(spark, "sorted-items")
    # sized once: a range sort reads its input twice, for its bounds and for its rows
    sized = materialise(items.select(key, F.col(size).alias("_size")), "sized-items")
    cut = pieces(sized, "_size", capacity)
    # range-sorted, largest first; a row's place in its file and the file's number make its rank
    ranged = cut.repartitionByRange(F.col("n_tokens").desc(), F.xxhash64(key, "piece"))
    ranged.sortWithinPartitions(F.col("n_tokens").desc(), key, "piece").withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.schema(ranged.withColumn("_at", F.monotonically_increasing_id()).schema).parquet(path)
    part = F.shiftright("_at", 33).cast("int")
    # bounded: a range partition holds neighbouring sizes, so there are at most (partitions + capacity) rows
    counted = stored.groupBy(part.alias("part"), "n_tokens").agg(F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    parts: dict[int, int] = {}
    for r in counted:
        counts[r["n_tokens"]] = counts.get(r["n_tokens"], 0) + r["n"]
        parts[r["part"]] = parts.get(r["part"], 0) + r["n"]
    plan = best_fit(counts, capacity, cluster_sweep(spark, capacity))
    offsets = np.zeros(max(parts, default=0) + 1, dtype=np.int64)
    total = 0
    for p in sorted(parts):
        offsets[p], total = total, total + parts[p]
    ranks, firsts, each = (np.array(x, dtype=np.int64) for x in (plan.rank, plan.first, plan.each))
    shared = spark.sparkContext.broadcast((offsets, ranks, firsts, each, plan.sized, plan.containers))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, ranks, firsts, each, sized, containers = shared.value
        for batch in batches:
            at = batch.column("_at").to_numpy()
            rank = offsets[at >> 33] + (at & _LOCAL)
            container = rank % max(containers, 1)  # of size 0: spread evenly
            real = rank < sized
            run = np.searchsorted(ranks, rank[real], side="right") - 1
            container[real] = firsts[run] + (rank[real] - ranks[run]) // each[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "piece", "n_tokens")), pa.array(container)], names=[key, "piece", "n_tokens", "container"])

    return stored.mapInArrow(place, f"{key} {dict(items.dtypes)[key]}, piece long, n_tokens long, container long")


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the fewest containers that could hold them, filled share, fullest container."""
    each = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return each.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / F.lit(capacity)).alias("least_containers"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("filled"), F.max("used").alias("fullest"),
    )
