"""Who has which chunk, and from whom to fetch it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import source_cost_ms
from ..runtime import cut, materialise
from .ranking import number_rows


def provider_counts(missing: DataFrame, availability: DataFrame) -> DataFrame:
    """Distinct peers that hold each missing hash, 0 for none."""
    held = availability.distinct().groupBy("hash").agg(F.count("*").alias("n"))
    return missing.select("hash").distinct().join(held, "hash", "left").select("hash", F.coalesce("n", F.lit(0)).alias("providers"))


def rarest_order(missing: DataFrame, availability: DataFrame) -> DataFrame:
    """(hash, providers, rank): every missing hash with its place, rarest first, ties by hash."""
    return number_rows(provider_counts(missing, availability), [], ["providers", "hash"], "rank")


def cheapest_peer(missing: DataFrame, availability: DataFrame, peers: DataFrame) -> DataFrame:
    """The provider of least cost of each hash, ties by peer."""
    cost = source_cost_ms(F.col("rtt_ms"), F.col("queued_bytes"), F.col("goodput_bps"), F.col("failure_penalty"))
    offers = availability.distinct().join(missing.select("hash").distinct(), "hash", "left_semi").join(peers.withColumn("cost_ms", cost), "peer")
    return offers.groupBy("hash").agg(F.min(F.struct("cost_ms", "peer")).alias("m")).select("hash", "m.peer", "m.cost_ms")


def overlay_bands(counts: DataFrame) -> DataFrame:
    """(self_id, n): the digests of n made-up neighbours in order, the first of them active, the next passive; sizes by tiers of n."""
    n = F.col("n")
    active = F.when(n <= 1, n).when(n <= 10, F.least(F.lit(6), n)).when(n <= 100, F.least(F.lit(8), n)).otherwise(F.least(F.lit(12), n))
    passive = F.when(n <= 1, 0).when(n <= 10, F.least(F.lit(12), n - active)).when(n <= 100, F.least(F.lit(32), n - active)).otherwise(F.least(F.lit(64), n - active))
    each = counts.where("n > 0").select("self_id", active.alias("_a"), passive.alias("_p"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i"))
    each = each.withColumn("peer", F.sha2(F.concat(F.col("self_id").cast("string"), F.lit(":"), F.col("i").cast("string")), 256))
    at = F.row_number().over(Window.partitionBy("self_id").orderBy("peer"))
    ranked = each.withColumn("rank", at.cast("bigint"))
    return ranked.where(F.col("rank") <= F.col("_a") + F.col("_p")).select("self_id", "peer", "rank", F.when(F.col("rank") <= F.col("_a"), "active").otherwise("passive").alias("band"))


@dataclass(frozen=True)
class Limits:
    max_sources: int = 8
    max_chunks_per_peer: int = 8
    max_assignments: int = 64


#: Hashes of a round, in assignments: more make fewer rounds of more offers.
BATCH = 4


def greedy_schedule(missing: DataFrame, availability: DataFrame, peers: DataFrame, limits: Limits = Limits(), group: str = "job") -> DataFrame:
    """(group, seq, hash, peer): rarest first, each from its cheapest provider that has room.

    All hashes are gone through, in rounds. A round takes each group's next BATCH * max_assignments hashes that a provider with
    room holds; what it passes over has none, and never will have, since peers only fill up and sources only get fixed.
    A group stops when it has max_assignments, or has no such hash left. Whoever isn't a source yet is chosen only as
    cheapest of a hash, so a round needs, of each of its hashes, those peers that are sources or among the max_sources
    cheapest of any of them. A round that doesn't end a group has filled a peer or the sources: max_sources + 2 rounds at most.
    """
    cost = source_cost_ms(F.col("rtt_ms"), F.col("queued_bytes"), F.col("goodput_bps"), F.col("failure_penalty"))
    offers = missing.select(group, "hash").distinct().join(availability.distinct(), "hash").join(peers.withColumn("cost", cost).select("peer", "cost"), "peer")
    rarity = offers.groupBy(group, "hash").agg(F.count("*").alias("providers"))
    kinds = {**dict(missing.dtypes), **dict(peers.dtypes)}
    # the assignments so far, each with where its group stands: (_providers, _hash) was its last hash, _open if it goes on
    shape = f"{group} {kinds[group]}, seq long, hash {kinds['hash']}, peer {kinds['peer']}, _providers long, _hash {kinds['hash']}, _open boolean"
    state = missing.sparkSession.createDataFrame([], shape)
    if min(limits.max_sources, limits.max_chunks_per_peer, limits.max_assignments) < 1:
        return state.select(group, "seq", "hash", "peer")

    batch = BATCH * limits.max_assignments

    def assign(so_far: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        so_far = so_far.sort_values("seq")
        used: dict = {}
        for p in so_far["peer"]:
            used[p] = used.get(p, 0) + 1
        rows = list(zip(so_far["hash"], so_far["peer"], strict=True))
        hashes = 0
        for (n, h), offer in offered.sort_values(["providers", "hash", "peer"]).groupby(["providers", "hash"], sort=False):
            if len(rows) >= limits.max_assignments:
                break
            open_ = [(c + used.get(p, 0), used.get(p, 0), p) for c, p in zip(offer["cost"], offer["peer"], strict=True) if used.get(p, 0) < limits.max_chunks_per_peer and (p in used or len(used) < limits.max_sources)]
            if open_:
                p = min(open_)[2]
                used[p] = used.get(p, 0) + 1
                rows.append((h, p))
            hashes, last = hashes + 1, (n, h)
        if not hashes:
            return so_far.assign(_open=False)
        goes_on = hashes == batch and len(rows) < limits.max_assignments
        name = offered[group].iloc[0]
        return pd.DataFrame([(name, i, h, p, *last, goes_on) for i, (h, p) in enumerate(rows)], columns=so_far.columns)

    rated = materialise(offers.join(rarity, [group, "hash"]), "offers")
    feasible, used = rated, None
    while True:
        first = F.row_number().over(Window.partitionBy(group).orderBy("providers", "hash"))
        rare = feasible.select(group, "providers", "hash").distinct().withColumn("_r", first).where(F.col("_r") <= batch)
        offered = cut(feasible.join(rare.select(group, "hash"), [group, "hash"], "left_semi"))  # the few offers that the round is about
        near = F.row_number().over(Window.partitionBy(group, "hash").orderBy("cost", "peer"))
        able = offered.withColumn("_n", near).where(F.col("_n") <= limits.max_sources).select(group, "peer")
        able = (able.unionByName(used) if used is not None else able).distinct()
        offered = offered.join(able, [group, "peer"], "left_semi").select(*rated.columns)
        state = materialise(state.groupBy(group).cogroup(offered.groupBy(group)).applyInPandas(assign, shape), "schedule")
        going = state.where("_open")
        if going.isEmpty():
            return state.select(group, "seq", "hash", "peer")
        stands = going.groupBy(group).agg(F.first("_providers").alias("_providers"), F.first("_hash").alias("_hash"), (F.count_distinct("peer") >= limits.max_sources).alias("_full"))
        counts = going.groupBy(group, "peer").agg(F.count("*").alias("_used"))
        used = counts.select(group, "peer")
        beyond = rated.join(stands, group).where((F.col("providers") > F.col("_providers")) | ((F.col("providers") == F.col("_providers")) & (F.col("hash") > F.col("_hash"))))
        room = (F.col("_used") < limits.max_chunks_per_peer) | (F.col("_used").isNull() & ~F.col("_full"))
        feasible = beyond.join(counts, [group, "peer"], "left").where(room).select(*rated.columns)
