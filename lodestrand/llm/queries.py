"""Queries of the problems on text and keys over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .bpe import VOCABULARY, count_tokens, encode_corpus
from .keyledger import KeyLedger, digest_key
from .lookalike import lookalike_classes, lookalike_pairs
from .sentences import split_sentences
from .packing import CAPACITY, fill_report, pack


def _chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extents").select(digest_key(F.col("hash")).alias("key"), F.col("arrival").alias("order"))


def _inventory_ledger(spark: SparkSession, sf_dir: str) -> KeyLedger:
    ledger = KeyLedger(spark)
    ledger.load(table(spark, sf_dir, "inventory").select(digest_key(F.col("hash")).alias("key")))
    return ledger


def _plan_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "delta_plans").select("plan_id", F.posexplode("missing").alias("pos", "hash"))
    return entries.select("plan_id", "pos", digest_key(F.col("hash")).alias("key"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _inventory_ledger(spark, sf_dir)
    chunks = ledger.seen(_chunk_keys(spark, sf_dir)).select(F.lit("chunk").alias("origin"), F.col("order").alias("rec_id"), F.lit(0).alias("pos"))
    plans = ledger.holds(_plan_entries(spark, sf_dir), before=0).select(F.lit("plan").alias("origin"), F.col("plan_id").alias("rec_id"), "pos")
    return chunks.unionByName(plans)


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the ledger over the arrivals in four batches, against the answers by definition."""
    keys = _chunk_keys(spark, sf_dir)
    ledger = _inventory_ledger(spark, sf_dir)
    low, high = keys.agg(F.min("order"), F.max("order")).first()
    edges = [low + (high - low + 1) * i // 4 for i in range(5)] if low is not None else [0] * 5
    said = None
    for a, b in zip(edges, edges[1:], strict=False):
        part = ledger.seen(keys.where((F.col("order") >= a) & (F.col("order") < b))).select("order", F.lit(True).alias("said"))
        said = part if said is None else said.unionByName(part)
    inventory = table(spark, sf_dir, "inventory").select(digest_key(F.col("hash")).alias("key")).where("key IS NOT NULL").distinct()
    firsts = keys.where("key IS NOT NULL").groupBy("key").agg(F.min("order").alias("order")).join(inventory, "key", "left_anti")
    truth = keys.where("key IS NOT NULL").select("order").join(firsts.select("order"), "order", "left_anti").select("order", F.lit(True).alias("true"))
    answers = keys.select("order").join(said, "order", "left").join(truth, "order", "left")
    no = F.lit(False)
    return answers.agg(
        F.count("*").alias("n_asked"), F.count_if(F.coalesce("said", no)).alias("n_seen"), F.count_if(F.coalesce("said", no) != F.coalesce("true", no)).alias("n_wrong")
    ).withColumn("wrong_rate", F.coalesce(F.try_divide("n_wrong", "n_asked"), F.lit(0.0)))


def _all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "collisions").select("folder", F.explode("paths").alias("path"))
    return table(spark, sf_dir, "index_records").select("folder", "path").unionByName(listed)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_all_paths(spark, sf_dir))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path with its visual form and the number of its look-alikes."""
    return lookalike_classes(_all_paths(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), VOCABULARY)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(count_tokens(table(spark, sf_dir, "documents"), VOCABULARY), "doc_id", "n_tokens", CAPACITY)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(_packed(spark, sf_dir), CAPACITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p4_found, p4_classes, p6_ids, p7_containers, p7_fill, p8_found)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

_KEY = lambda c: f"CASE WHEN regexp_full_match(lower(trim({c}, {_BLANKS})), '[0-9a-f]{{64}}') THEN lower(trim({c}, {_BLANKS})) END"

_P2 = f"""
WITH inv AS (SELECT DISTINCT {_KEY('hash')} AS k FROM inventory),
     ext AS (SELECT arrival, {_KEY('hash')} AS k, min(arrival) OVER (PARTITION BY {_KEY('hash')}) AS first_arrival FROM extents),
     seen AS (SELECT arrival FROM ext WHERE k IS NOT NULL AND (arrival > first_arrival OR k IN (SELECT k FROM inv WHERE k IS NOT NULL)))
"""

ORACLES = {
    "p2_found": _P2
    + f"""SELECT 'chunk' AS origin, arrival AS rec_id, CAST(0 AS INTEGER) AS pos FROM seen
UNION ALL SELECT 'plan', plan_id, CAST(pos - 1 AS INTEGER) FROM (SELECT plan_id, unnest(range(1, len(missing) + 1)) AS pos, unnest(missing) AS hash FROM delta_plans)
WHERE {_KEY('hash')} IN (SELECT k FROM inv WHERE k IS NOT NULL)""",
    "p2_report": _P2 + "SELECT (SELECT count(*) FROM extents) AS n_asked, (SELECT count(*) FROM seen) AS n_seen, CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS DOUBLE) AS wrong_rate",
}
