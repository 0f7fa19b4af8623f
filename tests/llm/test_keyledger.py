from __future__ import annotations

import random

import pytest
from lodestrand.llm.keyledger import KeyLedger, digest_key
from pyspark.sql import functions as F


def hexes(n):
    return f"{n:064x}"


def batch(spark, rows):
    df = spark.createDataFrame(rows, "hash string, order long, origin string")
    return df.select(digest_key(F.col("hash")).alias("key"), "order", "origin")


def orders(df):
    return sorted(r["order"] for r in df.collect())


def test_batches_build_the_history(spark):
    ledger = KeyLedger(spark, buckets=3)
    ledger.load(batch(spark, [(hexes(1), None, "i"), (hexes(1).upper() + "\n", None, "i"), (None, None, "i"), ("xyz", None, "i")]))
    first = batch(spark, [(hexes(1), 1, "a"), (hexes(2), 2, "a"), (" " + hexes(2).upper(), 3, "a"), (None, 4, "a"), (hexes(3)[:-1], 5, "a"), ("g" * 64, 6, "a"), (hexes(7), None, "a")])
    assert orders(ledger.seen(first)) == [1, 3]
    second = batch(spark, [(hexes(2), 10, "a"), (hexes(9), 11, "a"), (hexes(7), 12, "a")])
    assert orders(ledger.seen(second)) == [10]
    assert orders(ledger.seen(second)) == [10, 11, 12]  # once more: all of it was there
    assert orders(ledger.holds(batch(spark, [(hexes(1), 1, "p"), (hexes(9), 2, "p"), (None, 3, "p")]), before=0)) == [1]


def test_ties_are_both_first(spark):
    ledger = KeyLedger(spark, buckets=2)
    assert orders(ledger.seen(batch(spark, [(hexes(1), 5, "a"), (hexes(1), 5, "b"), (hexes(1), 6, "a")]))) == [6]


def test_empty_ledger_and_batch(spark):
    ledger = KeyLedger(spark, buckets=2)
    assert orders(ledger.seen(batch(spark, []))) == []
    assert orders(ledger.holds(batch(spark, [(hexes(1), 1, "p")]))) == []


def test_a_hot_key_among_many(spark):
    rng = random.Random(1)
    rows = [(hexes(0 if rng.random() < 0.4 else rng.randrange(1, 400)), i, "a") for i in range(3000)]
    seen, want = set(), []
    for h, i, _ in rows:
        if h in seen:
            want.append(i)
        seen.add(h)
    rng.shuffle(rows)
    assert orders(KeyLedger(spark, buckets=4).seen(batch(spark, rows))) == want


def _rows(keys, start):
    return [(hexes(k), start + i, "a") for i, k in enumerate(keys)]


def test_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = batch(spark, _rows(range(500), 0))
    KeyLedger(spark, path, buckets=8).seen(first).count()
    again = KeyLedger(spark, path)
    assert (again.buckets, again.batches) == (8, 1)
    assert orders(again.holds(first)) == list(range(500))
    assert orders(again.seen(first)) == list(range(500))
    third = KeyLedger(spark, path)
    assert orders(third.seen(batch(spark, _rows(range(400, 600), 1000)))) == list(range(1000, 1100))
    with pytest.raises(ValueError, match="8 buckets"):
        KeyLedger(spark, path, buckets=4)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert orders(KeyLedger(spark, path).holds(first)) == list(range(500))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_numbered_batch_given_again_gets_the_same_answers(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    ledger = KeyLedger(spark, path, buckets=2)
    ledger.load(batch(spark, _rows([1], 0)))
    rows = batch(spark, _rows([1, 2, 2, 3], 10))
    assert orders(ledger.seen(rows, number=1)) == [10, 12]
    assert orders(KeyLedger(spark, path).seen(rows, number=1)) == [10, 12]
    assert orders(KeyLedger(spark, path).seen(rows, number=2)) == [10, 11, 12, 13]


def test_merging_keeps_every_key(spark, tmp_path, monkeypatch):
    from lodestrand.llm import keyledger

    monkeypatch.setattr(keyledger, "MERGE_EVERY", 2)
    monkeypatch.setattr(keyledger, "ROWS_PER_BUCKET", 10)
    path = f"file://{tmp_path}/ledger"
    ledger = KeyLedger(spark, path, buckets=2)
    ledger.load(batch(spark, _rows(range(10), 0)))
    lazy = ledger.seen(batch(spark, _rows(range(5, 20), 100)))
    for i in range(1, 5):
        assert orders(ledger.seen(batch(spark, _rows(range(i * 10, i * 10 + 20), i * 1000)))) == list(range(i * 1000, i * 1000 + 10))
    assert ledger.generation > 0 and ledger.buckets > 2
    assert orders(lazy) == list(range(100, 105))
    ledger.vacuum()
    reopened = KeyLedger(spark, path)
    assert (reopened.buckets, reopened.batches) == (ledger.buckets, 5)
    assert orders(reopened.holds(batch(spark, _rows(range(60), 0)))) == list(range(60))
    assert orders(reopened.holds(batch(spark, _rows(range(60), 0)), before=0)) == list(range(10))


def test_a_base_is_read_without_shuffle_or_sort(spark, tmp_path):
    ledger = KeyLedger(spark, f"file://{tmp_path}/ledger", buckets=4)
    ledger.load(batch(spark, _rows(range(100), 0)))
    firsts = batch(spark, _rows(range(100), 0)).groupBy("key").agg(F.min("order").alias("first_order"))
    plan = ledger._new(firsts)._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("Scan parquet") - 400 :]
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort [" not in right.split("ColumnarToRow")[0]
