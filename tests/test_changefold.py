from __future__ import annotations

import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from lodestrand.operators.changefold import fold_changes, frontier, live

SCHEMA = "seq long, peer string, epoch long, path string, operation string, record_hash string, accepted_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def fold(df, base=None):
    return fold_changes(df, "path", "accepted_at", "seq", "operation", ["record_hash"], ["peer", "epoch"], base)


def found(df, base=None):
    return sorted(map(tuple, live(fold(df, base), "path", "record_hash").collect()), key=str)


def brute(rows):
    seen = {}
    for seq, peer, epoch, path, op, h, when in rows:
        op = op.strip().lower() if op else None
        if path is None or op not in ("adopt", "delete"):
            continue
        k = (peer, epoch, path, op, h, when)
        old = seen.get(k, "none")
        seen[k] = seq if old == "none" else min(x for x in (old, seq) if x is not None) if old is not None and seq is not None else (old if seq is None else seq)
    last = {}
    for (peer, epoch, path, op, h, when), seq in seen.items():
        key = (when is not None, when or T0, seq is not None, seq or 0, op, h is not None, h or "")
        if path not in last or key > last[path][0]:
            last[path] = (key, op, h)
    return sorted(((p, h) for p, (_, op, h) in last.items() if op == "adopt"), key=str)


def test_order_repeats_and_untidy_operations(spark):
    rows = [
        (5, "a", 1, "x", "ADOPT ", "h1", at(1)), (9, "a", 1, "x", "adopt", "h1", at(1)), (7, "a", 1, "x", "\tdelete", None, at(1)),
        (1, None, 1, "y", "Adopt", None, at(3)), (2, None, 1, "y", None, "h9", at(9)), (3, "b", 2, "z", "delete", None, at(0)), (4, "b", 2, None, "adopt", "h", at(5)),
        (6, "b", 2, "w", "rename", "h", at(5)), (8, "b", 2, "n", "adopt", "early", None), (10, "b", 2, "n", "adopt", "late", at(0)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    # x: the repeated adopt counts at seq 5, so the delete at seq 7 is last
    assert found(df) == [("n", "late"), ("y", None)]
    state = {r["path"]: r["deleted"] for r in fold(df).collect()}
    assert state == {"x": True, "y": False, "z": True, "n": False}


def test_empty_feed_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    df = spark.createDataFrame([(1, "a", 1, "x", "adopt", "h", at(1), "odd", True)], SCHEMA + ", _last string, deleted boolean")
    assert found(df) == [("x", "h")]


def test_late_change_meets_a_tombstone(spark):
    first = spark.createDataFrame([(5, "a", 1, "x", "delete", None, at(9))], SCHEMA)
    base = frontier(first, "path", "accepted_at", "seq", "operation", ["record_hash"], ["peer", "epoch"])
    late = spark.createDataFrame([(6, "a", 1, "x", "adopt", "old", at(3))], SCHEMA)
    assert found(late, base) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_any_order_any_split(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice([None, *range(20)]), rng.choice("ab"), 1, rng.choice([None, "p", "q", "r"]), rng.choice(["adopt", " DELETE", None]), rng.choice(["h1", "h2", None]), at(rng.choice([None, 1, 2, 3])))
        for _ in range(25)
    ]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA)) == want
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


def test_batches_equal_one_fold(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), 1, rng.choice("pqrs"), rng.choice(["adopt", "delete"]), rng.choice(["h1", "h2"]), at(i // 3)) for i in range(60)]
    a, b = (spark.createDataFrame([r for i, r in enumerate(rows) if i % 2 == k], SCHEMA) for k in (0, 1))
    base = frontier(a, "path", "accepted_at", "seq", "operation", ["record_hash"], ["peer", "epoch"])
    assert found(b, base) == brute(rows)
