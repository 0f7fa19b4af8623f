"""Pushes, pulls, fills, whole passes, watch loops and workers, against plain loops."""

from __future__ import annotations

import random

import pytest
from lodestrand.functions import records as R
from lodestrand.functions.pyfuncs import collision_key
from lodestrand.operators import access, exchange, merge, syncpass
from lodestrand.streaming import journal, watch
from pyspark.sql import functions as F

ROW = "pass_id long, path string, kind string, size long, content_hash string, readonly boolean, tombstone boolean, vtext string"
KEYS = ["pass_id", "path"]


def rows(spark, items, pass_id=1):
    """items: (path, kind, content, tombstone, vtext)"""
    df = spark.createDataFrame([(pass_id, p, k, 3 if k == "file" else 0, h if k == "file" else None, False, t, v) for p, k, h, t, v in items], ROW)
    return df.withColumn("vv", R.vector_of(F.col("vtext")))


def run(spark, left, right, own="me", ceiling=0):
    return syncpass.sync_pass(merge.paired(left, right, KEYS), KEYS, F.lit(own), F.lit(ceiling), collision_key("path"))


def test_a_pass_brings_both_sides_together(spark):
    left = rows(spark, [("a", "file", "x", False, "l=1"), ("both", "file", "p", False, "l=2"), ("d", "directory", None, False, "l=1"), ("d/e", "file", "q", False, "l=1"), ("old", "file", "o", False, "s=1")])
    right = rows(spark, [("b", "file", "y", False, "r=1"), ("both", "file", "z", False, "r=2"), ("old", "file", "o", True, "s=1,r=1")])
    done = run(spark, left, right)
    report = done.report.first()
    assert report["status"] == "pass" and report["desired_root"] == report["verified_local_root"] == report["verified_remote_root"] and report["conflicts"] == 1
    shown = lambda df: sorted(map(tuple, df.select("path", "kind", "content_hash", "tombstone", "vtext").collect()))
    assert shown(done.local_after) == shown(done.remote_after) == shown(done.desired)
    again = run(spark, *(x.withColumn("vv", R.vector_of(F.col("vtext"))) for x in (done.local_after, done.remote_after))).report.first()
    assert (again["local_actions"], again["remote_actions"], again["conflicts"], again["local_before_root"]) == (0, 0, 0, report["desired_root"])
    assert syncpass.require(done.report).count() == 1


def test_gates_stop_a_pass(spark):
    cases = [
        ([("A", "file", "x", False, "l=1")], [("a", "file", "y", False, "r=1")], "namespace"),
        ([("dir", "directory", None, True, "l=1")], [("dir/x", "file", "y", False, "r=1")], "namespace"),
        ([("a", "file", "x", False, "l=1")], [("b", "file", "y", False, "me=7,r=1")], "counter"),
        ([], [("s", "symlink", None, False, "r=1")], "namespace"),
        ([("a", "file", "x", False, "l=1")], [("b", "file", "y", False, "r=1")], "pass"),
    ]
    sides = [rows(spark, []), rows(spark, [])]
    for n, case in enumerate(cases):
        sides = [s.unionByName(rows(spark, c, n)) for s, c in zip(sides, case, strict=False)]
    report = run(spark, *sides).report
    assert {r["pass_id"]: r["status"] for r in report.collect()} == {n: c[2] for n, c in enumerate(cases)}
    with pytest.raises(Exception, match="stopped by its gate"):
        syncpass.require(report).collect()


def test_empty_pass(spark):
    assert run(spark, rows(spark, []), rows(spark, [])).report.count() == 0


def _plain_fill(needed, offers, outcome):
    """One exchange, round by round."""
    left, tries, off, gone, got = set(needed), {}, set(), set(), {}
    while True:
        load = {}
        for p in got.values():
            load[p] = load.get(p, 0) + 1
        asked = {}
        for h in left:
            able = [(-tries.get((h, p), 1), c + load.get(p, 0), load.get(p, 0), p) for (x, p), c in offers.items() if x == h and p not in off and (h, p) not in gone]
            if able:
                asked[h] = min(able)[3]
        if not asked:
            return got, left
        out = {h: outcome(h, p, tries.get((h, p), 1)) for h, p in asked.items()}
        for h, p in asked.items():
            if out[h] == "ok":
                got[h] = p
                left.discard(h)
            elif out[h] == "missing":
                gone.add((h, p))
            else:
                if tries.get((h, p), 1) > 1:
                    off.add(p)
                tries[h, p] = tries.get((h, p), 1) + 1


def test_fill_tries_again_and_assigns_anew(spark):
    rng = random.Random(3)
    offers = {(h, p): rng.randrange(5) for h in range(40) for p in range(6) if rng.random() < 0.4}
    lucky = lambda h, p, n: "failed" if (h * 7 + p * 3) % 23 == 0 or ((h + p) % 11 == 0 and n == 1) else "missing" if (h + 2 * p) % 9 == 0 else "ok"
    h, p, n = F.col("hash"), F.col("peer"), F.col("attempt")
    outcome = F.when(((h * 7 + p * 3) % 23 == 0) | (((h + p) % 11 == 0) & (n == 1)), "failed").when((h + 2 * p) % 9 == 0, "missing").otherwise("ok")
    needed = spark.createDataFrame([(1, h, 10) for h in range(41)], "job int, hash long, length long")
    given = spark.createDataFrame([(1, h, p, c) for (h, p), c in offers.items()], "job int, hash long, peer long, cost long")
    done, open_ = exchange.fill(needed, given, outcome, ["job"])
    got, left = _plain_fill(range(41), offers, lucky)
    assert {r["hash"]: r["peer"] for r in done.collect()} == got and {r["hash"] for r in open_.collect()} == left and 40 in left
    none = exchange.fill(needed.limit(0), given, outcome, ["job"])
    assert none[0].count() == 0 and none[1].count() == 0


def test_receipts_and_frames(spark):
    own = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("c", 1, None)], "path string, x long, y long")
    told = spark.createDataFrame([("a", 1, 3), ("c", 1, None)], own.schema)
    assert sorted(map(tuple, exchange.receipt_issues(told, own, ["path"], ("x", "y")).collect())) == [("a", "y"), ("b", "receipt")]
    ext = spark.createDataFrame([("f", 0, 0, 10, "a"), ("f", 1, 10, 5, "b")], "path string, idx int, chunk_offset long, length long, hash string")
    asked = spark.createDataFrame([("f", 0, "b"), ("f", 1, "a"), ("f", 2, "b"), ("f", 3, "z")], "path string, pos long, hash string")
    got = [(r["pos"], r["bytes_before"], r["issue"]) for r in exchange.requested_frames(asked, ext, ["path"]).orderBy("pos").collect()]
    assert got == [(0, 0, None), (1, 5, None), (2, 15, "duplicate"), (3, 15, "unknown")]


def test_watch_triggers_name_their_paths(spark):
    events = [(1, 0, "modify", "a"), (1, 50, "modify", "b"), (1, 60, "access", "c"), (1, 70, "modify", "skip/x"), (1, 500, "modify", "d"), (1, 510, "any", "e"), (2, 0, "modify", None)]
    df = spark.createDataFrame(events, "key long, at long, kind string, path string")
    got = [tuple(r) for r in watch.triggers(df, ["skip"], 100, 1000).orderBy("key", "started_ms").collect()]
    assert got == [(1, 0, 50, 2, False, ["a", "b"]), (1, 500, 510, 2, True, ["d", "e"]), (2, 0, 0, 1, False, [])]


def test_a_workers_backoff_and_pause(spark):
    said = [(0, 1, "tick", True), (100, 2, "sync", False), (1000, 3, "changed", True), (2100, 4, "tick", False), (3000, 5, "pause", True), (3100, 6, "sync", True), (9000, 7, "resume", True), (9001, 8, "tick", True), (9002, 9, "stop", True), (99999, 10, "tick", True)]
    df = spark.createDataFrame([(1, *c) for c in said], "key long, at long, seq long, command string, ok boolean")
    got = [tuple(r)[1:] for r in watch.worker_states(df, 50_000).orderBy("at").collect()]
    assert got == [
        (100, "sync", True, "error", 1, 2100), (2100, "tick", True, "error", 2, 6100), (3000, "pause", False, "paused", 0, None), (3100, "sync", False, "paused", 1, None),
        (9000, "resume", False, "idle", 0, None), (9001, "tick", True, "checked", 0, None), (9002, "stop", False, "stopped", 0, None),
    ]


def test_null_fields_are_settled(spark):
    log = spark.createDataFrame([("1", "p", "materialized", "h", None), ("2", "q", "prepared", "h", None)], "id string, path string, state string, record_hash string, precondition string")
    index = spark.createDataFrame([("p", "h")], "path string, record_hash string")
    assert {r["id"]: r["decision"] for r in journal.recover(log, index).collect()} == {"1": "mark_indexed", "2": "resume"}
    entries = spark.createDataFrame([(1, "a", "x", 5), (1, "a", "y", 1)], "pass_id long, path string, replica string, counter long")
    known = spark.createDataFrame([("x",)], "replica string")
    limit = spark.createDataFrame([], "pass_id long, replica string, ceiling long")
    got = {r["replica"]: r["issue"] for r in access.ceiling_issues(entries, known, limit, F.lit("me"), F.lit("res")).collect()}
    assert got == {"x": "beyond_ceiling", "y": "unknown_replica"}
