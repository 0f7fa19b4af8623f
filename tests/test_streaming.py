from __future__ import annotations

import os
import time

import pytest
from lodestrand.streaming import debounce, fold, journal
from pyspark.sql import functions as F


@pytest.fixture
def stream_of(spark, tmp_path):
    def make(rows, schema, parts=1):
        folder = str(tmp_path / f"in{time.time_ns()}")
        for k in range(parts):
            spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def test_bursts_by_quiet_time_and_longest_delay(spark):
    rows = [(1, t, False) for t in (0, 500, 900, 1300, 5000)] + [(2, 0, False), (2, 100, True), (2, 200, False)]
    df = spark.createDataFrame(rows, "k long, t long, lost boolean")
    got = sorted(map(tuple, debounce.debounced(df, "k", "t", "lost", 750, 1000).collect()))
    assert got == [(1, 0, 900, 3, False), (1, 1300, 1300, 1, False), (1, 5000, 5000, 1, False), (2, 0, 100, 2, True), (2, 200, 200, 1, False)]
    assert sorted(map(tuple, debounce.bursts(df, "k", "t", 750).collect())) == [(1, 0, 1300, 4), (1, 5000, 5000, 1), (2, 0, 200, 3)]
    assert debounce.debounced(df.limit(0), "k", "t", "lost", 750, 1000).count() == 0


def test_debounce_as_a_stream(spark, stream_of, tmp_path):
    rows = [(1, t, False) for t in (0, 500, 900, 1300, 5000)] + [(2, 0, True)]
    out = debounce.debounce_stream(stream_of(rows, "k long, t long, lost boolean"), "k", "t", "lost", 750, 1000)
    # timers keep a query alive for ever, so it is watched and stopped
    query = out.writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", os.fspath(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            got = sorted(map(tuple, spark.table("bursts").collect()))
            if len(got) >= 3:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert [r for r in got if r[1] != 5000] == [(1, 0, 900, 3, False), (1, 1300, 1300, 1, False), (2, 0, 0, 1, True)]


def test_view_of_a_stream_equals_the_batch(spark, stream_of, tmp_path):
    rows = [(i % 5, i * 7 % 50, f"phase{i}") for i in range(50)]
    schema = "k long, seq long, phase string"
    batch = sorted(map(tuple, fold.latest_view(spark.createDataFrame(rows, schema), "k", "seq", "phase").collect()))
    live = fold.latest_view(stream_of(rows, schema, 3), "k", "seq", "phase")
    assert sorted(map(tuple, fold.run_batch(live, "view", "complete", os.fspath(tmp_path / "cp")).collect())) == batch


def test_windows_and_sessions(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:10:00"), (1, "a", "2024-01-01 00:50:00"), (1, "b", "2024-01-01 01:10:00")], "k long, kind string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["kind"], r["n"]) for r in fold.windowed_counts(df, "ts", "kind").collect()) == [("a", 2), ("b", 1)]
    assert [r["events"] for r in fold.sessions(df, "k", "ts", "30 minutes").orderBy("session_window").collect()] == [1, 2]


def test_journal(spark):
    log = spark.createDataFrame([(1, "prepared", 1), (1, "materialized", 2), (1, "committed", 3), (2, "preserved", 1)], "id long, state string, seq long")
    assert [(r["id"], r["from_state"], r["to_state"]) for r in journal.illegal_steps(log).orderBy("id").collect()] == [(1, "materialized", "committed"), (2, "none", "preserved")]
    assert {r["id"]: r["state"] for r in journal.latest_states(log).collect()} == {1: "committed", 2: "preserved"}
