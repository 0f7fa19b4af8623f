from __future__ import annotations

import numpy as np
import pyarrow as pa
from lodestrand.operators.tablediff import _align, belied_roots, copy_differences

SCHEMA = "pass_id long, side string, path string, kind string, size long, content_hash string, readonly boolean, tombstone boolean, version array<struct<replica:string,counter:long>>"


def row(p, side, path, kind="file", size=1, h="aa", ro=False, tomb=False, v=(("r", 1),)):
    return (p, side, path, kind, size, h, ro, tomb, None if v is None else list(v))


def run(spark, rows, schema=SCHEMA, **kw):
    return sorted(map(tuple, copy_differences(spark.createDataFrame(rows, schema), **kw).collect()))


def test_cells(spark):
    rows = [
        row(1, "local", "same", h=" AA\n"), row(1, "Remote ", "same"), row(1, "local", "lonely"), row(1, "remote", "other"), row(1, "local", "lonely"),
        row(1, "local", "x", size=None, h=None, ro=None), row(1, "remote", "x", size=5, h=None, ro=True, tomb=None),
        row(1, "local", "v", v=(("b", 2), ("a", 1), ("c", 0))), row(1, "remote", "v", v=(("a", 1), ("b", 2))),
        row(1, "local", "w", v=None), row(1, "remote", "w", v=(("a", 1),)), row(1, "local", "u", v=None), row(1, "remote", "u", v=(("a", 0),)),
        row(None, "local", "n"), row(1, None, "n"), row(1, "local", None), row(2, "local", "same"),
    ]
    want = [
        (1, "lonely", "missing_remote"), (1, "other", "missing_local"), (1, "w", "version"), (1, "x", "readonly"), (1, "x", "size"), (1, "x", "tombstone"), (2, "same", "missing_remote"),
    ]
    assert run(spark, rows) == want
    assert run(spark, rows, buckets=5) == want


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(*row(1, "local", "a"), 3, 4)], SCHEMA + ", _hash long, _bucket int") == [(1, "a", "missing_remote")]


def test_very_long_paths(spark):
    long = "p" * 100_000
    assert run(spark, [row(1, "local", long), row(1, "remote", long, size=2)]) == [(1, long, "size")]


def test_keys_of_one_hash_are_told_apart():
    left = pa.table({"k": ["a", "b", "c"], "_hash": np.array([7, 7, 9], dtype=np.int64)})
    right = pa.table({"k": ["b", "c", "a", "d"], "_hash": np.array([7, 9, 7, 7], dtype=np.int64)})
    partner, matched = _align(left, right, ["k"])
    assert partner.tolist() == [2, 0, 1] and matched.tolist() == [True, True, True, False]


def test_belied_roots(spark):
    cells = spark.createDataFrame([(1, "a", "size"), (2, "a", "size"), (3, "a", "kind")], "pass_id long, path string, field_name string")
    reports = spark.createDataFrame([(1, "AB", "ab "), (1, "ab", "ab"), (2, None, None), (3, "a", "b"), (4, "a", "a")], "pass_id long, local_before_root string, remote_before_root string")
    assert [tuple(r) for r in belied_roots(reports, cells).collect()] == [(1, "", "root")]
