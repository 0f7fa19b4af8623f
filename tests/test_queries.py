"""Every query of the core against its SQL, over the smallest test data."""

from __future__ import annotations

import pytest
from lodestrand.plans.catalogue import ORACLES, QUERIES

from oracle import DATA, compare, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, con, spark):
    compare(con, spark, QUERIES[name], ORACLES[name])


def _table(name, columns):
    import pyarrow.parquet as pq

    return pq.read_table(f"{DATA}/{name}.parquet", columns=columns).to_pylist()


def _folded(path):
    import unicodedata

    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    return "/".join(nfkc(nfkc(c).casefold()) for c in path.split("/"))


def _stale_collision_keys():
    best = {}
    for r in _table("index_records", ["folder", "snap_no", "path", "generation", "collision_key"]):
        k = (r["folder"], r["snap_no"], r["path"])
        if None not in k and (k not in best or r["generation"] > best[k][0]):
            best[k] = (r["generation"], r["collision_key"])
    return {(p, key, _folded(p)) for (_, _, p), (_, key) in best.items() if key != _folded(p)}


def test_stale_collision_keys(spark):
    got = {(r["path"], r["collision_key"], r["expected"]) for r in QUERIES["stale_collision_keys"](spark, DATA).collect()}
    assert got and got == _stale_collision_keys()


def test_namespace_issues(spark):
    """Record by record, as a merged snapshot's rows are gone through."""
    passes = {}
    for r in _table("snapshot_rows", ["pass_id", "side", "path", "kind", "tombstone"]):
        if r["pass_id"] is not None and r["path"] is not None and r["side"].strip().lower() == "remote":
            passes.setdefault(r["pass_id"], {})[r["path"]] = (r["kind"], r["tombstone"])
    want = set()
    for n, rows in passes.items():
        names = {}
        for p, (kind, dead) in rows.items():
            if dead:
                continue
            if kind not in ("file", "directory"):
                want.add((n, p, "kind"))
            parts = p.split("/")
            for i in range(1, len(parts) + 1):
                above = "/".join(parts[:i])
                names.setdefault(_folded(above), set()).add(above)
                if i < len(parts) and above in rows and (rows[above][1] or rows[above][0] != "directory"):
                    want.add((n, p, "ancestor"))
        want |= {(n, p, "collision") for ps in names.values() if len(ps) > 1 for p in ps}
    got = QUERIES["namespace_issues"](spark, DATA).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
    stopped = {r["pass_id"]: r["status"] for r in QUERIES["sync_status"](spark, DATA).collect()}
    assert set(stopped) >= set(passes) and set(stopped.values()) <= {"pass", "namespace", "content"}


def test_content_chunk_sharing(spark):
    import hashlib

    from lodestrand.functions.pyfuncs import cut_points

    seen = []
    for r in _table("documents", ["text"]):
        data, start = (r["text"] or "").encode(), 0
        for end in cut_points(data, 64, 256, 1024):
            seen.append(hashlib.sha256(data[start:end]).digest())
            start = end
    assert tuple(QUERIES["content_chunk_sharing"](spark, DATA).first()) == (len(seen), len(set(seen)))


def test_greedy_schedule(spark):
    from test_operators import _plain_schedule

    from lodestrand.operators.swarm import Limits

    avail = {(r["l_suppkey"], r["l_partkey"]) for r in _table("lineitem", ["l_suppkey", "l_partkey"])}
    suppliers = _table("supplier", ["s_suppkey", "s_acctbal"])
    cost = {k: 5 + k * 37 % 190 + (k * 7919 % 5000000) * 1000 // max(max(int(b // 1), 0) * 1000, 1) + (1000 if k % 5 == 0 else 0) for r in suppliers for k, b in [(r["s_suppkey"], r["s_acctbal"])]}
    parts = [r["p_partkey"] for r in _table("part", ["p_partkey"])]
    got = {}
    for r in QUERIES["greedy_schedule"](spark, DATA).orderBy("job", "seq").collect():
        got.setdefault(r["job"], []).append((r["hash"], r["peer"]))
    assert got == {j: rows for j in range(10) if (rows := _plain_schedule({h for h in parts if h % 10 == j}, [(p, h) for p, h in avail if h % 10 == j], cost, Limits()))}


def test_swarm_fill(spark):
    parts = {r["p_partkey"] for r in _table("part", ["p_partkey"])}
    offered = {(r["l_suppkey"], r["l_partkey"]) for r in _table("lineitem", ["l_suppkey", "l_partkey"])}
    rows = QUERIES["swarm_fill"](spark, DATA).collect()
    assert sorted(r["hash"] for r in rows) == sorted(parts)
    done = [r for r in rows if r["state"] == "delivered"]
    assert len(done) > len(parts) // 2 and all((r["peer"], r["hash"]) in offered and (r["hash"] * 7 + r["peer"] * 3) % 101 >= 1 for r in done)
    assert all(r["peer"] is None for r in rows if r["state"] == "open")


def test_every_query_has_an_answer_to_compare():
    assert set(QUERIES) - set(ORACLES) == {"stale_collision_keys", "namespace_issues", "sync_status", "content_chunk_sharing", "greedy_schedule", "swarm_fill"}


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    """Nothing outside the subpackage names it, but for the driver's file."""
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "lodestrand"
    for f in root.rglob("*.py"):
        if f.parent.name != "llm":
            text = f.read_text()
            assert ".llm" not in text and "import llm" not in text, f
