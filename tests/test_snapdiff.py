from __future__ import annotations

import random

import pytest
from lodestrand.operators.snapdiff import snapshot_changes

SCHEMA = "folder string, snap_no int, path string, collision_key string, kind string, id_namespace long, id_object long, size long, content_hash string, tombstone boolean, generation long"


def row(folder, snap, path, kind="file", ns=1, obj=None, h="a", tomb=False, gen=1):
    return (folder, snap, path, None, kind, ns, obj, 1, h, tomb, gen)


def brute(rows):
    best = {}
    for f, s, p, _, kind, ns, obj, _, h, tomb, gen in rows:
        if None in (f, s, p):
            continue
        h = h.strip().lower() if h is not None else None
        key = (gen is not None, gen or 0, not tomb, kind or "", h or "", ns or 0, obj or 0)
        if (f, s, p) not in best or key > best[f, s, p][0]:
            best[f, s, p] = (key, (kind, h, ns, obj), bool(tomb))
    snaps = {}
    for (f, s, p), (_, state, tomb) in best.items():
        snaps.setdefault(f, {}).setdefault(s, {})
        if not tomb:
            snaps[f][s][p] = state
    out = set()
    for f, by in snaps.items():
        for a, b in zip(sorted(by), sorted(by)[1:], strict=False):
            old, new = by[a], by[b]
            gone, came = {p: old[p] for p in old.keys() - new.keys()}, {p: new[p] for p in new.keys() - old.keys()}
            ident = lambda v: None if v[2] is None or v[3] is None else (v[0], v[2], v[3])
            taken = set()
            for p, v in gone.items():
                i = ident(v)
                ps = [q for q, x in gone.items() if ident(x) == i]
                qs = [q for q, x in came.items() if ident(x) == i]
                if i is not None and len(ps) == len(qs) == 1 and came[qs[0]][1] == v[1]:
                    out.add((f, b, p, "renamed", qs[0]))
                    taken |= {p, qs[0]}
            out |= {(f, b, p, "removed", "") for p in gone if p not in taken} | {(f, b, p, "added", "") for p in came if p not in taken}
            for p in old.keys() & new.keys():
                x, y = old[p], new[p]
                known = None not in (x[2], x[3], y[2], y[3])
                if x[:2] != y[:2] or (known and x[2:] != y[2:]):
                    out.add((f, b, p, "changed", ""))
    return out


def run(spark, rows, schema=SCHEMA, **kw):
    return {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, schema), **kw).collect()}


def test_kinds_of_change(spark):
    rows = [
        row("f", 1, "a", obj=1), row("f", 1, "b", obj=2, h="B "), row("f", 1, "c", obj=3), row("f", 1, "d", obj=None), row("f", 1, "t", tomb=True),
        row("f", 3, "a2", obj=1), row("f", 3, "b", obj=2, h="b"), row("f", 3, "c", obj=3, h="z"), row("f", 3, "c", obj=3, h="y", gen=0), row("f", 3, "t", obj=9),
        row("g", 1, "only"), row(None, 1, "x"), row("f", None, "x"), row("f", 3, None),
    ]
    assert run(spark, rows) == {("f", 3, "a", "renamed", "a2"), ("f", 3, "c", "changed", ""), ("f", 3, "d", "removed", ""), ("f", 3, "t", "added", "")}


def test_snapshot_of_tombstones_exists(spark):
    rows = [row("f", 1, "a"), row("f", 2, "a", tomb=True), row("f", 3, "a")]
    assert run(spark, rows) == {("f", 2, "a", "removed", ""), ("f", 3, "a", "added", "")}


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == set()
    rows = [(*row("f", 1, "a"), 1, True), (*row("f", 2, "b"), 2, None)]
    assert run(spark, rows, SCHEMA + ", pos int, cut boolean") == {("f", 2, "a", "removed", ""), ("f", 2, "b", "added", "")}


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for f in ("f", "g"):
        for s in rng.sample(range(1, 7), 4):
            for _ in range(120):
                rows.append(row(f, s, f"p{rng.randrange(90)}", rng.choice(["file", "directory", None]), rng.choice([1, None]), rng.choice([None, *range(40)]), rng.choice(["a", "b", None]), rng.random() < 0.1, rng.choice([None, 1, 2])))
    assert run(spark, rows, chunk_paths=4, partitions=3) == brute(rows)


def test_long_run_without_a_cut(spark):
    rows = [row("f", s, "p" * 3000 + str(i), obj=i) for s in (1, 2) for i in range(40) if not (s == 2 and i == 7)]
    assert run(spark, rows, chunk_paths=1_000_000) == {("f", 2, "p" * 3000 + "7", "removed", "")}
