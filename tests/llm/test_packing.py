from __future__ import annotations

import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrand.llm.packing import best_fit, cluster_sweep, fill_report, pack, sweep


def one_by_one(sizes, capacity):
    """Best fit decreasing, item by item."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= s]
        if fits:
            i = min(fits, key=lambda j: gaps[j])
            gaps[i] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=120))
def test_plan(sizes):
    plan = best_fit(dict(Counter(sizes)), 50)
    real = sorted((s for s in sizes if s), reverse=True)
    used = Counter()
    for rank, size in enumerate(real):
        run = max(i for i, r in enumerate(plan.rank) if r <= rank)
        used[plan.first[run] + (rank - plan.rank[run]) // plan.each[run]] += size
    assert plan.sized == len(real) and (not used or max(used.values()) <= 50)
    if real:
        assert set(used) <= set(range(plan.containers))
        assert plan.containers <= one_by_one(sizes, 50) * 1.1 + 1


def placed(spark, rows, capacity=2048):
    return pack(spark.createDataFrame(rows, "doc_id long, n long, container string"), "doc_id", "n", capacity).collect()


def test_every_piece_has_a_place(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 0, 1, 2048, 2049, 5000, *(rng.randrange(1, 2100) for _ in range(8))]), "x") for i in range(2000)]
    rows += [(5, 700, "x"), (5, 700, "x"), (None, 3, "x")]
    out = placed(spark, rows)
    total = defaultdict(int)
    for r in out:
        total[r["container"]] += r["n_tokens"]
    assert max(total.values()) <= 2048 and sorted(total) == list(range(len(total)))
    want = Counter()
    for d, n, _ in rows:
        n = n or 0
        for p in range(max(1, -(-n // 2048))):
            want[d, p, min(2048, n - p * 2048)] += 1
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in out) == want
    assert len(total) <= -(-sum(total.values()) // 2048) * 1.02 + 1


def test_one_size_for_a_third_of_all(spark):
    out = placed(spark, [(i, 1000 if i % 3 else 40, "x") for i in range(900)])
    report = fill_report(spark.createDataFrame(out)).first()
    assert report["items"] == 900 and report["containers"] == 300


def test_empty_table_and_only_empty_texts(spark):
    assert placed(spark, [(1, 1, "x")][:0]) == []
    assert [(r["doc_id"], r["n_tokens"], r["container"]) for r in placed(spark, [(1, 0, "x"), (2, None, "x")])] == [(1, 0, 0), (2, 0, 0)]
    assert fill_report(spark.createDataFrame([], "doc_id long, piece long, n_tokens long, container long")).first()["containers"] == 0


def test_sweeps_on_the_cluster_are_the_sweep(spark):
    rng = random.Random(4)
    counts = Counter(min(2048, max(1, int(rng.gauss(900, 500)))) for _ in range(3000))
    here, there = best_fit(counts), best_fit(counts, 2048, cluster_sweep(spark, 2048))
    tokens = sum(s * n for s, n in counts.items())
    assert here.containers == there.containers and here.rounds == there.rounds
    assert sum(counts.values()) == here.sized and here.containers <= one_by_one(list(counts.elements()), 2048) * 1.01
    assert tokens <= here.containers * 2048


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=15), st.lists(st.tuples(st.integers(1, 30), st.integers(1, 5)), max_size=15))
def test_a_sweep_gives_each_its_successor(sizes, gaps):
    """Against documents one by one, largest first, each taking the smallest gap that was there before the round."""
    runs, at = [], {False: 0, True: 0}
    rows = [(s, False, n) for s, n in sizes.items()] + [(g, True, n) for g, n in gaps]
    for value, is_gap, n in sorted(rows, key=lambda r: -r[0]):
        runs.append((value, is_gap, at[is_gap], n))
        at[is_gap] += n
    found, left = sweep(runs)
    free = [[g, c + i, g] for g, is_gap, c, n in runs if is_gap for i in range(n)]
    placed, waiting = {}, 0
    for size, is_gap, first, n in runs:
        if is_gap:
            continue
        for rank in range(first, first + n):
            fits = [f for f in free if f[2] >= size and (f[0] == f[2] or placed.get(("last", f[1])) == size)]
            if not fits:
                waiting += 1
                continue
            best = min(fits, key=lambda f: (f[2], f[0]))
            best[2] -= size
            placed[rank], placed["last", best[1]] = best[0], size
    got = {r + i: g for _, g, r, _, m, k in found for i in range(m * k)}
    assert sum(n for _, is_gap, _, n in left if not is_gap) == waiting
    assert Counter(got.values()) == Counter(v for k, v in placed.items() if not isinstance(k, tuple))
    boxes = [c + i for _, _, _, c, m, _ in found for i in range(m)]
    assert len(boxes) == len(set(boxes))
