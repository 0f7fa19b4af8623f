from __future__ import annotations

import random

import pytest
from lodestrand.functions import display as D
from lodestrand.functions import paths as P
from lodestrand.functions import records as R
from lodestrand.functions.pyfuncs import collision_key, content_chunks, cut_points, seeded_bytes, stream_chunks
from lodestrand.operators import delta, merge, merkle, scan, swarm
from pyspark.sql import functions as F

ROWS = "pass_id long, path string, kind string, size long, content_hash string, readonly boolean, tombstone boolean, version array<struct<replica:string,counter:long>>"
KEYS = ["pass_id", "path"]


def snapshot(spark, rows):
    df = spark.createDataFrame([(1, p, k, 1 if k == "file" else 0, h if k == "file" else None, False, t, list(v)) for p, k, h, t, v in rows], ROWS)
    df = df.withColumn("vv", R.vector(F.col("version"))).drop("version")
    return df.withColumn("vtext", R.vector_text(F.col("vv")))


def made(spark, seed):
    rng = random.Random(seed)
    return snapshot(spark, [(f"d{i % 3}/f{i}.txt", rng.choice(["file", "file", "directory"]), rng.choice("ab"), rng.random() < 0.2, [("a", rng.randrange(1, 3)), ("b", rng.randrange(3))]) for i in range(40) if rng.random() < 0.8])


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


SHOWN = ("path", "kind", "content_hash", "tombstone", "vtext")


def test_merge_is_symmetric_and_idempotent(spark):
    a, b = made(spark, 1), made(spark, 2)
    ab, ab_conflicts = merge.merge(a, b, KEYS)
    ba, ba_conflicts = merge.merge(b, a, KEYS)
    assert listed(ab, *SHOWN) == listed(ba, *SHOWN)
    assert listed(ab_conflicts, *ab_conflicts.columns) == listed(ba_conflicts, *ba_conflicts.columns)
    same, none = merge.merge(a, a, KEYS)
    assert listed(same, *SHOWN) == listed(a, *SHOWN) and none.count() == 0


def test_plan_reaches_its_target(spark):
    a, b = made(spark, 3), made(spark, 4)
    assert merge.actions_to_reach(a, b, KEYS).count() > 0
    assert merge.actions_to_reach(b, b, KEYS).count() == 0
    order = merge.apply_order(merge.actions_to_reach(a, b, KEYS)).orderBy("phase", "rank_depth", "path").collect()
    phases = [r["phase"] for r in order]
    assert phases == sorted(phases)


def test_conflict_copy_and_directory_wins(spark):
    left = snapshot(spark, [("x.tar.gz", "file", "a", False, [("a", 2)]), ("y", "directory", None, False, [("a", 2)]), ("z", "file", "a", True, [("a", 1)])])
    right = snapshot(spark, [("x.tar.gz", "file", "b", False, [("b", 1)]), ("y", "file", "q", False, [("b", 1)]), ("z", "file", "a", False, [("b", 1)])])
    records, conflicts = merge.merge(left, right, KEYS)
    by = {r["path"]: r for r in conflicts.collect()}
    assert all(r["reason"] == "concurrent_edit" for r in by.values())
    assert by["x.tar.gz"]["conflict_path"].startswith("x.tar.conflict-") and by["x.tar.gz"]["conflict_path"].endswith(".gz")
    kinds = {r["path"]: r["kind"] for r in records.collect()}
    assert kinds["y"] == "directory" and kinds[by["y"]["conflict_path"]] == "file"
    assert all("resolver=1" in r["vtext"] for r in records.collect())


def test_conflict_name_avoids_what_is_taken(spark):
    left = snapshot(spark, [("x", "file", "a", False, [("a", 2)])])
    right = snapshot(spark, [("x", "file", "b", False, [("b", 1)])])
    first = merge.merge(left, right, KEYS)[1].first()["conflict_path"]
    taken = snapshot(spark, [("x", "file", "a", False, [("a", 2)]), (first, "file", "c", False, [("a", 1)])])
    second = merge.merge(taken, right, KEYS)[1].first()["conflict_path"]
    assert second != first and len(second) == len(first) + 4


def test_absent_row_is_no_deletion(spark):
    a, none = made(spark, 5), snapshot(spark, [("q", "file", "a", False, [("a", 1)])]).limit(0)
    assert {r["outcome"] for r in merge.outcomes(a, none, KEYS).collect()} == {"left_only"}


@pytest.mark.parametrize(
    ("path", "issue"),
    [("a/b.txt", None), ("", "empty"), ("/a", "not_relative"), ("a\\b", "not_relative"), ("a//b", "component"), ("a/./b", "component"), ("a/..", "component"), ("a.", "component"), ("a ", "component"), ("a/b?c", "component"),
     ("a/" + "n" * 256, "component_too_long"), ("é" * 200, "component_too_long"), ("CON", "reserved"), ("x/con.txt", "reserved"), ("lpt1", "reserved"), ("COM²", "reserved"), ("com10", None), ("a/" * 2500 + "b", "too_long"), ("a\tb", "component")],
)
def test_path_rules(spark, path, issue):
    assert spark.createDataFrame([(path,)], "p string").select(P.path_issue(F.col("p"))).first()[0] == issue


def test_path_functions(spark):
    df = spark.createDataFrame([("docs/a/b.tar.gz", 3), ("x", 1), (".hidden", 2), ("é€😀", 4)], "p string, n int")
    got = df.select("p", P.ancestors(F.col("p")).alias("a"), P.ancestors(F.col("p"), True).alias("pa"), P.stem(P.name(F.col("p"))).alias("s"), P.extension(P.name(F.col("p"))).alias("e"), P.truncate_utf8(F.col("p"), F.col("n")).alias("t")).collect()
    by = {r["p"]: r for r in got}
    assert by["docs/a/b.tar.gz"]["a"] == ["docs", "docs/a", "docs/a/b.tar.gz"] and by["x"]["pa"] == []
    assert (by["docs/a/b.tar.gz"]["s"], by["docs/a/b.tar.gz"]["e"]) == ("b.tar", ".gz") and by[".hidden"]["e"] == ""
    assert by["é€😀"]["t"] == "é" and by["docs/a/b.tar.gz"]["t"] == "doc"
    sib = spark.createDataFrame([("docs",), ("docs-old",), ("docs/x",), ("docs.txt",)], "path string")
    assert sorted(r[0] for r in merkle.subtree(sib, "docs").collect()) == ["docs", "docs/x"]
    assert sorted(r[0] for r in sib.where(P.under(F.col("path"), F.lit("docs"))).collect()) == ["docs", "docs/x"]


def test_vectors(spark):
    v = "array<struct<replica:string,counter:long>>"
    df = spark.createDataFrame([([("a", 1)], [("A ", 1), ("b", 0)], "equal"), ([("a", 1)], [("a", 2)], "before"), ([("a", 2), ("b", 1)], [("a", 2)], "after"), ([("a", 1)], [("b", 1)], "concurrent"), ([], None, "equal"), ([("a", 1), ("a", 3)], [("a", 3)], "equal")], f"l {v}, r {v}, want string")
    df = df.withColumn("x", R.vector(F.col("l"))).withColumn("y", R.vector(F.col("r")))
    for r in df.select(R.relation(F.col("x"), F.col("y")).alias("got"), "want", R.vector_text(R.incremented(F.col("x"), "me")).alias("inc")).collect():
        assert r["got"] == r["want"] and r["inc"].endswith("me=1")


def test_merkle_roots_and_differences(spark):
    rows = [(1, f"d{i % 4}/s{i % 3}/f{i}", f"h{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "g int, path string, h string")
    tree = merkle.nodes(df, ["g"], F.col("h"))
    root = tree.where("depth = 0").first()
    assert root["record_count"] == 60
    shuffled = merkle.nodes(spark.createDataFrame(rows[::-1], df.schema).repartition(3), ["g"], F.col("h"))
    assert shuffled.where("depth = 0").first()["hash"] == root["hash"]
    other = spark.createDataFrame([(g, p, "changed" if p.endswith("f7") else h) for g, p, h in rows if not p.endswith("f9")], df.schema)
    diff = merkle.differing(tree, merkle.nodes(other, ["g"], F.col("h")), ["g"])
    assert sorted(r["path"] for r in diff.collect()) == ["d1/s0/f9", "d3/s1/f7"]
    assert merkle.differing(tree, shuffled, ["g"]).count() == 0
    kids = merkle.children(tree, ["g"]).withColumnRenamed("parent", "prefix")
    from pyspark.sql import Window

    kids = kids.withColumn("ordinal", F.row_number().over(Window.partitionBy("g", "prefix").orderBy("name")) - 1)
    told = tree.select("g", "prefix", F.when(F.col("own_hash").isNotNull(), F.col("prefix")).alias("record_path"), "record_count")
    assert merkle.summary_issues(told, kids, ["g"]).count() == 0
    assert {r["issue"] for r in merkle.summary_issues(told.withColumn("record_count", F.col("record_count") + 1), kids, ["g"]).collect()} == {"count"}
    assert "order" in {r["issue"] for r in merkle.summary_issues(told, kids.withColumn("ordinal", -F.col("ordinal")), ["g"]).collect()}
    parts = merkle.reconstruct(df, other, tree, merkle.nodes(other, ["g"], F.col("h")), ["g"])
    assert sorted(map(tuple, parts.select(*df.columns).collect())) == sorted(map(tuple, other.collect()))
    assert 0 < parts.where("origin = 'fetched'").count() < 20
    want = merkle.roots(other, ["g"], F.col("h"))
    assert merkle.checked_snapshot(parts, ["g"], F.col("h"), want).count() == 1
    with pytest.raises(Exception, match="expected"):
        merkle.checked_snapshot(df, ["g"], F.col("h"), want).collect()


def test_a_directory_of_a_million_entries(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("g"), F.concat(F.lit("d/f"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").alias("h"))
    counts = {r["prefix"]: r["record_count"] for r in merkle.nodes(rows, ["g"], F.col("h")).where("depth < 2").collect()}
    assert counts == {"": 1_000_000, "d": 1_000_000}


def test_content_chunks(spark):
    data = seeded_bytes(1, "x", 40_000)
    ends = cut_points(data, 64, 256, 1024)
    assert ends[-1] == len(data) and ends == cut_points(data, 64, 256, 1024)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert max(sizes) <= 1024 and min(sizes[:-1]) >= 64
    moved = data[:500] + b"inserted bytes" + data[500:]
    df = spark.createDataFrame([("a", data), ("b", moved), ("e", b""), ("n", None)], "path string, content binary")
    chunks = content_chunks(df, profile=(64, 256, 1024))
    a, b = ({r["hash"] for r in chunks.where(F.col("path") == p).collect()} for p in "ab")
    assert len(a & b) > 0.8 * len(a)
    assert {r["path"] for r in chunks.collect()} == {"a", "b"}


def _plain_cuts(data, low, mean, high):
    """The rolling hash byte by byte."""
    import hashlib

    gear = [int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)]
    bits = max(1, mean.bit_length() - 1)
    hard, easy = ((1 << (bits + 1)) - 1) << 16, ((1 << max(1, bits - 1)) - 1) << 16
    ends, start = [], 0
    while len(data) - start > low:
        end = min(start + high, len(data))
        rolled = 0
        for i in range(max(0, start + low - 63), end):
            rolled = ((rolled << 1) + gear[data[i]]) % (1 << 64)
            if i >= start + low and not rolled & (hard if i < start + mean else easy):
                end = i + 1
                break
        ends.append(end)
        start = end
    return [*ends, len(data)] if start < len(data) else ends


def test_cuts_are_the_rolling_hashs(spark):
    import io

    files = {f"f{n}": seeded_bytes(n, "cut", size) for n, size in enumerate((0, 1, 63, 64, 65, 300, 1024, 5000, 40_000))}
    want = {p: _plain_cuts(d, 64, 256, 1024) if d else [] for p, d in files.items()}
    rows = content_chunks(spark.createDataFrame(list(files.items()), "path string, content binary").coalesce(1), profile=(64, 256, 1024)).orderBy("path", "idx").collect()
    got = {p: [r["chunk_offset"] + r["length"] for r in rows if r["path"] == p] for p in files}
    assert got == want
    for p, d in files.items():
        streamed = list(stream_chunks(io.BytesIO(d).read, (64, 256, 1024)))
        assert [o + n for o, n, _ in streamed] == want[p] and [h for *_, h in streamed] == [r["hash"] for r in rows if r["path"] == p]


def test_delta_counts_extents_and_hashes(spark):
    ext = spark.createDataFrame([("f", 0, 0, 10, "a"), ("f", 1, 10, 5, "b"), ("f", 2, 15, 10, "a"), ("f", 3, 25, 7, "c"), ("f", 4, 32, 7, "c")], "path string, idx int, chunk_offset long, length long, hash string")
    have = spark.createDataFrame([("a",)], "hash string")
    r = delta.delta_plan(ext, have).first()
    assert (r["missing"], r["transfer_bytes"], r["reused_extents"]) == (2, 12, 2)
    assert delta.manifest_issues(ext, 100).count() == 0
    bad = spark.createDataFrame([("f", 0, 0, 10, "a"), ("f", 2, 11, 0, "a")], ext.schema)
    assert {x["issue"] for x in delta.manifest_issues(bad, 9).collect()} == {"gap", "empty_chunk", "chunk_too_long", "index_gap", "length_differs"}


def test_schedule_keeps_its_limits(spark):
    jobs = spark.createDataFrame([(0, i) for i in range(200)] + [(0, 999)], "job long, hash long")
    avail = spark.createDataFrame([(p, i) for p in range(20) for i in range(200) if (p + i) % 3], "peer long, hash long")
    peers = spark.createDataFrame([(p, 10 * p, 0, 1, 0) for p in range(20)], "peer long, rtt_ms long, queued_bytes long, goodput_bps long, failure_penalty long")
    limits = swarm.Limits(4, 5, 18)
    rows = swarm.greedy_schedule(jobs, avail, peers, limits).collect()
    used = {}
    for r in rows:
        used[r["peer"]] = used.get(r["peer"], 0) + 1
    assert len(rows) == 18 and len(used) <= 4 and max(used.values()) <= 5 and 999 not in {r["hash"] for r in rows}


def test_copy_names_beyond_64_serials(spark):
    loser = "ab" * 32
    conflicts = spark.createDataFrame([("p", "dir/a.txt", loser, True), ("p", "b.txt", loser, True)], "pass_id string, path string, loser_hash string, kept boolean")

    def occupied(serials):
        tokens = [loser[:n] for n in merge.TOKEN_LENGTHS] + [f"{loser}-{i}" for i in range(1, serials + 1)]
        rows = spark.createDataFrame([("p", "dir/a.txt", t) for t in tokens], "pass_id string, path string, t string")
        return rows.select("pass_id", P.conflict_path(F.col("path"), F.col("t")).alias("path"))

    got = {r["path"]: r["conflict_path"] for r in merge.name_copies(conflicts, occupied(70), KEYS).collect()}
    assert got == {"dir/a.txt": f"dir/a.conflict-{loser}-71.txt", "b.txt": f"b.conflict-{loser[:12]}.txt"}
    with pytest.raises(Exception, match="no name is free"):
        merge.name_copies(conflicts, occupied(10_000), KEYS).collect()


def test_rarest_order_holds_every_hash(spark):
    missing = spark.createDataFrame([(h,) for h in range(500)], "hash long")
    avail = spark.createDataFrame([(p, h) for h in range(500) for p in range(h * 7 % 5)], "peer long, hash long")
    got = [(r["hash"], r["providers"], r["rank"]) for r in swarm.rarest_order(missing, avail).orderBy("rank").collect()]
    assert got == [(h, h * 7 % 5, i) for i, h in enumerate(sorted(range(500), key=lambda h: (h * 7 % 5, h)), 1)]


def _plain_schedule(missing, avail, peers, limits):
    """The rule as one loop over all hashes of one job."""
    holders = {}
    for p, h in avail:
        holders.setdefault(h, []).append(p)
    used, rows = {}, []
    for h in sorted(missing, key=lambda h: (len(holders.get(h, ())), h)):
        if len(rows) >= limits.max_assignments:
            break
        able = [(peers[p] + used.get(p, 0), used.get(p, 0), p) for p in holders.get(h, ()) if used.get(p, 0) < limits.max_chunks_per_peer and (p in used or len(used) < limits.max_sources)]
        if able:
            p = min(able)[2]
            used[p] = used.get(p, 0) + 1
            rows.append((h, p))
    return rows


def test_schedule_goes_through_all_hashes(spark):
    limits = swarm.Limits(2, 8, 12)
    peers = {p: (p * 13) % 17 for p in range(40)} | {99: 500}
    sets = {
        # the two sources hold none of the next hundred hashes, but many later ones
        0: [(0, 0), (1, 1)] + [(2 + h % 30, h) for h in range(2, 102)] + [(p, h) for h in range(200, 300) for p in (0, 3)] + [(p, h) for h in range(400, 420) for p in (1, 2, 3)],
        # the only source with room is dearer than all other providers of a hash
        1: [(99, 0), (99, 1), (0, 2)] + [(p, h) for h in range(3, 30) for p in [*range(1, 40), 99]],
        # as they come
        2: [(p, h) for h in range(500) for p in range(40) if (p * 31 + h * h * 7) % 97 < 1 + h % 9],
        # nothing is left after a few
        3: [(0, h) for h in range(80)] + [(1, h) for h in range(20)],
    }
    jobs = spark.createDataFrame([(j, h + 1000 * j) for j, held in sets.items() for h in {h for _, h in held}], "job long, hash long")
    avail = spark.createDataFrame([(p, h + 1000 * j) for j, held in sets.items() for p, h in held], "peer long, hash long")
    costs = spark.createDataFrame([(p, c, 0, 1, 0) for p, c in peers.items()], "peer long, rtt_ms long, queued_bytes long, goodput_bps long, failure_penalty long")
    got = {}
    for r in swarm.greedy_schedule(jobs, avail, costs, limits).orderBy("job", "seq").collect():
        got.setdefault(r["job"], []).append((r["hash"] - 1000 * r["job"], r["peer"]))
        assert r["seq"] == len(got[r["job"]]) - 1
    assert got == {j: _plain_schedule({h for _, h in held}, held, peers, limits) for j, held in sets.items()}
    assert swarm.greedy_schedule(jobs, avail, costs, swarm.Limits(0, 8, 12)).count() == 0


def test_retries_and_counters(spark):
    events = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, False, True, True, True])], "k int, t int, bad boolean")
    got = [(r["t"], r["attempts"], r["delay_ms"]) for r in scan.failure_runs(events, "k", ["t"], F.col("bad")).orderBy("t").collect()]
    assert got == [(0, 1, 500), (1, 2, 1000), (3, 1, 500), (4, 2, 1000), (5, 3, 2000)]
    ch = spark.createDataFrame([("f", p, c, to, v) for p, c, to, v in (("b", "deleted", None, 3), ("zz", "created", None, 0), ("aa", "modified", None, 40), ("a", "deleted", None, 1), ("old", "renamed", "bb", 7), ("q", "unchanged", None, 99))], "folder string, path string, change string, to_path string, version long")
    got = [(r["path"], r["counter"]) for r in scan.counter_assignment(ch, ["folder"], F.lit(10)).orderBy("counter").collect()]
    assert got == [("aa", 41), ("old", 42), ("zz", 43), ("a", 44), ("b", 45)]


def test_collision_keys(spark):
    df = spark.createDataFrame([("Straße/ÅB",), ("STRASSE/Åb",), (None,), ("",)], "p string")
    got = [r[0] for r in df.select(collision_key("p")).collect()]
    assert got[0] == got[1] and got[2] is None and got[3] == ""


def test_display(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 << 40,)], "n long")
    got = [r[0] for r in df.select(D.format_bytes(F.col("n"))).collect()]
    assert got == ["0 bytes", "1023 bytes", "1.0 KiB (1024 bytes)", "1.5 KiB (1536 bytes)", f"5.0 TiB ({5 << 40} bytes)"]


def test_bytes_of_any_size(spark, tmp_path):
    """Ties go to even, sizes go beyond a bigint, the query's greatest unit is its SQL's."""
    from decimal import Decimal

    from lodestrand.plans.catalogue import QUERIES

    def plain(n, units):
        amount, unit = float(n), ""
        for unit in units:
            amount /= 1024
            if amount < 1024:
                break
        return f"{n} bytes" if n < 1024 else f"{amount:.1f} {unit} ({n} bytes)"

    sizes = [1280, 1792, 1023 * 1024 + 998, 1024**2 - 1, 163840000, 4503599680913408, 2**53 + 1, 2**60 - 1, 2**63, 2**64 - 1] + [37**k + k for k in range(12)]
    df = spark.createDataFrame([(i, Decimal(n)) for i, n in enumerate(sizes)], "i int, n decimal(38,0)")
    assert [r[0] for r in df.orderBy("i").select(D.format_bytes(F.col("n"))).collect()] == [plain(n, ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")) for n in sizes]
    parts = [(k, s) for k in (0, 1, 5, 10, 16, 320, 704, 5399, 19999, 1096302, 1096303, 1199999, 36000000) for s in (1, 6, 7, 50)]
    spark.createDataFrame([(100 * k + s, k, s) for k, s in parts], "i long, p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, QUERIES["format_bytes"](spark, str(tmp_path)).collect()))
    assert got == sorted((k, plain(k**3 * (s % 7 + 1), ("KiB", "MiB", "GiB"))) for k, s in parts)
    assert df.select(D.format_bytes(F.lit(None).cast("bigint")).alias("x")).first()["x"] is None


def test_linked_folders(spark, monkeypatch):
    """Repeated and null ids, devices of several endpoints, null lists; the pairs, as many as the square, aren't put through an aggregation."""
    from lodestrand.operators import dashboard

    monkeypatch.setattr(dashboard, "LINKED", 4, raising=False)
    rng = random.Random(3)
    end = lambda: rng.choice([None, "a", "a", "a", "b", "c", "d"])
    devices = [(rng.choice([None, *range(30)]), end()) for _ in range(45)] + [(100, "b"), (100, "a"), (101, None)]
    folders = [(rng.choice([None, *range(40)]), rng.choice([None, 3, 7, 100, 101, 999]), end(), rng.choice([None, [], [end()], [end(), end(), end()]])) for _ in range(60)]
    got = dashboard.linked_folders(spark.createDataFrame(devices, "id long, endpoint string"), spark.createDataFrame(folders, "id long, device_id long, peer_endpoint string, allowed_peers array<string>"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    want = {(d, f) for f, of, peer, allowed in folders for d, e in devices if (d is not None and of == d) or (e is not None and (peer == e or e in (allowed or [])))}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want and {None, 100, 101} <= {d for d, _ in rows}
    assert 0 <= plan.find("Union") < plan.find("Aggregate"), plan
    assert dashboard.linked_folders(spark.createDataFrame([], "id long, endpoint string"), spark.createDataFrame(folders, "id long, device_id long, peer_endpoint string, allowed_peers array<string>")).count() == 0


def test_numbers_over_many_files(spark):
    from lodestrand.operators.ranking import number_rows

    rows = [(g, (i * 37) % 500) for g in ("a", None) for i in range(500)] + [("tiny", 1)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = {(r["g"], r["v"]): r["n"] for r in number_rows(df, ["g"], ["v"], "n").collect()}
    assert len(got) == 1001 and all(n == (1 if g == "tiny" else v + 1) for (g, v), n in got.items())
    assert number_rows(df.limit(0), ["g"], ["v"], "n").count() == 0


SCAN = "folder string, snap_no int, path string, kind string, id_namespace long, id_object long, size long, modified_ns decimal(38,0), readonly boolean, content_hash string, tombstone boolean, version long"
STEP = ["folder", "snap_no", "path"]


def scanned(spark, rows):
    """rows: (path, object, content, tombstone, version)"""
    from decimal import Decimal

    return spark.createDataFrame([("f", 2, p, "file", 1 if o else None, o, 1, Decimal(5), False, h, t, v) for p, o, h, t, v in rows], SCAN)


def test_deletions_keep_what_could_not_be_read(spark):
    before = scanned(spark, [(p, None, "h", False, 0) for p in ("a", "b", "dir/c", "dir/sub/d", "dir-old")] + [("moved", 7, "h", False, 0), ("dir/m", 8, "h", False, 0), ("dead", None, "h", True, 0)])
    after = scanned(spark, [("a", None, "h", False, 0), ("b", None, "h", True, 0), ("new", 7, "h", False, 0), ("m", 8, "h", False, 0)])
    unread = spark.createDataFrame([("f", 2, "dir")], "folder string, snap_no int, prefix string")
    changes = scan.scan_changes(before, after, STEP, unread)
    assert sorted(r["path"] for r in scan.deletions(changes, STEP).collect()) == ["b", "dir-old"]
    assert sorted(tuple(r) for r in changes.where("change = 'renamed'").select("path", "to_path").collect()) == [("moved", "new")]
    assert sorted(r["path"] for r in changes.where("change = 'preserved'").collect()) == ["dir/c", "dir/m", "dir/sub/d"]


def _plain_scan(before, after, base):
    """The rule as loops over two dictionaries path -> (object, content, tombstone, version): changes with counters, and the next index."""
    now = {p: v for p, v in after.items() if not v[2]}
    alike = lambda a, b: a[:2] == b[:2]
    old, new = {}, {}
    for p, v in before.items():
        if not v[2] and p not in now and v[0]:
            old.setdefault(v[0], []).append(p)
    for p, v in now.items():
        if not (p in before and not before[p][2]) and v[0]:
            new.setdefault(v[0], []).append(p)
    moved = {new[o][0]: ps[0] for o, ps in old.items() if len(ps) == 1 and len(new.get(o, ())) == 1 and alike(before[ps[0]], now[new[o][0]])}
    counter, changes, index = base, [], {p: (v[1], v[2], v[3]) for p, v in before.items()}
    for p in sorted(now):
        if p in before and not before[p][2] and alike(before[p], now[p]):
            continue
        source = moved.get(p, p)
        counter = max(counter, before[source][3] if source in before else 0) + 1
        if p in moved:
            changes.append((source, "renamed", p, counter))
            index[source] = (before[source][1], True, counter)
        else:
            changes.append((p, "modified" if p in before and not before[p][2] else "created", None, counter))
        index[p] = (now[p][1], False, counter)
    for p in sorted(before):
        if not before[p][2] and p not in now and p not in moved.values():
            counter = max(counter, before[p][3]) + 1
            changes.append((p, "deleted", None, counter))
            index[p] = (before[p][1], True, counter)
    return changes, index


@pytest.mark.parametrize("seed", range(3))
def test_a_scan_against_loops(spark, seed):
    rng = random.Random(seed)
    row = lambda: (rng.choice([None, *range(1, 25)]), rng.choice("abc"), rng.random() < 0.2, rng.randrange(40))
    before = {f"p{i:02d}": row() for i in range(40) if rng.random() < 0.7}
    after = {p: v if rng.random() < 0.4 else row() for p, v in before.items() if rng.random() < 0.7}
    for p, v in before.items():
        if p not in after and rng.random() < 0.6:
            after["m" + p] = (*v[:2], False, 0)
    changes, index = _plain_scan(before, after, 11)
    frames = [scanned(spark, [(p, *v) for p, v in d.items()]) for d in (before, after)]
    numbered = scan.counter_assignment(scan.scan_changes(*frames, STEP), STEP[:2], F.lit(11))
    assert sorted(map(tuple, numbered.select("path", "change", "to_path", "counter").collect()), key=lambda r: r[3]) == changes
    got = {r["path"]: (r["content_hash"], r["tombstone"], r["version"]) for r in scan.next_records(*frames, numbered, STEP).collect()}
    assert got == index


def test_a_scan_that_is_not_safe_raises(spark):
    none = spark.createDataFrame([], "path string")
    one = spark.createDataFrame([("a",)], "path string")
    assert scan.scan_gate(none, none, none, "local").first()["safe"]
    for three in ((one, none, none), (none, one, none), (none, none, one)):
        with pytest.raises(Exception, match="local scan"):
            scan.scan_gate(*three, "local").collect()


def test_namespace_issues(spark):
    rows = snapshot(spark, [("a", "file", "x", False, []), ("a/b", "file", "x", False, []), ("Dir/x", "file", "x", False, []), ("dir/y", "file", "x", False, []), ("s", "symlink", None, False, []), ("S", "symlink", None, True, []), ("gone", "directory", None, True, []), ("gone/x", "file", "x", False, [])])
    got = sorted((r["path"], r["issue"]) for r in merge.namespace_issues(rows, KEYS, collision_key("path")).collect())
    assert got == [("Dir", "collision"), ("a/b", "ancestor"), ("dir", "collision"), ("gone/x", "ancestor"), ("s", "kind")]
    assert sorted(r["path"] for r in merge.missing_ancestors(rows, KEYS).collect()) == ["Dir", "a", "dir", "gone"]
