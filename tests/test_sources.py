from __future__ import annotations

import hashlib
import os

import pytest
from lodestrand.sources import files, tables


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "my root"
    for name, text in {"a.txt": "x", "docs/b+c.md": "yy", "docs/deep/ü.bin": "", "inbox/no.txt": "n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_scan_and_incremental_scan(spark, tree):
    first = files.scan_directory(spark, os.fspath(tree), ignored=["inbox"])
    rows = {r["path"]: r for r in first.collect()}
    assert set(rows) == {"a.txt", "docs", "docs/b+c.md", "docs/deep", "docs/deep/ü.bin"}
    assert rows["docs/b+c.md"]["content_hash"] == hashlib.sha256(b"yy").hexdigest() and rows["docs"]["kind"] == "directory"
    (tree / "link").symlink_to("docs")
    (tree / "bad?name").write_text("q")
    odd = {r["path"]: (r["kind"], r["issue"]) for r in files.scan_directory(spark, os.fspath(tree), ["inbox", "docs"]).collect()}
    assert odd == {"a.txt": ("file", None), "link": ("symlink", None), "bad?name": ("file", "component")}
    (tree / "link").unlink()
    (tree / "bad?name").unlink()
    known = spark.createDataFrame([(r["path"], r["size"], r["modified_ns"], "stored") for r in rows.values() if r["kind"] == "file"], "path string, size long, modified_ns decimal(38,0), content_hash string")
    (tree / "a.txt").write_text("changed")
    again = {r["path"]: r["content_hash"] for r in files.scan_directory(spark, os.fspath(tree), ["inbox"], known).collect() if r["kind"] == "file"}
    assert again == {"a.txt": hashlib.sha256(b"changed").hexdigest(), "docs/b+c.md": "stored", "docs/deep/ü.bin": "stored"}


def test_json_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    out = os.fspath(tmp_path / "j")
    files.write_json(df, out)
    files.write_json(df, out, append=True)
    assert files.read_json(spark, out, "id long, name string").count() == 2
    (tmp_path / "s.csv").write_text("# comment\nphase,ms\nbefore,1.5\n")
    assert [tuple(r) for r in files.read_samples(spark, os.fspath(tmp_path / "s.csv"), "phase string, ms double").collect()] == [("before", 1.5)]


def test_snapshots(spark, tmp_path):
    t = tables.SnapshotTable(spark, os.fspath(tmp_path / "snap"), ["path"])
    assert t.read() is None
    rows = spark.createDataFrame([("b", 1), ("a", 2)], "path string, n int")
    assert t.commit(rows) == 1 and t.commit(rows.where("n = 1")) == 2
    assert t.read().count() == 1 and t.read(1).count() == 2 and t.versions() == [1, 2]
    with pytest.raises(ValueError, match="two rows"):
        t.commit(rows.unionByName(rows))


def test_keyed_table(spark, tmp_path):
    t = tables.KeyedTable(spark, os.fspath(tmp_path / "kv"), "id", "id string, state string")
    t.put(spark.createDataFrame([("a", "one"), ("b", "one")], "id string, state string"), 1)
    t.put(spark.createDataFrame([("a", "two")], "id string, state string"), 2)
    assert {r["id"]: r["state"] for r in t.all().collect()} == {"a": "two", "b": "one"}
    assert [r["state"] for r in t.get("a").collect()] == ["two"] and t.get("z").count() == 0


def test_chunk_store(spark, tmp_path):
    store = tables.ChunkStore(spark, os.fspath(tmp_path / "cas"))
    rows = [(hashlib.sha256(c).hexdigest(), c) for c in (b"a", b"b", b"a")]
    df = spark.createDataFrame(rows, "hash string, content binary")
    assert store.put(df) == 2 and store.put(df) == 0
    assert {bytes(r["content"]) for r in store.get(df, 10).collect()} == {b"a", b"b"} and store.get(df, 0).count() == 0
    with pytest.raises(Exception, match="what its hash says"):
        store.put(spark.createDataFrame([("00" * 32, b"x")], df.schema))


def test_manifest_cache(spark):
    wanted = spark.createDataFrame([("a", 1, None), ("b", 1, 2)], "path string, size int, modified int")
    cache = spark.createDataFrame([("a", 1, None, "m"), ("b", 9, 2, "m")], "path string, size int, modified int, manifest_hash string")
    assert {r["path"]: r["manifest_hash"] for r in tables.cached_manifests(wanted, cache, ["size", "modified"]).collect()} == {"a": "m", "b": None}


def test_levels_give_the_same_listing(spark, tree):
    (tree / "docs/deep/er/still").mkdir(parents=True)
    (tree / "docs/deep/er/still/z.txt").write_text("z")
    (tree / "docs/closed").mkdir()
    whole = sorted(map(tuple, files.list_directory(spark, os.fspath(tree), ["inbox"]).collect()))
    for levels in (2, 3, 9):
        assert sorted(map(tuple, files.list_directory(spark, os.fspath(tree), ["inbox"], levels).collect())) == whole
    assert files.compare_trees(*(files.scan_directory(spark, os.fspath(tree)) for _ in range(2))).count() == 0
    now = files.scan_directory(spark, os.fspath(tree))
    before = spark.createDataFrame(now.collect(), now.schema)
    (tree / "a.txt").write_text("other")
    assert sorted((r["side"], r["path"]) for r in files.compare_trees(before, files.scan_directory(spark, os.fspath(tree))).collect()) == [("left", "a.txt"), ("right", "a.txt")]


def test_a_directory_as_a_stream(spark, tree, tmp_path):
    spark.dataSource.register(files.DirectorySource)
    reader = files.DirectoryChanges(os.fspath(tree), ["inbox"])
    rows, offset = reader.read(reader.initialOffset())
    assert sorted(r[0] for r in rows) == ["a.txt", "docs/b+c.md", "docs/deep/ü.bin"]
    assert list(reader.read(offset)[0]) == []
    (tree / "docs/new.txt").write_text("n")
    os.utime(tree / "docs/new.txt", ns=(offset["ns"], offset["ns"]))  # at the same instant as the last one
    again, later = reader.read(offset)
    assert [r[0] for r in again] == ["docs/new.txt"] and [r[0] for r in reader.readBetweenOffsets(offset, later)] == ["docs/new.txt"]
    stream = spark.readStream.format("directory").option("path", os.fspath(tree)).load()
    query = stream.writeStream.format("memory").queryName("seen_files").option("checkpointLocation", os.fspath(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert {r["path"] for r in spark.table("seen_files").collect()} >= {"a.txt", "docs/new.txt", "inbox/no.txt"}
    finally:
        query.stop()


def test_browse(spark, tree):
    (tree / "docs/private/x").mkdir(parents=True)
    assert [tuple(r) for r in files.browse(spark, os.fspath(tree)).collect()] == [("docs", "docs"), ("inbox", "inbox")]
    assert [r["name"] for r in files.browse(spark, os.fspath(tree), "docs", ["docs/private"]).collect()] == ["deep"]
    with pytest.raises(PermissionError):
        files.browse(spark, os.fspath(tree), "docs/private/x", ["docs/private"])


def test_files_are_chunked_from_disk(spark, tree):
    from lodestrand.functions.pyfuncs import content_chunks, seeded_bytes

    data = seeded_bytes(3, "disk", 9000)
    (tree / "big.bin").write_bytes(data)
    found = files.list_directory(spark, os.fspath(tree)).where("kind = 'file'")
    got = files.chunk_files(found, os.fspath(tree), (64, 256, 1024)).where("path = 'big.bin'")
    want = content_chunks(spark.createDataFrame([("big.bin", data)], "path string, content binary"), profile=(64, 256, 1024))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert files.chunk_files(found, os.fspath(tree)).where("path = 'a.txt'").count() == 1


def test_index_store(spark, tmp_path):
    schema, retries = "path string, n int, tombstone boolean", "path string, attempts long"
    store = tables.IndexStore(spark, os.fspath(tmp_path / "index"), ["path"], schema, retries, merge_every=3)
    assert store.records().count() == 0 and store.counters() == {}
    want = {}
    for i in range(6):
        want |= {f"p{i}": (i, False), "p0": (i * 10, i == 5)}
        rows = spark.createDataFrame([(p, *v) for p, v in want.items()], schema)
        assert store.commit(rows, spark.createDataFrame([("r", i)], retries), {"generation": i}) == i + 1
        again = tables.IndexStore(spark, os.fspath(tmp_path / "index"), ["path"], schema, retries)
        assert {r["path"]: (r["n"], r["tombstone"]) for r in again.records().collect()} == want
        assert again.counters() == {"generation": i} and [r["attempts"] for r in again.retries().collect()] == [i]
    written = spark.read.parquet(os.fspath(tmp_path / "index/records-3")).count()
    assert written == 2  # the new row and the changed one


def test_replace_and_integrity(spark, tmp_path):
    from pyspark.sql import functions as F

    t = tables.SnapshotTable(spark, os.fspath(tmp_path / "snap"), ["path"])
    rows = spark.createDataFrame([("a", False), ("b", True)], "path string, tombstone boolean")
    seen = spark.createDataFrame([("a",)], "path string")
    assert t.replace(rows, seen) == 1
    with pytest.raises(ValueError, match="isn't the snapshot"):
        t.replace(rows, seen.unionByName(spark.createDataFrame([("c",)], "path string")))
    stored = spark.createDataFrame([("A", 1, "a")], "path string, v int, collision_key string")
    assert tables.checked_records(stored, F.col("v"), F.lower("path")).count() == 1
    for bad in (("A", 2, "a"), ("/A", 1, "/a"), ("A", 1, "A")):
        with pytest.raises(Exception, match="index record"):
            tables.checked_records(spark.createDataFrame([bad], stored.schema), F.col("v"), F.lower("path")).select("path").collect()


def test_catalogue(spark, tmp_path):
    c = tables.Catalogue(spark, os.fspath(tmp_path / "cat"), most_bytes=100)
    assert c.read() == {}
    c.update(lambda d: d | {"a": 1})
    assert c.update(lambda d: d | {"b": 2}) == {"a": 1, "b": 2} == tables.Catalogue(spark, os.fspath(tmp_path / "cat")).read()
    with pytest.raises(ValueError, match="too large"):
        c.update(lambda d: d | {"x": "y" * 200})


def test_ingest(spark, tmp_path):
    store = tables.ChunkStore(spark, os.fspath(tmp_path / "cas2"))
    df = spark.createDataFrame([("a", b"x" * 5000), ("b", b"y" * 10), ("n", None)], "path string, content binary")
    with pytest.raises(ValueError, match="are admitted"):
        store.ingest(df, 10, (64, 256, 1024))
    assert store.rows().count() == 0
    extents = store.ingest(df, 10_000, (64, 256, 1024))
    assert extents.where("path = 'a'").agg({"length": "sum"}).first()[0] == 5000
    assert store.ingest(df, 0, (64, 256, 1024)).count() == extents.count()
    assert store.get(extents, 2000).count() == extents.select("hash").distinct().count()
