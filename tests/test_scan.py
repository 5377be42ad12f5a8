"""Directory walks, snapshots, stores: made trees with links, odd names and empty folders."""

from __future__ import annotations

import os

import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.operators import diff, scan
from quillon.sources import directory, store


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, data in {"top.txt": b"top", "a/one": b"1", "a/deep/er/two": b"22", "a/é ü.txt": b"odd", "b/$0/x": b"ref", "b/[x]*.md": b"glob", "b/empty": b"", "b/run.sh": b"#!"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "none/below").mkdir(parents=True)
    (root / "b/run.sh").chmod(0o755)
    os.symlink("one", root / "a/link")
    os.symlink("../../out", root / "a/out")
    os.symlink("/etc/hosts", root / "absolute")
    os.symlink("a", root / "folder")
    return str(root)


FILES = {"top.txt", "a/one", "a/deep/er/two", "a/é ü.txt", "b/$0/x", "b/[x]*.md", "b/empty", "b/run.sh"}
DIRS = {"a", "a/deep", "a/deep/er", "b", "b/$0", "none", "none/below"}


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_walk(spark, tree, depth):
    rows = {r.path: r for r in directory.walk(spark, tree, depth).collect()}
    assert {p for p, r in rows.items() if r.is_dir} == DIRS and {p for p, r in rows.items() if not r.is_dir and not r.is_link} == FILES
    assert {p: r.target for p, r in rows.items() if r.is_link} == {"a/link": "one", "a/out": "../../out", "absolute": "/etc/hosts", "folder": "a"}
    assert rows["a/deep/er/two"].size == 2 and rows["a/one"].mtime == os.stat(f"{tree}/a/one").st_mtime_ns // 1000
    assert directory.walk(spark, tree, depth).count() == len(rows)


def test_walk_of_an_empty_folder(spark, tmp_path):
    assert directory.walk(spark, str(tmp_path)).count() == 0


def test_snapshot(spark, tree):
    files, dirs = scan.snapshot(directory.walk(spark, tree), tree)
    rows = {r.path: r for r in files.collect()}
    assert set(rows) == FILES | {"a/link", "folder"} and {r.path for r in dirs.collect()} == DIRS
    assert rows["a/link"].symlink_target == "one" and rows["a/link"].hash is None and rows["a/link"]["size"] is None
    assert rows["a/é ü.txt"].hash == xxhash.xxh3_128_hexdigest(b"odd") and rows["b/empty"].hash == xxhash.xxh3_128_hexdigest(b"")
    assert rows["b/run.sh"].runnable and not rows["a/one"].runnable
    kept, _ = scan.snapshot(directory.walk(spark, tree), tree, keep=F.col("path").startswith("a/"), hashed=False, policy="exclude_all")
    assert {r.path for r in kept.collect()} == {p for p in FILES if p.startswith("a/")} and kept.where("hash IS NOT NULL").count() == 0
    assert set(r.path for r in scan.snapshot(directory.walk(spark, tree), tree, policy="preserve")[0].where("symlink_target IS NOT NULL").collect()) == {"a/link", "a/out", "absolute", "folder"}


def test_chunks_are_hashed_apart(spark, tree):
    data = os.urandom(2500)
    with open(f"{tree}/large", "wb") as f:
        f.write(data)
    files = {r.path: r for r in scan.snapshot(directory.walk(spark, tree), tree, chunk=1000)[0].collect()}
    assert files["large"].hash is None and files["large"].chunkhashes == [xxhash.xxh3_128_hexdigest(data[i : i + 1000]) for i in (0, 1000, 2000)]
    assert files["top.txt"].chunkhashes is None


def test_listed_paths(spark, tree):
    listed = spark.createDataFrame([("a/one",), ("a",), ("gone",), ("a/link",)], "path string")
    assert {r.path: (r.was, r["size"]) for r in directory.checked_inputs(listed, tree).collect()} == {"a/one": ("file", 1), "a": ("directory", None), "gone": ("missing", None), "a/link": ("file", None)}
    got = {(r.path, r.given) for r in scan.expand(listed.union(spark.createDataFrame([("a/one",)], "path string")), directory.walk(spark, tree)).collect()}
    assert got == {("a/one", "a/one"), ("gone", "gone"), ("a/link", "a/link"), ("a/one", "a"), ("a/deep/er/two", "a"), ("a/é ü.txt", "a"), ("a/link", "a"), ("a/out", "a")}


def test_files_of_one_folder_are_hashed_by_several_tasks(spark, tmp_path):
    (tmp_path / "one").mkdir()
    for i in range(40):
        (tmp_path / f"one/{i}").write_bytes(str(i).encode())
    files = directory.walk(spark, str(tmp_path)).where("NOT is_dir").select("path", "size", "mtime", "mode")
    rows = scan.chunk_hashes(files, str(tmp_path)).collect()
    assert {r.path: r.hash for r in rows} == {f"one/{i}": xxhash.xxh3_128_hexdigest(str(i).encode()) for i in range(40)}
    plan = scan.chunk_hashes(files, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[plan.index("MapInArrow") :]


def test_a_walk_lists_names_one_at_a_time(tmp_path, monkeypatch):
    for i in range(20):
        (tmp_path / f"{i}").mkdir()
    looked = []
    monkeypatch.setattr(directory, "entry", lambda root, path: looked.append(path) or (path,))
    rows = directory.DirectoryReader({"path": str(tmp_path)}).read(directory.Part([""], True))
    (tmp_path / next(rows)[0].lstrip("/") / "below").touch()
    assert len(looked) == 1 and len(list(rows)) == 20


@pytest.mark.parametrize("name", ["scan_snapshot", "scan_status"])
def test_folders_are_walked_once(spark, name):
    from quillon.plans import queries

    assert "directory_tree" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_changes_of_a_folder(spark, tree):
    entries = directory.walk(spark, tree)
    files, dirs = scan.snapshot(entries, tree)
    files, dirs = spark.createDataFrame(files.collect(), files.schema), spark.createDataFrame(dirs.collect(), dirs.schema)
    with open(f"{tree}/a/one", "w") as f:
        f.write("changed")
    os.utime(f"{tree}/top.txt", ns=(1, 1))
    os.remove(f"{tree}/b/empty")
    os.mkdir(f"{tree}/fresh")
    os.rmdir(f"{tree}/none/below")
    with open(f"{tree}/fresh/new", "w") as f:
        f.write("new")
    now = directory.walk(spark, tree)
    fast, came = scan.directory_status(files, dirs, now, tree)
    by = lambda rows: {r.path: r.status for r in rows.collect() if r.status != "unchanged"}
    assert by(fast) == {"a/one": "modified", "top.txt": "modified", "b/empty": "deleted", "fresh/new": "added"}
    assert {(r.path, r.deleted) for r in came.collect()} == {("fresh", False), ("none/below", True)}
    assert by(scan.directory_status(files, dirs, now, tree, hashed=True)[0]) == {"a/one": "modified", "b/empty": "deleted", "fresh/new": "added"}
    assert by(scan.directory_status(files, dirs, now, tree, keep=~F.col("path").startswith("b/"))[0]) == {"a/one": "modified", "top.txt": "modified", "fresh/new": "added"}
    put, _ = scan.difference(files, dirs, now, tree)
    assert {(r.path, r.deleted, r.hash) for r in put.collect()} == {("a/one", False, xxhash.xxh3_128_hexdigest(b"changed")), ("top.txt", False, xxhash.xxh3_128_hexdigest(b"top")), ("fresh/new", False, xxhash.xxh3_128_hexdigest(b"new")), ("b/empty", True, None)}
    row = scan.status_statistics(fast, now, put.where("NOT deleted")).first()
    assert (row.files_scanned, row.dirs_scanned, row.files_hashed, row.bytes_hashed, row.n_modified) == (12, 7, 3, 13, 2)
    assert diff.rollup(fast).count() == 4


def test_store_round_trip(spark, tmp_path):
    folder, to = str(tmp_path / "store"), str(tmp_path / "out")
    contents = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"abc"),), (bytearray(b""),), (None,)], "content binary").repartition(3)
    written = store.put(contents, folder).collect()
    assert {(r.hash, r["size"]) for r in written} == {(xxhash.xxh3_128_hexdigest(x), len(x)) for x in (b"abc", b"")}
    assert not any(r.written for r in store.put(contents, folder).collect())
    listing = {r.key: r["size"] for r in store.objects(spark, folder).collect()}
    assert listing == {f"{xxhash.xxh3_128_hexdigest(x)}.xxh128": len(x) for x in (b"abc", b"")}
    h = xxhash.xxh3_128_hexdigest(b"abc")
    asked = spark.createDataFrame([(h, 1, 1), (h, 2, 50), (h, None, None), (h, 9, 1), ("0" * 32, 0, 1)], "hash string, offset long, length long")
    assert sorted(str(r.content and bytes(r.content) if r.content is not None else None) for r in store.retrieve(asked, folder).collect()) == sorted(map(str, [b"b", b"c", b"abc", b"", None]))
    parts = spark.createDataFrame([("d/twice", 1, h), ("d/twice", 0, h), ("empty", 0, xxhash.xxh3_128_hexdigest(b""))], "target string, index long, hash string")
    assert {(r.target, r["size"]) for r in store.download(parts, folder, to).collect()} == {("d/twice", 6), ("empty", 0)}
    assert (tmp_path / "out/d/twice").read_bytes() == b"abcabc"
    with pytest.raises(Exception, match="No such file|not found|FileNotFound"):
        store.download(spark.createDataFrame([("x", 0, "f" * 32)], "target string, index long, hash string"), folder, to).collect()


def test_rows_are_stored_in_one_pass(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, bytearray(b"abc"), "x"), (2, None, "y"), (3, bytearray(b""), None), (4, bytearray(b"abc"), "z")], "k long, content binary, v string").coalesce(1)
    written = spark.createDataFrame(store.put_rows(rows, folder).collect(), "k long, v string, hash string, size long, written boolean")
    abc, none = xxhash.xxh3_128_hexdigest(b"abc"), xxhash.xxh3_128_hexdigest(b"")
    assert [tuple(r) for r in written.orderBy("k").collect()] == [(1, "x", abc, 3, True), (2, "y", None, None, None), (3, None, none, 0, True), (4, "z", abc, 3, False)]
    assert {r.written for r in store.put_rows(rows, folder).collect()} == {False, None}
    assert sorted(os.listdir(folder)) == sorted(f"{h}.xxh128" for h in (abc, none))


def test_unfinished_objects_stand_apart(spark, tmp_path):
    """Not in the folder of the objects, where all tasks would wait for each other, and in no listing."""
    from pyarrow.fs import LocalFileSystem

    with store._unfinished(LocalFileSystem(), str(tmp_path)) as own:
        assert os.path.dirname(own) == str(tmp_path) and own != str(tmp_path)
        with open(f"{own}/.half", "wb") as f:
            f.write(b"ha")
        (tmp_path / "done").write_bytes(b"x")
        listed = [r.key for r in store.objects(spark, str(tmp_path)).collect()]
    assert listed == ["done"] and os.listdir(tmp_path) == ["done"]


def test_downloads_are_dealt_over_tasks(spark, tmp_path):
    folder, to = str(tmp_path / "store"), str(tmp_path / "out")
    stored = store.put_rows(spark.range(40).select("id", F.encode(F.col("id").cast("string"), "UTF-8").alias("content")), folder).collect()
    parts = spark.createDataFrame([(f"one/{r.id}", 0, r.hash) for r in stored], "target string, index long, hash string")
    rows = store.download(parts, folder, to).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 1 and {r.target: r["size"] for r in rows} == {f"one/{i}": len(str(i)) for i in range(40)}
    assert (tmp_path / "out/one/7").read_bytes() == b"7" and os.listdir(to) == ["one"]


def test_a_listing_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """Names are listed some at a time, and looked at by several tasks."""
    from pyarrow.fs import LocalFileSystem

    names = {f"{folder}{i}" for folder in ("", "a/", "a/b/", "c/") for i in range(10)}
    for name in names | {".hidden", "a/.hidden", ".folder/x"}:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    rows = store.objects(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.key, r["size"]) for r in rows} == {(n, len(n)) for n in names} and len(rows) == len(names)
    assert len({r.task for r in rows}) > 1 and all(r.last_modified == int(os.stat(tmp_path / r.key).st_mtime) for r in rows)
    assert {r.key for r in store.objects(spark, str(tmp_path), ("a/b", "/c/", "none")).collect()} == {n for n in names if n.startswith(("a/b", "c"))}
    monkeypatch.setattr(store, "LISTED", 3)
    parts = list(store._keys(LocalFileSystem(), str(tmp_path), ""))
    assert max(map(len, parts)) == 3 and {k for part in parts for k, _, _ in part} == names


@pytest.mark.parametrize("name", ["store_ranges", "scan_snapshot", "scan_status"])
def test_texts_go_to_python_once(spark, name):
    """The queries on stores hash contents as they write them, and read no texts again."""
    from quillon.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "documents.parquet" not in plan


def test_upload_of_ranges(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/f").write_bytes(b"0123456789")
    plan = spark.createDataFrame([("f", 0, 0, 4, "h0", "upload"), ("f", 1, 4, 6, "h1", "upload"), ("f", 2, 0, 1, "h2", "skip_stored")], "path string, index long, offset long, length long, hash string, action string")
    assert {r.hash for r in store.upload(plan, str(tmp_path / "src"), str(tmp_path / "s")).collect()} == {"h0", "h1"}
    assert (tmp_path / "s/h1.xxh128").read_bytes() == b"456789" and not (tmp_path / "s/h2.xxh128").exists()


def test_manifests_by_root(spark, tmp_path):
    for name in ("0" * 32 + "_output", "1" * 32 + "_input"):
        (tmp_path / name).write_text("{}")
    roots = spark.createDataFrame([("/r", "0" * 32)], "root string, root_hash string")
    assert sorted(str(r.root) for r in store.stored_manifests(spark, str(tmp_path), roots, strict=False).collect()) == ["/r", "None"]
    with pytest.raises(Exception, match="no asset root"):
        store.stored_manifests(spark, str(tmp_path), roots).collect()


def test_output_manifest(spark, tree):
    entries = directory.walk(spark, tree)
    recorded = spark.createDataFrame([("a/one", os.stat(f"{tree}/a/one").st_mtime_ns // 1000), ("top.txt", 5)], "path string, mtime long")
    assert {r.path for r in scan.output_manifest(entries, recorded, tree).collect()} == FILES - {"a/one"}
    got = {r.path: r.hash for r in scan.output_manifest(entries, recorded, tree, ["a/", "none"]).collect()}
    assert set(got) == {"a/deep/er/two", "a/é ü.txt"} and got["a/deep/er/two"] == xxhash.xxh3_128_hexdigest(b"22")
