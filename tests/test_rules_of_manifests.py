"""Cases that manifests meet: deleted and repeated rows, nulls, odd names, hot keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.functions import hashing, paths
from quillon.operators import changes, diff, discovery, locations, merge, select, skew, transfer, tree
from tests.test_operators import FILE, file, status


def test_deleted_rows_are_no_entries(spark):
    before = [file("a"), file("b", deleted=True), file("c"), file("d", deleted=True)]
    after = [file("a", deleted=True), file("b"), file("c")]
    assert status(spark, before, after) == {"a": "deleted", "b": "added", "c": "unchanged"}
    rows = diff.diff_files(spark.createDataFrame(before, FILE), spark.createDataFrame(after, FILE)).collect()
    assert {(r.path, r.deleted, r.hash) for r in rows} == {("a", True, None), ("b", False, "h")}


def test_repeated_paths_are_one_entry(spark):
    before = [file("a", size=1, mtime=1), file("a", size=2, mtime=2), file("a", size=1, mtime=1)]
    assert status(spark, before, [file("a", size=2, mtime=2)] * 3) == {"a": "unchanged"}
    rows = spark.createDataFrame([("a", 1, 5), ("a", 9, 4)], "path string, size long, at int")
    assert [r["size"] for r in diff.latest(rows, "at").collect()] == [1]


def test_unknown_times_differ(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "path string, size long, mtime long")
    got = diff.fast_status(rows(("a", 1, None), ("b", 1, 5), ("c", 1, 5), ("d", None, 5)), rows(("a", 1, 5), ("b", 1, None), ("c", 1, 6), ("d", 1, 5)))
    assert {r.path: r.status for r in got.collect()} == {"a": "modified", "b": "modified", "c": "unchanged", "d": "modified"}


def test_content_alone(spark):
    before = [file("a", mtime=1), file("b", runnable=True), file("c", hash=None, link="x")]
    after = [file("a", mtime=99), file("b"), file("c", hash=None, link="y")]
    made = lambda rows: spark.createDataFrame(rows, FILE)
    got = lambda **o: {r.path: r.status for r in diff.content_status(made(before), made(after), **o).collect()}
    assert got() == {"a": "unchanged", "b": "unchanged", "c": "modified"} and got(match_times=True)["a"] == "modified"


def test_raw_prefixes_of_directories(spark):
    files = spark.createDataFrame([(x,) for x in ("/foobar/x", "a/b.txt", "é/ü/f", "same", "deep/er/est")], "path string")
    dirs = spark.createDataFrame([(x,) for x in ("/foo", "/foobar", "foo", "a/b", "a/b.txt", "a", "é/ü", "same", "sam", "deep/er", "deep/e", "deep/er/est")], "path string")
    raw = lambda d: any(f.startswith(d) and f != d for f in ("/foobar/x", "a/b.txt", "é/ü/f", "same", "deep/er/est"))
    assert {r.path for r in diff.has_path_below(dirs, files, strict=False).collect()} == {r.path for r in dirs.collect() if raw(r.path)}
    assert diff.has_path_below(dirs, files.where("false"), strict=False).count() == 0


def test_partition_by_the_root(spark):
    rows = spark.createDataFrame([("/a/f",), ("/b",)], "path string")
    assert sorted(map(tuple, select.partition(rows, ["/", "/a"]).select("root", "path").collect())) == [("/", "a/f"), ("/", "b"), ("/a", "f")]
    assert [r.root for r in select.detect_roots(rows).collect()] == ["/"]
    assert select.detect_roots(rows.where("false")).count() == 0
    assert sorted(r.root for r in select.detect_roots(spark.createDataFrame([("c:/x",), ("D:/y",), ("/z",)], "path string")).collect()) == ["C:", "D:"]


def test_repeated_rows_and_nulls_stay(spark):
    items = spark.createDataFrame([("/s/a", None), ("/s/a", None), ("/t/b", 1), (None, 2)], "path string, n int")
    places = spark.createDataFrame([("/s", "S"), ("/s", "R")], "place string, location string")
    assert sorted(map(str, ((r.path, r.n, r.location) for r in locations.deepest(items, F.col("path"), places).collect()))) == sorted(map(str, [("/s/a", None, "S"), ("/s/a", None, "S"), ("/t/b", 1, None), (None, 2, None)]))
    assert sorted(map(str, locations.below_any(items, F.col("path"), places, negate=True).collect())) == sorted(map(str, items.where("n IS NOT NULL").collect()))
    assert locations.below_any(items, F.col("path"), places).count() == 2


def test_mapping_in_any_case_and_strictly(spark):
    rules = spark.createDataFrame([("C:\\Proj", "/mnt/p"), ("c:/proj/Deep", "/d")], "source_path string, destination_path string")
    items = spark.createDataFrame([("c:\\PROJ\\A.txt",), ("C:/proj/deep/B",), ("C:/projX",)], "path string")
    assert {r.path: r.mapped for r in locations.map_paths(items, rules, fold_case=True).collect()} == {"c:\\PROJ\\A.txt": "/mnt/p/A.txt", "C:/proj/deep/B": "/d/B", "C:/projX": None}
    with pytest.raises(Exception, match="no mapping rule"):
        locations.map_paths(items, rules, strict=True).collect()
    one = items.select(locations.mapped_one(F.col("path"), "C:\\Proj\\", "/m", fold_case=True).alias("x"))
    assert [r.x for r in one.collect()] == ["/m/A.txt", "/m/deep/B", None]


def test_checked_assets(spark):
    assets = spark.createDataFrame([("/p/in", "input"), ("/p/gone", "input"), ("/p/dir", "input"), ("/s/x", "input"), ("/p/out", "output")], "path string, kind string")
    present = spark.createDataFrame([("/p/in", "file"), ("/p/dir", "directory")], "path string, type string")
    shared = spark.createDataFrame([("/s",)], "place string")
    got = {r.path: (r.kind, r.was) for r in locations.checked_assets(assets, present, shared, strict=False).collect()}
    assert got == {"/p/in": ("input", None), "/p/gone": ("reference", "missing"), "/p/dir": (None, "directory"), "/s/x": (None, "shared"), "/p/out": ("output", None)}
    with pytest.raises(Exception, match="misconfigured input"):
        locations.checked_assets(assets, present, shared).collect()


def test_a_file_without_content_raises(spark):
    rows = [file("a"), file("link", hash=None, link="x"), file("gone", hash=None, deleted=True), file("many", hash=None, size=300_000_000, chunks=["p", "q"])]
    assert {(r.path, r["index"], r.hash) for r in transfer.uploads(spark.createDataFrame(rows, FILE), "r", "D").collect()} == {("a", 0, "h"), ("many", 0, "p"), ("many", 1, "q")}
    with pytest.raises(Exception, match="no content hash: bare"):
        transfer.uploads(spark.createDataFrame([*rows, file("bare", hash=None)], FILE), "r", "D").collect()


def test_upload_plan_with_repeated_entries(spark):
    parts = transfer.uploads(spark.createDataFrame([file("a"), file("b"), file("c", hash="k", size=7), file("d", hash="s", size=3), file("e", hash="t", size=3)], FILE), "r", "D")
    key = lambda h: f"r/D/{h}.xxh128"
    seen = spark.createDataFrame([(key("k"),), (key("k"),)], "key string")
    stored = spark.createDataFrame([(key("s"), 3), (key("s"), 3), (key("t"), 9)], "key string, size long")
    assert {r.path: r.action for r in transfer.upload_plan(parts, seen, stored).collect()} == {"a": "upload", "b": "skip_repeated", "c": "skip_stored", "d": "skip_stored", "e": "upload"}
    assert transfer.upload_plan(parts.where("false"), seen, stored).count() == 0


@pytest.mark.parametrize(("pattern", "braces", "hits"), [("[^a]x", False, ["^x", "ax"]), ("[!a]x", False, ["^x", "bx", "[x", "&x"]), ("[^a]x", True, ["^x", "bx", "[x", "&x"]), ("[a&&b]x", False, ["ax", "bx", "&x"]), ("[[]x", False, ["[x"]), ("[a-b]x", True, ["ax", "bx"])])
def test_classes_of_globs(spark, pattern, braces, hits):
    rows = spark.createDataFrame([(x,) for x in ("ax", "bx", "^x", "[x", "&x")], "path string")
    assert sorted(r.path for r in rows.where(paths.matches_globs(F.col("path"), [pattern], braces=braces)).collect()) == sorted(hits)


def test_keys_without_a_root_raise(spark):
    parsed = spark.createDataFrame([("k/" + "0" * 32 + "_output", "s1"), ("k/" + "1" * 32 + "_output", "s2")], "key string, session_action_id string")
    roots = spark.createDataFrame([("0" * 32, 0)], "root_hash string, root_index long")
    assert discovery.match_roots(parsed, roots).count() == 1
    with pytest.raises(Exception, match="no asset root"):
        discovery.match_roots(parsed, roots, strict=True).collect()


def test_merging_different_manifests_raises(spark):
    rows = spark.createDataFrame([(1, "2025-12", "xxh128"), (2, "2023-03-03", "xxh128")], "manifest_id int, version string, hash_alg string")
    assert merge.checked(rows.where("manifest_id = 1")).count() == 1
    with pytest.raises(Exception, match="differ in version"):
        merge.checked(rows).collect()


def test_plain_application_keeps_what_is_below(spark):
    base = spark.createDataFrame([file("a/b"), file("a"), file("c")], FILE)
    put = spark.createDataFrame([file("a", deleted=True), file("c", size=9), file("new")], FILE)
    assert {(r.path, r["size"]) for r in merge.apply_plainly(base, put).collect()} == {("a/b", 1), ("c", 9), ("new", 1)}


def test_hot_keys_are_shared_by_tasks(spark):
    """With half of all rows on one key, several tasks join it, and every row comes out once."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    def shared(rows, hot):
        """How many tasks have rows of the hot key, all columns being read."""
        own = rows.withColumn("p", F.spark_partition_id()).where(hot).groupBy("p").agg(F.count("*").alias("n"), F.sum(F.hash(*rows.columns)).alias("s"))
        return sum(r.n > 100 for r in own.collect())

    try:
        rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
        groups = rows.groupBy("k").agg(F.min("id").alias("first"))
        joined = skew.join_groups(rows, groups, "k")
        assert joined.count() == 20_000 and joined.where("k = 7 AND first = 0").count() == 10_001
        assert shared(joined, "k = 7") > 2
        parts = spark.range(0, 6000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("path"), F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("length"), F.when(F.col("id") < 4000, "empty").otherwise(F.col("id").cast("string")).alias("key"))
        none = spark.createDataFrame([], "key string, size long")
        plan = transfer.upload_plan(parts, none, none)
        assert shared(plan, "key = 'empty'") > 2 and plan.where("action = 'upload'").count() == 2001 and plan.count() == 6000
        objects = spark.range(0, 8000, 1, 8).select(F.concat(F.lit("step-1/task-"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")), F.lit("/1_sessionaction-1/"), F.sha2(F.col("id").cast("string"), 256), F.lit("_output")).alias("key"), F.lit(1).cast("long").alias("last_modified"))
        latest = discovery.latest_per_task(discovery.parse_keys(objects))
        assert latest.count() == 8000 and shared(latest, "task_id = 'task-hot'") > 2
        files = spark.range(0, 5000, 1, 8).select(F.lit(0).alias("idx"), F.col("id").alias("seq"), F.concat(F.lit("top/"), F.col("id").cast("string")).alias("path"), F.lit(False).alias("deleted"))
        dirs = spark.createDataFrame([(1, 0, "top", True)], "idx int, seq long, path string, deleted boolean")
        assert merge.apply_diffs(files, dirs)[0].count() == 0
    finally:
        for k in small:
            spark.conf.unset(k)


def test_hashes_of_fixed_values(spark):
    rows = spark.createDataFrame([("",), ("a",), (None,)], "s string")
    got = rows.select("s", hashing.xxh128(F.encode("s", "UTF-8")).alias("h"), hashing.unique_directory(F.col("s")).alias("d")).collect()
    assert got[0].h == "99aa06d3014798d86001c324468d497f" and got[1].h == "a96faf705af16834e6c632b61e964e1f" and got[2].h is None
    assert got[0].d == "assetroot-46b9dd2b0ba88d13233b" and got[2].d is None
    folded = spark.createDataFrame([("99aa06d3014798d86001c324468d497f",), ("0" * 31 + "1",)], "h string").select(hashing.fold(F.col("h")).alias("f"))
    assert [r.f for r in folded.collect()] == [f"{0x99AA06D3014798D8 ^ 0x6001C324468D497F:016x}", "0" * 15 + "1"]


def test_paths_for_manifests(spark):
    rows = spark.createDataFrame([("/r/a/../b",), ("/r",), ("/r/./",)], "path string")
    assert [r.x for r in rows.select(paths.for_manifest(F.col("path"), "/r/").alias("x")).collect()] == ["b", "", ""]
    with pytest.raises(Exception, match="outside root"):
        spark.createDataFrame([("/rx",)], "path string").select(paths.for_manifest(F.col("path"), "/r").alias("x")).collect()


def test_renames_and_sampled_keys(spark):
    e = spark.createDataFrame([(1, "rename", "a", "b"), (2, "modify", "b", None), (3, "delete", "c", None)], "seq int, op string, path string, new_path string")
    got = {r.path: r.state for r in changes.file_states(changes.with_renames(e), spark.createDataFrame([("a",), ("c",)], "path string"), order=["seq", "part"]).collect()}
    assert got == {"a": "deleted", "b": "new", "c": "deleted"}
    cache = spark.range(100).select(F.col("id").cast("string").alias("k"))
    first = [r.k for r in tree.sampled_keys(cache, "k", 9).collect()]
    assert len(set(first)) == 9 and first == [r.k for r in tree.sampled_keys(cache.repartition(5), "k", 9).collect()]


def test_kinds_of_manifests_and_rows(spark):
    from quillon.schema import file_row
    from quillon.sources import manifests

    a, b, c, e = manifests.SPEC_VERSIONS
    headers = spark.createDataFrame([(1, a, None), (2, c, None)], "manifest_id int, spec_version string, parent_manifest_hash string")
    assert manifests.narrowed(headers, kind="snapshot").count() == 2 and [r.spec_version for r in manifests.restyled(headers, "relative").collect()] == [c, c]
    for wrong in (lambda: manifests.narrowed(headers, "absolute"), lambda: manifests.narrowed(headers.withColumn("spec_version", F.lit(e)))):
        with pytest.raises(Exception, match="not the kind"):
            wrong().collect()
    rows = spark.range(1).select(*file_row(F.lit("p"), symlink_target=F.lit("t")))
    assert tuple(rows.first()) == ("p", None, None, None, False, None, "t", False)


def test_changes_in_a_directory(spark):
    states = spark.createDataFrame([("a/b", "new"), ("a/c/d", "new"), ("a/e", "deleted"), ("f", "new")], "path string, state string")
    assert [(r.name, r.path) for r in changes.in_directory(states, "a/").collect()] == [("b", "a/b")]
    assert [r.name for r in changes.in_directory(states, "").collect()] == ["f"] and changes.in_directory(states, "a", None).count() == 2
    files = spark.createDataFrame([("a/b", 1), ("f", 2), ("z", 3)], "path string, size int")
    assert {(r.path, r["size"], r.deleted) for r in changes.difference_rows(states, files).collect()} == {("a/b", 1, False), ("f", 2, False), ("a/e", None, True)}
