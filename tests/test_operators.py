"""Operators on small made-up manifests: nulls, ties, empty tables, names that look like patterns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.functions import chunks, paths
from quillon.operators import diff, merge, select

FILE = "path string, hash string, size long, mtime long, runnable boolean, chunkhashes array<string>, symlink_target string, deleted boolean"


def file(path, hash="h", size=1, mtime=0, runnable=False, chunks=None, link=None, deleted=False):
    return (path, hash, size, mtime, runnable, chunks, link, deleted)


def status(spark, before, after, **options):
    rows = diff.classify(spark.createDataFrame(before, FILE), spark.createDataFrame(after, FILE), **options).collect()
    return {r.path: r.status for r in rows}


def test_added_deleted_modified_unchanged(spark):
    before = [file("same"), file("gone"), file("grown"), file("touched", mtime=0), file("late", mtime=0)]
    after = [file("same"), file("new"), file("grown", size=2), file("touched", mtime=1), file("late", mtime=2)]
    assert status(spark, before, after) == {"same": "unchanged", "gone": "deleted", "new": "added", "grown": "modified", "touched": "unchanged", "late": "modified"}


def test_null_content_is_compared_like_a_value(spark):
    before = [file("link", hash=None, size=None, mtime=None, link="a"), file("plain", hash=None)]
    after = [file("link", hash=None, size=None, mtime=None, link="b"), file("plain", hash=None)]
    assert status(spark, before, after) == {"link": "modified", "plain": "unchanged"}


def test_differences_of_nothing(spark):
    assert status(spark, [], []) == {}
    assert status(spark, [], [file("a")]) == {"a": "added"}


def test_the_last_of_a_path_wins(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 2, 3), ("a", 1, 2), ("b", 0, 9)], "path string, idx int, size long")
    assert {(r.path, r["size"]) for r in merge.merge(rows, ["idx", "size"]).collect()} == {("a", 3), ("b", 9)}


def test_subtree_and_prefix_undo_each_other(spark):
    rows = spark.createDataFrame([file("a/b.txt"), file("c")], FILE)
    again = select.subtree(select.join_prefix(rows, "/root/x/"), "/root/x")
    assert {r.path for r in again.collect()} == {"a/b.txt", "c"}


def test_subtree_takes_whole_names(spark):
    rows = spark.createDataFrame([file("foo/a"), file("foobar/a")], FILE)
    assert {r.path for r in select.subtree(rows, "foo").collect()} == {"a"}


@pytest.mark.parametrize("pattern, path, braces, expected", [("*.txt", "path/file.txt", False, True), ("target/*", "target/debug/app", False, True), ("*.txt", "file.md", False, False), (r"file\[1\].txt", "file[1].txt", True, True), ("**/*.{png,jpg}", "a/b.jpg", True, True)])
def test_globs(spark, pattern, path, braces, expected):
    rows = spark.createDataFrame([(path,)], "path string")
    assert bool(rows.where(paths.matches_globs(F.col("path"), [pattern], braces=braces)).count()) is expected


@pytest.mark.parametrize("size, n", [(0, 1), (1, 1), (268435456, 1), (268435457, 2), (3 * 268435456, 3)])
def test_chunks(spark, size, n):
    row = spark.createDataFrame([(size,)], "size long").select(chunks.chunk_count(F.col("size")).alias("n"), chunks.chunk_list(F.col("size")).alias("c")).first()
    assert (row.n, len(row.c), sum(c.length for c in row.c)) == (n, n, size)


def test_common_directory_of_siblings_that_go_on(spark):
    from quillon.operators import locations, select

    for more in ("-x", ".x", " x"):
        rows = spark.createDataFrame([("/a/b/f",), (f"/a/b{more}/f",), ("/a/b/c/f",)], "path string")
        assert [r.root for r in select.detect_root(rows).collect()] == ["/a"]
    none = spark.createDataFrame([], "place string, location string")
    got = locations.asset_groups(rows.selectExpr("path", "'input' AS kind"), none, none).collect()
    assert [(r.root, r.inputs) for r in got] == [("/a", 3)]


def test_common_path_reads_all_parts(spark, tmp_path):
    from quillon.plans import queries

    spark.createDataFrame([(1, "T", "B1"), (5000, "T", "B2")], "p_partkey long, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in queries.common_path(spark, str(tmp_path)).collect()] == [("T", "T/")]


def test_strategies_need_no_shuffle(spark):
    """A file's strategy depends on its size alone."""
    from quillon.operators import transfer
    from quillon.plans import queries

    plan = queries.upload_strategies(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
    sizes = spark.createDataFrame([("a", 268435456), ("b", 268435457), ("c", None)], "path string, size long")
    assert {r.path for r in transfer.large_files(sizes).collect()} == {"b"}
    assert {r.path: r.large for r in sizes.select("path", transfer.is_large(F.col("size")).alias("large")).collect()} == {"a": False, "b": True, "c": None}


def test_parts_are_made_once(spark):
    """No filter makes the array of parts before it is exploded; files without parts have no rows."""
    from quillon.operators import transfer

    rows = [file("one"), file("two", None, 300_000_000, chunks=["a", "b"]), file("short", None, 300_000_000, chunks=["a"]), file("none", None, 300_000_000, chunks=[]), file("gap", None, 300_000_000, chunks=[None, "b"])]
    parts = transfer.uploads(spark.createDataFrame(rows, FILE), "r", "Data")
    assert {(r.path, r["index"], r.hash) for r in parts.collect()} == {("one", 0, "h"), ("two", 0, "a"), ("two", 1, "b"), ("short", 0, "a"), ("gap", 1, "b")}
    assert "size(" not in parts._jdf.queryExecution().optimizedPlan().toString()
