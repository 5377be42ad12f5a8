"""Sequences of manifests: last writer wins, and folds with deletions that take whole subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators.skew import join_groups


def merge(files: DataFrame, order: list[str], by: list[str] = ("path",)) -> DataFrame:
    """One row a path (or other key): the last by the order columns. Deleted rows stay rows.

    A partial aggregate with max_by: less is shuffled than for a window, and nothing is sorted.
    """
    kept = [c for c in files.columns if c not in by]
    last = F.max_by(F.struct(*kept), F.struct(*order))
    return files.groupBy(*by).agg(last.alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in kept])


def checked(headers: DataFrame, fields: tuple[str, ...] = ("version", "hash_alg")) -> DataFrame:
    """The headers of manifests that are to be merged; raises unless all have the same fields."""
    ends = headers.agg(*[F.struct(F.min(f).alias("low"), F.max(f).alias("high")).alias(f"_{f}") for f in fields])
    rows = headers.join(F.broadcast(ends))
    for f in fields:
        bad = F.raise_error(F.concat_ws(" ", F.lit(f"manifests to be merged differ in {f}:"), F.col(f"_{f}.low"), F.lit("and"), F.col(f"_{f}.high")))
        rows = rows.withColumn(f, F.when(F.col(f"_{f}.low") == F.col(f"_{f}.high"), F.col(f)).otherwise(bad))
    return rows.select(*headers.columns)


def merge_chronologically(files: DataFrame, time: str, index: str, seq: str) -> DataFrame:
    """merge in the order of time; equal times in the order of input."""
    return merge(files, [time, index, seq])


def apply_diffs(files: DataFrame, dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold manifests in the order of `idx` and `seq`, directories before files in each: (files, dirs) that are left.

    files and dirs hold idx, seq, path, deleted. A deleted directory takes everything below it and a file of its own path, unless
    that is put again later. A deleted file takes itself only. Every join is on equal paths, over the ancestors of each path.
    """
    order = lambda phase: F.struct("idx", F.lit(phase).alias("phase"), "seq")
    f, d = files.withColumn("_at", order(1)), dirs.withColumn("_at", order(0))
    gone = d.where("deleted").groupBy("path").agg(F.max("_at").alias("_gone")).withColumnRenamed("path", "_above")
    last = lambda x: x.groupBy("path").agg(F.max_by(F.struct(*[c for c in x.columns if c not in ("path", "_at")]), "_at").alias("_r"), F.max("_at").alias("_at"))

    def left(rows: DataFrame) -> DataFrame:
        puts = last(rows).where("NOT _r.deleted")
        above = puts.select("path", F.explode(paths.ancestors(F.col("path"), itself=True)).alias("_above"))
        over = join_groups(above, gone, "_above").groupBy("path").agg(F.max("_gone").alias("_gone"))
        kept = puts.join(over, "path", "left").where("_gone IS NULL OR _gone < _at")
        return kept.select("path", "_r.*").drop("deleted")

    return left(f), left(d)


def compose(files: DataFrame, dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compose snapshots in the order of `idx` and `seq`: like apply_diffs, of which the first is the base and the others need no deletions."""
    return apply_diffs(files, dirs)


def apply_plainly(base: DataFrame, diff: DataFrame) -> DataFrame:
    """A snapshot's files with one difference manifest put over it: deletions take their own path only, whatever is below it."""
    rest = base.where(~F.coalesce("deleted", F.lit(False))).join(diff.select("path"), "path", "left_anti").select(*base.columns)
    return rest.unionByName(diff.where(~F.coalesce("deleted", F.lit(False))).select(*base.columns))


def sorted_paths(files: DataFrame, key: str) -> DataFrame:
    """(key, n_files, total_size, paths): by key, its paths in order. One row holds a group's paths: for groups that go into one document."""
    return files.groupBy(key).agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.sort_array(F.collect_list("path")).alias("paths"))


def path_groups(files: DataFrame, key: str) -> DataFrame:
    """By key: number of files, bytes, and the sorted paths' first and last."""
    return files.groupBy(key).agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
