"""Filter, subtree, prefix and partition of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators.diff import has_path_below


def filter_manifest(files: DataFrame, dirs: DataFrame, keep: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The files that are kept, and the directories that one of these is below."""
    kept = files.where(keep)
    return kept, has_path_below(dirs, kept, strict)


def subtree(rows: DataFrame, root: str) -> DataFrame:
    """What is below root, by paths from there."""
    root = root.replace("\\", "/").rstrip("/")
    return rows.where(paths.under(F.col("path"), root)).withColumn("path", paths.relative(F.col("path"), root))


def join_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """The rows under a prefix."""
    return rows.withColumn("path", paths.join_path(F.lit(prefix.replace("\\", "/").rstrip("/")), F.col("path")))


def partition(rows: DataFrame, roots: list[str]) -> DataFrame:
    """Rows by each of a few given roots above them, as root and relative path; overlapping roots repeat rows. Everything is below '/' and ''."""
    tops = F.array(*[F.struct(F.lit(r).alias("root"), F.lit(r.rstrip("/")).alias("top")) for r in roots])
    own = F.filter(tops, lambda r: paths.under(F.col("path"), r["top"]))
    cut = F.when(F.col("_r.top") == "", F.regexp_replace("path", "^/", "")).otherwise(paths.relative(F.col("path"), F.col("_r.top")))
    named = F.when(F.col("_r.root").isin("", "/"), F.col("_r.root")).otherwise(F.col("_r.top"))
    return rows.withColumn("_r", F.explode(own)).withColumns({"root": named, "path": cut}).drop("_r")


def detect_root(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The longest common directory of all paths, or of each group's, '/' where there is none; no row for no paths.

    That of the least and the greatest path, as lists of names.
    """
    parts = paths.components(paths.parent(F.col("path")))
    ends = rows.groupBy(*by).agg(F.min(parts).alias("_low"), F.max(parts).alias("_high")).where("_low IS NOT NULL")
    root = paths.common_directory(F.col("_low"), F.col("_high"))
    return ends.select(*by, F.when(root == "", "/").otherwise(root).alias("root"))


def detect_roots(rows: DataFrame) -> DataFrame:
    """The roots by which a manifest of absolute paths is parted: the drives if any path has one, else the one of detect_root."""
    drive = F.upper(F.regexp_extract("path", "^(.:)", 1))
    drives = rows.select(drive.alias("root")).where("root <> ''").distinct()
    any_drive = rows.agg(F.coalesce(F.bool_or(F.col("path").rlike("^.:")), F.lit(False)).alias("_windows"))
    return drives.union(detect_root(rows).join(F.broadcast(any_drive)).where("NOT _windows").select("root"))


def deletions(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("deleted", F.lit(False)))


def additions(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("deleted", F.lit(False)))


def of_kind(kind: str) -> Column:
    """Predicate of files by content: file, chunked, symlink, runnable or deleted."""
    live = ~F.coalesce("deleted", F.lit(False))
    kinds = {
        "file": live & F.col("symlink_target").isNull(), "chunked": live & F.col("chunkhashes").isNotNull(), "symlink": live & F.col("symlink_target").isNotNull(),
        "runnable": live & F.coalesce("runnable", F.lit(False)), "deleted": ~live,
    }
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}")
    return kinds[kind]


def partition_drives(rows: DataFrame) -> DataFrame:
    """Windows paths by drive letter, as root and relative path."""
    slashed = paths.to_posix(F.col("path"))
    drive = F.upper(F.regexp_extract(slashed, "^([A-Za-z]):", 1))
    return rows.where(slashed.rlike("^[A-Za-z]:")).withColumn("root", F.concat(drive, F.lit(":"))).withColumn("path", F.regexp_replace(slashed, "^[A-Za-z]:/*", ""))
