"""Differences of two manifests: null-safe full outer joins on the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.schema import MTIME_TOLERANCE_US

FIELDS = ("hash", "size", "mtime", "runnable", "chunkhashes", "symlink_target")


def latest(files: DataFrame, order: str | None = None) -> DataFrame:
    """Undeleted rows, one a path: of repeated paths the last by `order`, or without one the greatest by time, size and content.

    The join on the path that follows takes the same partitions and order, so that this costs it no shuffle of its own.
    """
    live = files.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in files.columns else files
    kept = [c for c in files.columns if c != "path"]
    by = F.col(order) if order else F.struct(*[c for c in ("mtime", "size", "hash", "chunkhashes", "symlink_target", "runnable") if c in kept])
    return live.groupBy("path").agg(F.max_by(F.struct(*kept), by).alias("_r")).select("path", *[F.col(f"_r.{c}").alias(c) for c in kept])


def entries_differ(p: str = "p", c: str = "c", ignore_hashes: bool = False, preserve_runnable: bool = False) -> Column:
    """Whether two entries differ; times count only where both are known and apart by more than the tolerance."""
    old, new = (lambda n: F.col(f"{p}.{n}")), (lambda n: F.col(f"{c}.{n}"))
    differ = lambda n: ~old(n).eqNullSafe(new(n))
    found = differ("symlink_target") | differ("size") | F.coalesce(F.abs(old("mtime") - new("mtime")) > MTIME_TOLERANCE_US, F.lit(False))
    if not ignore_hashes:
        found = found | differ("hash") | differ("chunkhashes")
    return found if preserve_runnable else found | differ("runnable")


def classify(parent: DataFrame, current: DataFrame, order: str | None = None, **options) -> DataFrame:
    """(path, status, p, c): added, deleted, modified or unchanged, with both entries as structs.

    Deleted rows are no entries on either side; a repeated path is one entry (latest).
    """
    side = lambda d, n: latest(d, order).select(F.col("path").alias(f"{n}_path"), F.struct(*[x for x in FIELDS if x in d.columns]).alias(n))
    joined = side(parent, "p").join(side(current, "c"), F.col("p_path") == F.col("c_path"), "full_outer")
    status = F.when(F.col("p_path").isNull(), "added").when(F.col("c_path").isNull(), "deleted").when(entries_differ(**options), "modified").otherwise("unchanged")
    return joined.select(F.coalesce("c_path", "p_path").alias("path"), status.alias("status"), "p", "c")


def diff_files(parent: DataFrame, current: DataFrame, **options) -> DataFrame:
    """Rows of a difference manifest: added and modified entries, and a bare marker for each deleted path."""
    found = classify(parent, current, **options).where("status <> 'unchanged'")
    return found.select("path", *[F.col(f"c.{x}").alias(x) for x in FIELDS if x in current.columns], (F.col("status") == "deleted").alias("deleted"))


def has_path_below(dirs: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """The directories below which there is a file. Not strict: a file that begins with the directory's name is enough (foo keeps foobar).

    Both are equi-joins of distinct keys. Strict goes over the files' ancestors. The other goes over (folder, beginning of a name in it) of all
    files and their directories, in the few lengths that names of `dirs` have; one row with these lengths is broadcast.
    """
    above = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    if strict:
        return dirs.join(above, "path", "left_semi")
    folder = lambda p: F.regexp_replace(p, "[^/]*$", "").alias("_folder")  # noqa: E731  with its slash: '/a' is not 'a'
    asked = dirs.withColumns({"_folder": folder(F.col("path")), "_name": paths.name(F.col("path"))})
    lengths = asked.agg(F.collect_set(F.length("_name")).alias("_lengths"))
    nodes = above.select("path", F.lit(0).alias("_longer")).union(files.select("path", F.lit(1).alias("_longer")))
    named = nodes.select(folder(F.col("path")), paths.name(F.col("path")).alias("_name"), "_longer").join(F.broadcast(lengths))
    fit = F.filter("_lengths", lambda n: n <= F.length("_name") - F.col("_longer"))
    begins = named.select("_folder", "_name", F.explode(fit).alias("_n")).select("_folder", F.expr("left(_name, _n)").alias("_name")).distinct()
    return asked.join(begins, ["_folder", "_name"], "left_semi").select(*dirs.columns)


def diff_directories(parent: DataFrame, current: DataFrame, current_files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, deleted): new directories, and gone ones below which there is no file."""
    new = current.join(parent, "path", "left_anti").select("path", F.lit(False).alias("deleted"))
    gone = parent.join(current, "path", "left_anti").select("path")
    return new.union(gone.join(has_path_below(gone, current_files, strict), "path", "left_anti").select("path", F.lit(True).alias("deleted")))


def fast_status(manifest: DataFrame, walked: DataFrame) -> DataFrame:
    """(path, status) of a directory's state against a manifest by size and time alone. Sizes or times that are not known differ."""
    m, w = latest(manifest).alias("m"), walked.alias("w")
    same = (F.col("m.size") == F.col("w.size")) & (F.abs(F.col("m.mtime") - F.col("w.mtime")) <= MTIME_TOLERANCE_US)
    changed = ~F.coalesce(same, F.lit(False))
    status = F.when(F.col("m.path").isNull(), "added").when(F.col("w.path").isNull(), "deleted").when(changed, "modified").otherwise("unchanged")
    return m.join(w, F.col("m.path") == F.col("w.path"), "full_outer").select(F.coalesce("w.path", "m.path").alias("path"), status.alias("status"))


def hash_status(manifest: DataFrame, walked: DataFrame) -> DataFrame:
    """Like fast_status, by size and then content; chunked entries have no single hash and count as modified."""
    m, w = latest(manifest).alias("m"), walked.alias("w")
    changed = ~F.coalesce((F.col("m.size") == F.col("w.size")) & (F.coalesce("m.hash", F.lit("")) == F.col("w.hash")), F.lit(False))
    status = F.when(F.col("m.path").isNull(), "added").when(F.col("w.path").isNull(), "deleted").when(changed, "modified").otherwise("unchanged")
    return m.join(w, F.col("m.path") == F.col("w.path"), "full_outer").select(F.coalesce("w.path", "m.path").alias("path"), status.alias("status"))


def content_status(parent: DataFrame, current: DataFrame, match_times: bool = False) -> DataFrame:
    """(path, status) by kind, size and content alone; match_times: times count as well, where both are known."""
    joined = classify(parent, current, preserve_runnable=True)
    differ = lambda n: ~F.col(f"p.{n}").eqNullSafe(F.col(f"c.{n}"))
    content = differ("symlink_target") | differ("size") | differ("hash") | differ("chunkhashes")
    if match_times:
        content = content | F.coalesce(F.abs(F.col("p.mtime") - F.col("c.mtime")) > MTIME_TOLERANCE_US, F.lit(False))
    status = F.when(F.col("status").isin("added", "deleted"), F.col("status")).when(content, "modified").otherwise("unchanged")
    return joined.select("path", status.alias("status"))


def rollup(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))
