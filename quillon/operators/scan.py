"""Snapshots of directory trees, and their difference to a manifest. Hashes are made chunk by chunk, so that a large file is no one task's work.

Entries are rows of sources.directory. A filter is a predicate of the path, applied to each entry by itself: a folder that it leaves out does
not take what is below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.functions.chunks import chunk_list, needs_chunks
from quillon.operators import diff
from quillon.operators.validate import link_action, link_problem
from quillon.schema import CHUNK_SIZE
from quillon.sources.shared import plain

STEP = 1 << 20


def is_executable(mode: Column) -> Column:
    return mode.bitwiseAND(0o111) != 0


def links(entries: DataFrame, policy: str = "exclude_escaping") -> DataFrame:
    """(path, symlink_target, action): what becomes of each link by the policy; escaping: absolute, or out of the folder."""
    rows = entries.where("is_link").withColumn("_bad", link_problem(F.col("path"), F.col("target")).isNotNull())
    return rows.select("path", F.col("target").alias("symlink_target"), link_action(F.lit(policy), F.col("_bad")).alias("action"))


def chunk_hashes(files: DataFrame, root: str, chunk: int = CHUNK_SIZE) -> DataFrame:
    """(path, hash, chunkhashes, size, mtime, mode) of (path, size, mtime, mode): the XXH3-128 of a file, or those of its chunks if it has several.

    Files and chunks are dealt over tasks before they are read: a walk has the files of one folder together. A file that has gone, or has grown shorter than its size says, raises.
    """
    import xxhash

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                h, left = xxhash.xxh3_128(), length
                with open(f"{plain(root)}/{path}", "rb") as f:
                    f.seek(offset)
                    while left:
                        data = f.read(min(STEP, left))
                        if not data:
                            raise OSError(f"{path} is shorter than it was")
                        h.update(data)
                        left -= len(data)
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "index", "size", "mtime", "mode")), pa.array(digests, pa.string())], names=["path", "index", "size", "mtime", "mode", "digest"])

    whole = F.array(F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("offset"), F.col("size").alias("length")))
    parts = F.when(needs_chunks(F.col("size"), chunk), chunk_list(F.col("size"), chunk)).otherwise(whole)
    rows = files.select("path", "size", "mtime", "mode", F.explode(parts).alias("c")).select("path", "size", "mtime", "mode", "c.*")
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.repartition(n, "path", "index").mapInArrow(hashed, "path string, index long, size long, mtime long, mode int, digest string")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("index", "digest"))), lambda x: x["digest"])  # of one file's chunks
    found = each.groupBy("path", "size", "mtime", "mode").agg(listed.alias("_all"))
    many = needs_chunks(F.col("size"), chunk)
    return found.select("path", F.when(~many, F.get("_all", F.lit(0))).alias("hash"), F.when(many, F.col("_all")).alias("chunkhashes"), "size", "mtime", "mode")


def snapshot(entries: DataFrame, root: str, keep: Column | None = None, hashed: bool = True, policy: str = "exclude_escaping", chunk: int = CHUNK_SIZE) -> tuple[DataFrame, DataFrame]:
    """(files, dirs) of a walk: rows of the model. Not hashed: hashes are null. Links that the policy follows are not read here, they are left out."""
    own = entries if keep is None else entries.where(keep)
    regular = own.where("NOT is_dir AND NOT is_link").select("path", "size", "mtime", "mode")
    none = F.lit(None).cast("string")
    content = chunk_hashes(regular, root, chunk) if hashed else regular.select("path", none.alias("hash"), F.lit(None).cast("array<string>").alias("chunkhashes"), "size", "mtime", "mode")
    files = content.select("path", "hash", "size", "mtime", is_executable(F.col("mode")).alias("runnable"), "chunkhashes", none.alias("symlink_target"), F.lit(False).alias("deleted"))
    null = lambda t: F.lit(None).cast(t)
    kept = links(own, policy).where("action = 'preserve'")
    as_links = kept.select("path", none.alias("hash"), null("long").alias("size"), null("long").alias("mtime"), F.lit(False).alias("runnable"), null("array<string>").alias("chunkhashes"), "symlink_target", F.lit(False).alias("deleted"))
    return files.unionByName(as_links), own.where("is_dir").select("path", F.lit(False).alias("deleted"))


def expand(listed: DataFrame, entries: DataFrame, keep: Column | None = None) -> DataFrame:
    """(path, size, given) of listed paths against a walk: files themselves, folders with all files below them that pass the filter, and missing
    ones with a null size; given is the path in the list."""
    files = entries.where("NOT is_dir").select("path", "size")
    own = listed.select(F.col("path").alias("given")).distinct()
    kinds = own.join(entries.select(F.col("path").alias("given"), "is_dir"), "given", "left")
    alone = kinds.where("NOT coalesce(is_dir, false)").select("given").join(files.withColumnRenamed("path", "given"), "given", "left").select(F.col("given").alias("path"), "size", "given")
    below = files if keep is None else files.where(keep)
    tops = below.select("path", "size", F.explode(paths.ancestors(F.col("path"))).alias("given"))
    return alone.unionByName(tops.join(kinds.where("is_dir").select("given"), "given").select("path", "size", "given"))


def directory_status(manifest: DataFrame, dirs: DataFrame, entries: DataFrame, root: str, keep: Column | None = None, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """((path, status) of files, (path, deleted) of folders that came or went) of a walk against a manifest; links count on neither side.

    The filter is applied to both sides. Not hashed: by size and time; hashed: files of equal size are read and compared by content.
    """
    own = entries if keep is None else entries.where(keep)
    known = manifest.where("symlink_target IS NULL")
    known = known if keep is None else known.where(keep)
    regular = own.where("NOT is_dir AND NOT is_link").select("path", "size", "mtime", "mode")
    if hashed:
        same = regular.join(diff.latest(known).select("path", "size"), ["path", "size"], "left_semi")
        read = chunk_hashes(same, root).select("path", F.coalesce("hash", F.lit("")).alias("hash"))
        status = diff.hash_status(known, regular.join(read, "path", "left").withColumn("hash", F.coalesce("hash", F.lit("-"))))
    else:
        status = diff.fast_status(known, regular)
    live = dirs if keep is None else dirs.where(keep)
    there = own.where("is_dir").select("path")
    known_dirs = live.where("NOT coalesce(deleted, false)").select("path") if "deleted" in live.columns else live.select("path")
    came = there.join(known_dirs, "path", "left_anti").select("path", F.lit(False).alias("deleted"))
    return status, came.unionByName(known_dirs.join(there, "path", "left_anti").select("path", F.lit(True).alias("deleted")))


def status_statistics(status: DataFrame, entries: DataFrame, hashed: DataFrame | None = None) -> DataFrame:
    """One row: files and folders scanned, files and bytes hashed, and files by status."""
    scanned = entries.agg(F.count_if(~F.col("is_dir")).alias("files_scanned"), F.count_if("is_dir").alias("dirs_scanned"))
    counts = status.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("added", "modified", "deleted", "unchanged")])
    read = (hashed.agg(F.count("*").alias("files_hashed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_hashed"))) if hashed is not None else None
    joined = scanned.join(F.broadcast(counts))
    return joined.join(F.broadcast(read)) if read is not None else joined.withColumns({"files_hashed": F.lit(0).cast("long"), "bytes_hashed": F.lit(0).cast("long")})


def difference(parent: DataFrame, parent_dirs: DataFrame, entries: DataFrame, root: str, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, dirs) of a difference manifest of a walk against a snapshot: only files whose size or time has changed are read and hashed."""
    own = entries if keep is None else entries.where(keep)
    regular = own.where("NOT is_dir AND NOT is_link").select("path", "size", "mtime", "mode")
    known = parent.where("symlink_target IS NULL")
    status = diff.fast_status(known if keep is None else known.where(keep), regular)
    changed = chunk_hashes(regular.join(status.where("status IN ('added', 'modified')").select("path"), "path", "left_semi"), root)
    put = changed.select("path", "hash", "size", "mtime", is_executable(F.col("mode")).alias("runnable"), "chunkhashes", F.lit(False).alias("deleted"))
    gone = status.where("status = 'deleted'").select("path", F.lit(True).alias("deleted"))
    files = put.unionByName(gone, allowMissingColumns=True)
    return files, directory_status(parent, parent_dirs, entries, root, keep)[1]


def output_manifest(entries: DataFrame, recorded: DataFrame, root: str, within: list[str] | None = None) -> DataFrame:
    """Files of a walk that are newer than recorded (path, mtime), or not recorded, hashed: what a job has put out, of all folders or of some."""
    from quillon.operators.changes import outputs_since

    own = entries.where("NOT is_dir AND NOT is_link")
    if within is not None:
        tops = F.array(*[F.lit(w.rstrip("/")) for w in within])
        own = own.where(F.exists(tops, lambda w: paths.under(F.col("path"), w)))
    found = chunk_hashes(outputs_since(own.select("path", "size", "mtime", "mode"), recorded), root)
    return found.select("path", "hash", "size", "mtime", is_executable(F.col("mode")).alias("runnable"), "chunkhashes")
