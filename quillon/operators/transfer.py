"""Planning of uploads and downloads against what is stored, their statistics, and the caches that spare them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.chunks import chunk_list, needs_chunks
from quillon.functions.keys import content_key
from quillon.operators.skew import join_groups
from quillon.schema import CHUNK_SIZE, LARGE_FILE


def uploads(files: DataFrame, root: str, prefix: str, chunk: int = CHUNK_SIZE) -> DataFrame:
    """(path, index, offset, length, hash, key): a row a file, or a chunk of a chunked file; deleted files and links have no content.

    A file with neither a hash nor chunk hashes raises. Of chunks and chunk hashes the shorter list counts.
    """
    rows = files.where("NOT coalesce(deleted, false) AND symlink_target IS NULL")
    nothing = F.raise_error(F.concat(F.lit("no content hash: "), F.coalesce("path", F.lit("null")))).cast("boolean")
    many = F.coalesce(F.col("chunkhashes").isNotNull() | F.when(F.col("hash").isNotNull(), F.lit(False)), nothing)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("offset"), F.col("size").alias("length")))
    parts = F.when(many, F.arrays_zip(chunk_list(F.col("size"), chunk).alias("c"), F.col("chunkhashes").alias("h"))).otherwise(F.arrays_zip(whole.alias("c"), F.array("hash").alias("h")))
    # Outer, as the optimizer lets a plain explode evaluate its array a second time, in a filter that looks whether it is empty.
    e = rows.select("path", F.explode_outer(parts).alias("p")).where("p.h IS NOT NULL AND p.c IS NOT NULL")
    return e.select("path", F.col("p.c.index").alias("index"), F.col("p.c.offset").alias("offset"), F.col("p.c.length").alias("length"), F.col("p.h").alias("hash")).withColumn("key", content_key(root, prefix, F.col("hash")))


def upload_plan(parts: DataFrame, seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds action: skip what the cache has seen (key) or what is stored with the same size (key, size); of equal keys one is uploaded.

    One aggregate over parts, seen and stored, reduced before its shuffle, tells all of a key; parts join it once, with a key that many
    parts have, as that of the empty file, dealt over tasks. If a key is stored more than once, its greatest size counts.
    """
    none = F.lit(None).cast("long")
    stored_or_seen = seen.select("key", F.lit(True).alias("_s"), none.alias("_l")).unionByName(stored.select("key", F.lit(False).alias("_s"), F.col("size").cast("long").alias("_l")))
    every = parts.select("key", F.struct("path", "index").alias("_at"), F.lit(False).alias("_s"), none.alias("_l")).unionByName(stored_or_seen, allowMissingColumns=True)
    known = every.groupBy("key").agg(F.min("_at").alias("_first"), F.max("_s").alias("_seen"), F.max("_l").alias("_size")).where("_first IS NOT NULL")
    joined = join_groups(parts, known, "key")
    there = F.coalesce("_seen", F.lit(False)) | F.coalesce(F.col("_size") == F.col("length"), F.lit(False))
    own = (F.col("_first.path") == F.col("path")) & (F.col("_first.index") == F.col("index"))
    return joined.withColumn("action", F.when(there, "skip_stored").when(own, "upload").otherwise("skip_repeated")).select(*parts.columns, "action")


def transfer_statistics(plan: DataFrame) -> DataFrame:
    moved = F.col("action") == "upload"
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("length")).otherwise(0)), F.lit(0)).cast("long")
    return plan.agg(
        F.countDistinct("path").alias("files_processed"), count(moved).alias("files_transferred"), count(~moved).alias("files_skipped"),
        size(moved).alias("bytes_transferred"), size(~moved).alias("bytes_skipped"),
    )


def size_classes(files: DataFrame, threshold: int = LARGE_FILE) -> DataFrame:
    return files.groupBy(F.when(F.col("size") < threshold, "small").otherwise("large").alias("class")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def download_plan(files: DataFrame, existing: DataFrame, conflict: str = "overwrite") -> DataFrame:
    """(path, target, action): what happens to each file whose place may be taken. conflict: skip, overwrite or create_copy.

    Links are always replaced. A copy gets the least free number, as `stem (n).ext`.
    """
    if conflict not in ("skip", "overwrite", "create_copy"):
        raise ValueError(f"unknown conflict policy {conflict!r}")
    taken = existing.select("path").distinct().withColumn("_taken", F.lit(True))
    rows = files.where("NOT coalesce(deleted, false)").join(taken, "path", "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)) & F.col("symlink_target").isNull())
    if conflict != "create_copy":
        return rows.select("path", F.when(F.col("_taken") & F.lit(conflict == "skip"), None).otherwise(F.col("path")).alias("target"), F.when(F.col("_taken"), conflict).otherwise("write").alias("action"))
    ext = r"^(.+?)(\.[^./]+)?$"
    copy = existing.select(F.regexp_extract("path", r"^(.+) \((\d+)\)(\.[^./]*)?$", 1).alias("_s"), F.regexp_extract("path", r"^(.+) \((\d+)\)(\.[^./]*)?$", 2).alias("_n"), F.regexp_extract("path", r"^(.+) \((\d+)\)(\.[^./]*)?$", 3).alias("_e"))
    used = copy.where("_n RLIKE '^[1-9][0-9]{0,4}$'").groupBy("_s", "_e").agg(F.collect_set(F.col("_n").cast("int")).alias("_used"))
    keyed = rows.withColumn("_s", F.regexp_extract("path", ext, 1)).withColumn("_e", F.regexp_extract("path", ext, 2))
    found = keyed.join(used, ["_s", "_e"], "left")
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.coalesce(F.size("_used"), F.lit(0)) + 1), F.coalesce("_used", F.array().cast("array<int>"))))
    target = F.when(F.col("_taken"), F.concat("_s", F.lit(" ("), free.cast("string"), F.lit(")"), "_e")).otherwise(F.col("path"))
    return found.select("path", target.alias("target"), F.when(F.col("_taken"), "create_copy").otherwise("write").alias("action"))


def upsert(cache: DataFrame, entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The cache with entries put over it: of each key the latest by `order`."""
    both = cache.unionByName(entries)
    kept = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*kept), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in kept])


def lookup(asked: DataFrame, cache: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Asked rows with the cache's other columns, null where there is no entry or it has ended (at its last moment it has)."""
    return asked.join(cache.where(F.col("expires_at") > now), keys, "left")


def cleanup(cache: DataFrame, now: Column) -> DataFrame:
    """Without the entries that ended before now; one that ends now is neither returned by lookup nor removed here."""
    return cache.where(~(F.col("expires_at") < now))


def seen_keys(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """Keys last seen within `days`; a time that is no number counts as long ago."""
    return cache.where(F.expr("try_cast(last_seen_time AS double)") >= now - F.lit(days * 86400)).select("s3_key")


def mark_uploaded(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """The check cache (s3_key, last_seen_time) with the keys seen now. Times are text, seconds."""
    new = keys.select("s3_key", now.cast("string").alias("last_seen_time")).distinct()
    return cache.join(new.select("s3_key"), "s3_key", "left_anti").select("s3_key", "last_seen_time").unionByName(new)


def forget(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The check cache without the keys."""
    return cache.join(keys.select("s3_key"), "s3_key", "left_anti")


def forget_old(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """The check cache without what was last seen more than `days` ago; a time that is no number counts as 0."""
    seen = F.coalesce(F.expr("try_cast(last_seen_time AS double)"), F.lit(0.0))
    return cache.where(seen >= now - F.lit(days * 86400))


def bucket_and_key(cached: Column) -> Column:
    """Struct of bucket and key of a cached `bucket/key`; without a slash all is the bucket."""
    return F.struct(F.substring_index(cached, "/", 1).alias("bucket"), F.when(F.instr(cached, "/") > 0, F.regexp_replace(cached, "^[^/]*/", "")).otherwise("").alias("key"))


def cache_counts(cache: DataFrame, now: Column) -> DataFrame:
    """One row: entries, and those that lookup would still return."""
    return cache.agg(F.count("*").alias("n"), F.count_if(F.col("expires_at") > now).alias("n_live"))


def group_statistics(plan: DataFrame, by: str) -> DataFrame:
    """transfer_statistics by group, with a last row for all (null)."""
    moved = F.col("action") == "upload"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0)).alias
    return plan.groupingSets([[by], []], by).agg(
        F.count_if(moved).alias("n_transferred"), F.count_if(~moved).alias("n_skipped"), total(moved)("bytes_transferred"), total(~moved)("bytes_skipped"), F.grouping(by).alias("is_total"),
    )


def upload_strategy(size: Column, chunk: int = CHUNK_SIZE) -> Column:
    return F.when(needs_chunks(size, chunk), "chunked").otherwise("single")


def is_large(size: Column, chunk: int = CHUNK_SIZE) -> Column:
    """Whether a file of that size is one of large_files."""
    return needs_chunks(size, chunk)


def large_files(files: DataFrame, chunk: int = CHUNK_SIZE) -> DataFrame:
    return files.where(is_large(F.col("size"), chunk))
