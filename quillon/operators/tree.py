"""Directory trees as tables, reads by byte range, overlays and read-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import paths
from quillon.functions.chunks import touched_chunks
from quillon.schema import CHUNK_SIZE


def nodes(files: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """(path, parent, name, type, size): files, given directories and all directories that paths imply; the root is ''. Paths are the
    key: numbers in one order would need all nodes in one task."""
    live = files.where("NOT coalesce(deleted, false)") if "deleted" in files.columns else files
    above = live.select(F.explode(paths.ancestors(F.col("path"))).alias("path"))
    if dirs is not None:
        above = above.union(dirs.select(F.explode(paths.ancestors(F.col("path"), itself=True))))
    folders = above.distinct().select("path", F.lit("directory").alias("type"), F.lit(None).cast("long").alias("size"))
    all_ = live.select("path", F.lit("file").alias("type"), "size").union(folders)
    return all_.select("path", paths.parent(F.col("path")).alias("parent"), paths.name(F.col("path")).alias("name"), "type", "size")


def listing(tree: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """Children after changes: nodes without the deleted paths, with the added ones; an added node replaces one of the same path."""
    kept = tree.join(deleted.select("path").union(added.select("path")).distinct(), "path", "left_anti")
    new = added.select("path", paths.parent(F.col("path")).alias("parent"), paths.name(F.col("path")).alias("name"), "type", "size")
    return kept.unionByName(new)


def directory_sizes(files: DataFrame) -> DataFrame:
    """(path, n_files, bytes) of every directory over everything below it."""
    return files.select(F.explode(paths.ancestors(F.col("path"))).alias("path"), "size").groupBy("path").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def read_ranges(reads: DataFrame, files: DataFrame, chunk: int = CHUNK_SIZE) -> DataFrame:
    """(read_id, path, index, start, length): the chunk parts that reads (read_id, path, offset, length) need; cut at the file's end."""
    joined = reads.join(files.select("path", "size"), "path")
    length = F.greatest(F.least(F.col("length"), F.col("size") - F.col("offset")), F.lit(0))
    e = joined.select("read_id", "path", F.explode(touched_chunks(F.col("offset"), length, chunk)).alias("c"))
    return e.select("read_id", "path", F.col("c.index").alias("index"), F.col("c.start").alias("start"), F.col("c.length").alias("length"))


def access(trace: DataFrame) -> DataFrame:
    """(block, first, n): first access and number of accesses of each block."""
    return trace.groupBy("block").agg(F.min("ts").alias("first"), F.count("*").alias("n"))


def ranked_by_first(blocks: DataFrame, budget_us: int) -> DataFrame:
    return blocks.where(F.col("first") <= budget_us).withColumn("priority", 1 / (1 + F.col("first") / F.lit(1e6)))


def ranked_by_weight(blocks: DataFrame, time_weight: float = 0.7) -> DataFrame:
    """priority = w * (1 - normed first access) + (1 - w) * normed frequency. The norms are one aggregate row, joined."""
    norm = blocks.agg(F.min("first").alias("_lo"), F.max("first").alias("_hi"), F.max("n").alias("_n"))
    time = F.when(F.col("_hi") > F.col("_lo"), (F.col("first") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return blocks.join(F.broadcast(norm)).withColumn("priority", time_weight * (1 - time) + (1 - time_weight) * F.col("n") / F.col("_n")).drop("_lo", "_hi", "_n")


def within_budget(blocks: DataFrame, budget: int, *order, chunk: int = CHUNK_SIZE) -> DataFrame:
    """The first blocks in the order that fit into a memory budget: each takes a chunk."""
    return blocks.orderBy(*order).limit(budget // chunk)


def hit_rate(events: DataFrame) -> DataFrame:
    """Hits of all accesses in per cent, 0 if there are none."""
    hits = F.count_if("hit")
    return events.agg(hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.try_divide(hits * 100.0, F.count("*")), F.lit(0.0)).alias("hit_rate"))


def lookup(listing_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (wanted) with the node of that path whatever the case, null where there is none; of several the least path."""
    found = listing_.groupBy(F.lower("path").alias("_key")).agg(F.min_by(F.struct(*listing_.columns), "path").alias("_r"))
    return asked.withColumn("_key", F.lower(paths.to_posix(F.col("wanted")))).join(found, "_key", "left").select(*asked.columns, "_r.*")


def without_below(changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows (path) that are not at or below a removed path."""
    above = changed.select("path", F.explode(paths.ancestors(F.col("path"), itself=True)).alias("_above"))
    gone = above.join(removed.select(F.col("path").alias("_above")).distinct(), "_above", "left_semi").select("path").distinct()
    return changed.join(gone, "path", "left_anti")


def sampled_keys(cache: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n of the keys, chosen by a hash of key and seed: to be checked against what is stored."""
    return cache.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def first_per_name(listing_: DataFrame) -> DataFrame:
    """One child a parent and name whatever the case: the least path."""
    w = Window.partitionBy("parent", F.lower("name")).orderBy("path")
    return listing_.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
