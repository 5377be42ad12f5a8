"""Incremental work on streams of changes and of output manifests, each micro-batch merged into a table in a folder.

A merged table is kept by versions: a batch writes the next version whole and then names it; a repeated batch writes the same again. So a lost
driver or executor leaves a whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    kept = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in kept])


def _version(spark: SparkSession, folder: str, before: int) -> str | None:
    """Path of the greatest version below `before` that is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(n.removeprefix("v")) for n in names if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return f"{folder}/v{max(n for n in done if n < before)}" if any(n < before for n in done) else None


def merge_into(folder: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: the table in the folder with a batch put over it, of each key the last by order."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = _version(spark, folder, batch_id)
        every = batch if last is None else spark.read.parquet(last).unionByName(batch)
        latest_by(every, keys, order).write.mode("overwrite").parquet(f"{folder}/v{batch_id}")

    return merge


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """The table as of the last complete batch."""
    path = _version(spark, folder, 1 << 62)
    if path is None:
        raise ValueError(f"nothing has been merged into {folder}")
    return spark.read.parquet(path)


def merge_outputs(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str] = ("root", "path"), order: Sequence[str] = ("last_modified", "manifest_id")):
    """Start merging a stream of files of output manifests (root, path, last_modified, manifest_id, ...): what each root's download has to hold."""
    return stream.writeStream.foreachBatch(merge_into(folder, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def net_changes(events: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, path, state) of each window of event time that has ended: whether the last of a path's changes in it left it there or deleted it."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    last = timed.where(F.col("op").isin("create", "modify", "delete")).groupBy(F.window(time, width), "path").agg(F.max_by("op", F.struct(time, "event_id")).alias("op"))
    return last.select(F.col("window.start").alias("start"), "path", F.when(F.col("op") == "delete", "deleted").otherwise("there").alias("state"))
