"""Folders and files that the driver and all executors see."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or in the warehouse where that is unset and there is one machine or the warehouse is shared."""
    kept = spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        kept = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillon_folders"
        scheme = spark._jvm.org.apache.hadoop.fs.Path(kept).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()
        if scheme == "file" and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{kept.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def plain(path: str) -> str:
    """A file: URI as a path of the file system."""
    return re.sub("^file:(//)?(?=/)", "", path)


def open_folder(path: str):
    """In a task: (file system, path in it)."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(plain(path))
