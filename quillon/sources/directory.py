"""Directory trees as tables: a data source that walks in parallel, one part for some of the folder's entries.

The folder must be mounted alike on all machines. Links are not followed; the folder itself is no row. `directory_tree` gives
(path, size, mtime, mode, is_dir, is_link, target), path relative and with '/', mtime in microseconds. Entries that go while the walk runs are left out.

Option `depth`: folders of so many levels are listed when the read is planned, and their contents are dealt to the parts (default 1).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.sources.shared import plain

ENTRY = "path string, size long, mtime long, mode int, is_dir boolean, is_link boolean, target string"
#: Entries below which a part begins; parts at most.
MOST_PARTS = 10_000


def entry(root: str, path: str) -> tuple | None:
    """ENTRY of a relative path; null if it is gone."""
    try:
        s = os.lstat(os.path.join(root, path))
        link = stat.S_ISLNK(s.st_mode)
        target = os.readlink(os.path.join(root, path)) if link else None
    except FileNotFoundError:
        return None
    folder = stat.S_ISDIR(s.st_mode)
    return path, None if folder or link else s.st_size, s.st_mtime_ns // 1000, stat.S_IMODE(s.st_mode), folder, link, target


class Part(InputPartition):
    def __init__(self, tops: Sequence[str], whole: bool):
        self.tops, self.whole = list(tops), whole


class DirectoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.depth = plain(options["path"]).rstrip("/") or "/", int(options.get("depth", 1))

    def partitions(self) -> list[Part]:
        """Entries of the upper levels by themselves, and each folder of the last of these with all below it."""
        alone, folders = [], [""]
        for _ in range(self.depth):
            below = []
            for folder in folders:
                for e in sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name):
                    path = f"{folder}/{e.name}".lstrip("/")
                    alone.append(path)
                    if e.is_dir(follow_symlinks=False):
                        below.append(path)
            folders = below
        n = max(1, -(-len(folders) // MOST_PARTS))
        m = max(1, -(-len(alone) // MOST_PARTS), 1000)
        return [Part(alone[i : i + m], False) for i in range(0, len(alone), m)] + [Part(folders[i : i + n], True) for i in range(0, len(folders), n)] or [Part([], False)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.whole:
            yield from (e for e in (entry(self.root, p) for p in partition.tops) if e)
            return
        for top in partition.tops:
            folders = [top]
            while folders:
                base = folders.pop()
                try:
                    names = os.scandir(os.path.join(self.root, base))
                except OSError:
                    continue
                with names:
                    for e in names:  # one at a time: a folder may have any number
                        path = f"{base}/{e.name}".lstrip("/")
                        if e.is_dir(follow_symlinks=False):
                            folders.append(path)
                        found = entry(self.root, path)
                        if found:
                            yield found


class DirectoryTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "directory_tree"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(self.options)


def walk(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """ENTRY rows of everything below a folder."""
    spark.dataSource.register(DirectoryTree)
    return spark.read.format("directory_tree").option("path", plain(root)).option("depth", str(depth)).load()


def stated(paths: DataFrame, root: str) -> DataFrame:
    """ENTRY of listed relative paths (column path), each looked at where its row is; what is missing has null in all but the path."""

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
        for batch in batches:
            rows = [entry(plain(root), p) or (p, *[None] * 6) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=[x.split(" ")[0] for x in ENTRY.split(", ")])

    return paths.select("path").mapInArrow(looked, ENTRY)


def checked_inputs(paths: DataFrame, root: str) -> DataFrame:
    """(path, was, size): file, directory or missing. A link counts as what it is itself: a file."""
    was = F.when(F.col("is_dir").isNull(), "missing").when(F.col("is_dir"), "directory").otherwise("file")
    return stated(paths, root).select("path", was.alias("was"), "size")
