"""Relations of the manifest model and its constants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the data model: bytes of a chunk, size from which a transfer is large, days that cache entries live, tolerance of times in microseconds.
CHUNK_SIZE = 256 * 1024 * 1024
LARGE_FILE = 80 * 1024 * 1024
HASH_CACHE_DAYS = 14
CHECK_CACHE_DAYS = 30
MTIME_TOLERANCE_US = 1

FILE = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("hash", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("runnable", T.BooleanType()),
        T.StructField("chunkhashes", T.ArrayType(T.StringType())),
        T.StructField("symlink_target", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)
DIR = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("deleted", T.BooleanType())])
EVENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType())])


def file_row(path: Column, hash: Column | None = None, size: Column | None = None, mtime: Column | None = None, runnable: Column | None = None, chunkhashes: Column | None = None, symlink_target: Column | None = None, deleted: bool = False) -> list[Column]:
    """The columns of a FILE row: of a file by its hash or chunk hashes, or of neither as not hashed yet, a link by its target, or a deletion."""
    given = {"path": path, "hash": hash, "size": size, "mtime": mtime, "runnable": runnable, "chunkhashes": chunkhashes, "symlink_target": symlink_target, "deleted": F.lit(deleted)}
    none = {"runnable": F.lit(False)}
    return [(given[f.name] if given[f.name] is not None else none.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in FILE.fields]
