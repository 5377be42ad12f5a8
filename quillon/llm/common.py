"""What the operators of this package share: word rule, shared tables, hot-key joins, exact ranks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without these: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: A key that holds more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000
#: Parts over which the rows of a hot key are dealt.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of a text's words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, or one in the warehouse where that is unset.

    A warehouse on the machine's own disk is seen by all only if there is one machine: on a cluster it is refused.
    """
    kept = spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        kept = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillon_shared"
        scheme = spark._jvm.org.apache.hadoop.fs.Path(kept).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()
        if scheme == "file" and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return kept.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder within is deleted at the end: to be put around making a result and writing it elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialise_at(df: DataFrame, name: str) -> str:
    """Write to the shared folder: the path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, and is computed once."""
    return df.sparkSession.read.schema(df.schema).parquet(materialise_at(df, name))


def read_shared(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """In a task: batches of at most `rows` rows of the Parquet files below a path of the shared folder, one file after the other."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, at = open_folder(path)
    for f in sorted(x.path for x in fs.get_file_info(FileSelector(at)) if x.base_name.endswith(".parquet")):
        with fs.open_input_file(f) as data:
            yield from pq.ParquetFile(data).iter_batches(rows)


def open_folder(path: str):
    """In a task: (file system, path in it) of a path of the shared folder, whether it has a scheme or not."""
    from pyarrow.fs import FileSystem

    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return FileSystem.from_uri(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """Join rows to one record a group (column `size`: its rows) where one key may hold any share of the rows.

    Keys of more than total / HOT_SHARE rows are fewer than HOT_SHARE; the driver learns their hashes alone. Their rows are dealt over
    SALTS parts by `spread` and their record is repeated in each part. All other keys join as they are.
    """
    groups = materialise(groups, "groups")
    of = F.xxhash64(*keys)
    hashes = [r[0] for r in groups.where(F.col(size) * HOT_SHARE > F.lit(total)).select(of).distinct().collect()]
    if not hashes:
        return rows.join(groups, list(keys), how)
    hot = of.isin(hashes)
    left = rows.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    right = groups.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
