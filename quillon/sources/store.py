"""A store of content by its hash, in a folder of any kind that pyarrow.fs knows: `<folder>/<hash>.<algorithm>`.

Objects are written and read where their rows are. An object is written under another name and moved, so that a lost or repeated task leaves
whole objects only; one that is there with the same size is not written again. What is not whole yet stands in hidden folders, one a task:
tasks that made their files in the folder of the objects would wait for each other.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.shared import open_folder, plain

ALGORITHM = "xxh128"
STEP = 1 << 22
#: Keys of a listing that a task holds at a time.
LISTED = 10_000


def _local_files(top: str) -> Iterator[tuple[str, os.DirEntry]]:
    """(folder below top with its slash, entry) of a local folder's files, one after the other, hidden ones and folders left out."""
    folders = [""]
    while folders:
        at = folders.pop()
        try:
            entries = os.scandir(f"{top}/{at}")
        except FileNotFoundError:
            continue
        with entries:
            for e in entries:
                if e.name.startswith("."):
                    continue
                if e.is_dir():
                    folders.append(f"{at}{e.name}/")
                elif e.is_file():
                    yield at, e


def _keys(fs, at: str, prefix: str) -> Iterator[list[tuple]]:
    """(key, size, last modified in seconds) of the files below a prefix, in lists of LISTED; of local ones only the key."""
    from pyarrow.fs import FileSelector, FileType, LocalFileSystem

    top = f"{at}/{prefix}".rstrip("/")
    if isinstance(fs, LocalFileSystem):
        names = ((f"{prefix}/{folder}{e.name}".lstrip("/"), None, None) for folder, e in _local_files(top))
    else:
        found = fs.get_file_info(FileSelector(top, recursive=True, allow_not_found=True))
        names = ((f.path[len(at) + 1 :], f.size, int(f.mtime.timestamp()) if f.mtime else None) for f in found if f.type == FileType.File and "/." not in f"/{f.path[len(at) + 1 :]}")
    while some := list(islice(names, LISTED)):
        yield some


def objects(spark: SparkSession, folder: str, prefixes: tuple[str, ...] = ("",)) -> DataFrame:
    """(key, size, last_modified in seconds) of the files below a folder, empty ones too; contents are not read.

    Each of the prefixes, folders below it, is listed by a task of its own. A local folder is listed by names, some at a time, which are then
    dealt over tasks that look at the files: those that have gone by then are left out. So are files that are being written.
    """
    kinds = {"key": pa.string(), "size": pa.int64(), "last_modified": pa.int64()}
    schema = "key string, size long, last_modified long"
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_folder(folder)
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                yield from map(as_batch, _keys(fs, at, prefix))

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, at = open_folder(folder)
        for batch in batches:
            rows = []
            for key, size, modified in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    s = os.stat(f"{at}/{key}") if size is None else None
                except FileNotFoundError:
                    continue
                rows.append((key, s.st_size, int(s.st_mtime)) if s else (key, size, modified))
            yield as_batch(rows)

    tops = spark.range(0, len(prefixes), 1, len(prefixes)).select(F.get(F.array(*[F.lit(p.strip("/")) for p in prefixes]), F.col("id")).alias("prefix"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tops.mapInArrow(listed, schema).repartition(n, "key").mapInArrow(looked, schema)


def head(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """keys (key) with size and last_modified of the object, null where there is none."""
    return keys.join(listing, "key", "left")


def contains(asked: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds is_there to (key) or (key, size): whether there is an object of that key, and of that size where one is given."""
    own = listing.groupBy("key").agg(F.max("size").alias("_size"))
    there = F.col("_size").isNotNull()
    if "size" in asked.columns:
        there = there & (F.col("size").isNull() | (F.col("size") == F.col("_size")))
    return asked.join(own, "key", "left").withColumn("is_there", F.coalesce(there, F.lit(False))).drop("_size")


def publish(manifests: DataFrame, folder: str) -> DataFrame:
    """Write manifests (key, json) below the folder: (key, hash, size), hash being that of the text's bytes. An earlier one of a key is replaced."""
    import xxhash

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_folder(folder)
        with _unfinished(fs, at) as own:
            for batch in batches:
                hashes, sizes = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = text.encode()
                    fs.create_dir(f"{at}/{key}".rpartition("/")[0], recursive=True)
                    sizes.append(_write(fs, own, f"{at}/{key}", iter([data])))
                    hashes.append(xxhash.xxh3_128_hexdigest(data))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string()), pa.array(sizes, pa.int64())], names=["key", "hash", "size"])

    return manifests.select("key", "json").mapInArrow(written, "key string, hash string, size long")


def _size(fs, path: str) -> int | None:
    info = fs.get_file_info(path)
    return info.size if info.is_file else None


@contextmanager
def _unfinished(fs, folder: str) -> Iterator[str]:
    """A hidden folder below the folder, for a task's files that are not whole yet."""
    own = f"{folder}/.{uuid.uuid4().hex}"
    fs.create_dir(own, recursive=True)
    try:
        yield own
    finally:
        fs.delete_dir(own)


def _write(fs, own: str, path: str, pieces: Iterator[bytes]) -> int:
    """Bytes of a file that is written in `own`, a folder of the task's, and moved."""
    attempt, size = f"{own}/.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(attempt, compression=None) as f:
        for data in pieces:
            size += f.write(data)
    fs.move(attempt, path)
    return size


def put_rows(rows: DataFrame, folder: str, algorithm: str = ALGORITHM) -> DataFrame:
    """Store each row's content: the rows with (hash, size, written) in its place, null where it is null. Contents go to the tasks once.

    Written: not there before. Equal contents of a task are written once, of several tasks by the first.
    """
    rest = [c for c in rows.columns if c != "content"]
    out = {"hash": pa.string(), "size": pa.int64(), "written": pa.bool_()}

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        fs, at = open_folder(folder)
        with _unfinished(fs, at) as own:
            for batch in batches:
                kept, contents = [pa.array(c.to_pylist(), c.type) for c in batch.columns[:-1]], batch.column(len(rest))
                del batch  # whose one buffer has all columns: it is not held while the next comes
                found, done = [], set()
                for content in contents:
                    if not content.is_valid:
                        found.append((None, None, None))
                        continue
                    data = memoryview(content.as_buffer())
                    digest = xxhash.xxh3_128_hexdigest(data)
                    new = digest not in done and _size(fs, f"{at}/{digest}.{algorithm}") != len(data)
                    if new:
                        _write(fs, own, f"{at}/{digest}.{algorithm}", iter([data]))
                    done.add(digest)
                    found.append((digest, len(data), new))
                    del data
                del contents, content
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array([x[i] for x in found], kind) for i, kind in enumerate(out.values())]], names=[*rest, *out])

    schema = rows.select(*rest).selectExpr("*", "CAST(NULL AS STRING) AS hash", "CAST(NULL AS LONG) AS size", "CAST(NULL AS BOOLEAN) AS written").schema
    return rows.select(*rest, "content").mapInArrow(stored, schema)


def put(contents: DataFrame, folder: str, algorithm: str = ALGORITHM) -> DataFrame:
    """Store (content): (hash, size, written) of the distinct contents; written: by one of the rows."""
    stored = put_rows(contents.select("content"), folder, algorithm).where("hash IS NOT NULL")
    return stored.groupBy("hash", "size").agg(F.max("written").alias("written"))


def upload(plan: DataFrame, root: str, folder: str, algorithm: str = ALGORITHM) -> DataFrame:
    """Do what transfer.upload_plan says: (path, index, hash, written) of the rows to be uploaded, each a range of bytes of a file below root.

    A range that the file no longer has raises.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_folder(folder)

        def pieces(path: str, offset: int, length: int) -> Iterator[bytes]:
            with open(f"{plain(root)}/{path}", "rb") as f:
                f.seek(offset)
                while length:
                    data = f.read(min(STEP, length))
                    if not data:
                        raise OSError(f"{path} is shorter than its manifest says")
                    length -= len(data)
                    yield data

        with _unfinished(fs, at) as own:
            for batch in batches:
                written = []
                for path, offset, length, digest in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length", "hash")), strict=True):
                    new = _size(fs, f"{at}/{digest}.{algorithm}") != length
                    if new:
                        _write(fs, own, f"{at}/{digest}.{algorithm}", pieces(path, offset, length))
                    written.append(new)
                yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("index"), batch.column("hash"), pa.array(written, pa.bool_())], names=["path", "index", "hash", "written"])

    return plan.where("action = 'upload'").select("path", "index", "offset", "length", "hash").mapInArrow(sent, "path string, index long, hash string, written boolean")


def retrieve(asked: DataFrame, folder: str, algorithm: str = ALGORITHM) -> DataFrame:
    """Adds content to (hash, offset, length): the bytes of that range, short at the object's end; a null length reads to the end, a null offset
    from the start; content is null where there is no object. Only the range is read."""

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_folder(folder)
        for batch in batches:
            found = []
            for digest, offset, length in zip(*(batch.column(c).to_pylist() for c in ("hash", "offset", "length")), strict=True):
                try:
                    f = digest and fs.open_input_file(f"{at}/{digest}.{algorithm}")
                except FileNotFoundError:
                    f = None
                if not f:
                    found.append(None)
                    continue
                with f:
                    f.seek(min(offset or 0, f.size()))
                    found.append(f.read() if length is None else f.read(length))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "content"])

    schema = asked.selectExpr("*", "CAST(NULL AS BINARY) AS content").schema
    return asked.mapInArrow(fetched, schema)


def download(parts: DataFrame, folder: str, to: str, algorithm: str = ALGORITHM) -> DataFrame:
    """Write files below `to` from stored content: (target, size) of parts (target, index, hash), each file's objects one after the other.

    A file's list of chunks is gathered, its bytes are not. A missing object raises; an earlier file is replaced as a whole.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, at), (out, base) = open_folder(folder), open_folder(to)

        def pieces(digests: list[str]) -> Iterator[bytes]:
            for digest in digests:
                with fs.open_input_stream(f"{at}/{digest}.{algorithm}", compression=None) as f:
                    while data := f.read(STEP):
                        yield data

        made_folder = ""
        with _unfinished(out, base) as own:
            for batch in batches:
                sizes = []
                for target, digests in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    parent = f"{base}/{target}".rpartition("/")[0]
                    if parent != made_folder:
                        out.create_dir(parent, recursive=True)
                        made_folder = parent
                    sizes.append(_write(out, own, f"{base}/{target}", pieces(digests)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["target", "size"])

    listed = F.transform(F.sort_array(F.collect_list(F.struct("index", "hash"))), lambda x: x["hash"])
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a list is small, its bytes are not: few rows are not to be one task
    return parts.repartition(n, "target").groupBy("target").agg(listed.alias("hashes")).mapInArrow(made, "target string, size long")


def stored_manifests(spark: SparkSession, folder: str, roots: DataFrame, strict: bool = True) -> DataFrame:
    """(manifest_id, root, json) of the manifests below a folder, by the hash of their root in the file's name; roots: (root, root_hash).

    One read of many files. A file of no root raises with strict, and has a null root otherwise.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("manifest_id"), F.col("value").alias("json"))
    keyed = rows.withColumn("root_hash", F.regexp_extract(F.substring_index("manifest_id", "/", -1), "([0-9a-f]{32})", 1))
    joined = keyed.join(roots.groupBy("root_hash").agg(F.min("root").alias("root")), "root_hash", "left")
    root = F.coalesce("root", F.raise_error(F.concat(F.lit("no asset root for "), F.col("manifest_id"))).cast("string")) if strict else F.col("root")
    return joined.select("manifest_id", root.alias("root"), "json")
