"""WARC archives: write, normalise from one gzip stream a file to one gzip member a record with an offset index, read back.

`write` makes archives as crawlers often leave them, a single gzip stream each. `normalise` inflates each stream once, front to back, rewrites every
record as a member of its own and writes a sidecar index beside the archive (a line a record: offset, length, type, record id, target).
`read` goes by the sidecars: a task opens the archives that it is given itself and takes each member by its place. What passes between tasks are
the archives' names; their bytes are neither shuffled nor collected. Archives are closed at ARCHIVE_BYTES of records.
Records whose payloads are equal and of at least `least` bytes are stored once: the smallest id is the response, the others are revisits of it.

Each attempt of a task writes files of its own names, and only those are read that a finished task has listed: what a lost, repeated or
speculative task has left does no harm. Paths may be of any store that both Spark and pyarrow.fs know (file, hdfs, s3, gs).

Cases: a null html is an empty payload; a null url has no target header; a null page_id is written as such, and is nobody's response but its own;
rows that repeat a response's id and payload are responses too; very long payloads make an archive of their own, and a task holds one record at a
time; no pages make no archive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import join_groups, materialise, new_path, open_folder, table

ARCHIVE_BYTES = 16_000_000
LEVEL = 4
ID = "urn:quillon:page:"
FILES = "name string, records long, bytes long"
INDEX = "start long, length long, record_type string, record_id string, target string"
#: Tasks, at most, over which archives are dealt; bytes read at a time.
MOST_TASKS, STEP = 10_000, 1 << 18
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    large = F.octet_length("html") >= least
    groups = rows.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups, "payloads")
    joined = join_groups(rows, groups, ["digest"], "n", pages.count(), F.col("page_id"), "left")
    refers = F.when(large & (F.col("page_id") > F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the response's HTTP head, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def headers(text: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in text.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of inflated bytes, holding one record at a time."""
    held = bytearray()
    for data in stream:
        held += data
        while (end := held.find(b"\r\n\r\n")) >= 0:
            own = headers(bytes(held[:end]))
            whole = end + 4 + int(own["Content-Length"]) + 4
            if len(held) < whole:
                break
            yield own, bytes(held[:whole])
            del held[:whole]
    if held:
        raise ValueError("an archive ends within a record")


def inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """A file of one or more gzip members, given and returned some bytes at a time."""
    d = None
    for data in pieces:
        while data:
            d = d or zlib.decompressobj(31)
            yield d.decompress(data)
            data = d.unused_data
            if d.eof:
                d = None
    if d is not None:
        raise ValueError("an archive is cut short")


def _file_rows(names: list[str], records: list[int], sizes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["name", "records", "bytes"])


def write(planned: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of one gzip stream each; FILES of them."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_folder(folder)
        fs.create_dir(at, recursive=True)
        part, attempt, count, file, rows, size = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, None, 0, 0

        def close() -> pa.RecordBatch:
            file.write(z.flush())
            total = file.tell()
            file.close()
            return _file_rows([name], [rows], [total])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                if file is None:
                    name = f"part-{part:06d}-{count:05d}-{attempt}.warc.gz"
                    file, z, rows, size = fs.open_output_stream(f"{at}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, date)
                file.write(z.compress(data))
                size, rows = size + len(data), rows + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    file, count = None, count + 1
        if file is not None:
            yield close()

    return materialise(planned.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(written, FILES), "archives")


def _dealt(files: DataFrame) -> DataFrame:
    """The names of archives, some to each task."""
    return files.select("name").repartition(max(1, min(files.count(), MOST_TASKS)), "name")


def _sidecar(name: str) -> str:
    return name.replace(".warc.gz", ".index")


def normalise(spark: SparkSession, folder: str, files: DataFrame, to: str) -> DataFrame:
    """Archives of one member a record, with a sidecar index beside each; FILES of them."""

    def pieces(file) -> Iterator[bytes]:
        while data := file.read(STEP):
            yield data

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, source), (out_fs, target), attempt = open_folder(folder), open_folder(to), TaskContext.get().taskAttemptId()
        out_fs.create_dir(target, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                own, count, at = name.replace(".warc.gz", f"-{attempt}.warc.gz"), 0, 0
                with fs.open_input_stream(f"{source}/{name}", compression=None) as file, out_fs.open_output_stream(f"{target}/{own}", compression=None) as out, out_fs.open_output_stream(f"{target}/{_sidecar(own)}", compression=None) as index:
                    for head, whole in records(inflate(pieces(file))):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        line = (at, len(member), head["WARC-Type"], head["WARC-Record-ID"].strip("<>"), head.get("WARC-Target-URI", ""))
                        index.write(("\t".join(map(str, line)) + "\n").encode("utf-8", "surrogatepass"))
                        out.write(member)
                        at, count = at + len(member), count + 1
                yield _file_rows([own], [count], [at])

    return materialise(_dealt(files).mapInArrow(rewritten, FILES), "records")


def index(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """INDEX of the archives listed, from their sidecars, with the archive's name."""
    rows = spark.read.schema(INDEX).option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.index").csv(folder)
    named = rows.select(F.regexp_replace("_metadata.file_name", r"\.index$", ".warc.gz").alias("name"), "*")
    return named.join(files.select("name"), "name", "left_semi")


def read(spark: SparkSession, folder: str, files: DataFrame, keep_payload: bool = False) -> DataFrame:
    """RECORDS by the sidecars: each member is taken by its place alone. A response's digest and length are those of what was read."""

    def number(x: str | None) -> int | None:
        own = None if x is None else x.strip("<>").removeprefix(ID)
        return None if own in (None, "None") else int(own)

    def parsed(whole: bytes) -> tuple:
        cut = whole.index(b"\r\n\r\n")
        own = headers(whole[:cut])
        block = whole[cut + 4 : -4]
        end = block.index(b"\r\n\r\n")
        http, payload = headers(block[:end]), block[end + 4 :]
        size, digest = int(http["Content-Length"]), own["WARC-Payload-Digest"].removeprefix("sha256:")
        if own["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
            raise ValueError(f"{own['WARC-Record-ID']} has not the payload that its headers tell of")
        return number(own["WARC-Record-ID"]), size, digest, own["WARC-Type"], number(own.get("WARC-Refers-To")), payload.decode("utf-8", "surrogatepass") if keep_payload else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, source = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_file(f"{source}/{name}") as file, fs.open_input_stream(f"{source}/{_sidecar(name)}", compression=None) as lines:
                    for line in lines.read().splitlines():
                        start, length = map(int, line.split(b"\t", 2)[:2])
                        file.seek(start)
                        whole = zlib.decompress(file.read(length), 31)
                        rows.append(parsed(whole))
                        held += len(whole) if keep_payload else 200
                        if held > ARCHIVE_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return _dealt(files).mapInArrow(taken, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """RECORDS of pages after writing, normalising and reading; folder: where the archives go, by default in the shared folder."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    files = write(plan_records(pages), f"{folder}/raw")
    if files.isEmpty():
        return spark.createDataFrame([], RECORDS)
    return read(spark, f"{folder}/records", normalise(spark, f"{folder}/raw", files, f"{folder}/records"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("payload")


ORACLE_SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
}
