"""Chunk arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.schema import CHUNK_SIZE


def needs_chunks(size: Column, chunk: int = CHUNK_SIZE) -> Column:
    return F.lit(chunk > 0) & (size > chunk)


def chunk_count(size: Column, chunk: int = CHUNK_SIZE) -> Column:
    """At least one; the last chunk may be short."""
    return F.lit(1).cast("long") if not chunk else F.greatest(F.ceil(size / F.lit(chunk)).cast("long"), F.lit(1).cast("long"))


def chunk_list(size: Column, chunk: int = CHUNK_SIZE) -> Column:
    """Array of (index, offset, length)."""
    step = F.lit(chunk).cast("long")
    return F.transform(
        F.sequence(F.lit(0).cast("long"), chunk_count(size, chunk) - 1),
        lambda i: F.struct(i.alias("index"), (i * step).alias("offset"), F.least(step, size - i * step).alias("length")),
    )


def touched_chunks(offset: Column, length: Column, chunk: int = CHUNK_SIZE) -> Column:
    """Array of (index, start, length): the part of each chunk that a read of `length` bytes from `offset` touches."""
    step = F.lit(chunk).cast("long")
    first, last = F.floor(offset / step), F.floor((offset + length - 1) / step)
    return F.when(length > 0, F.transform(
        F.sequence(first, last),
        lambda i: F.struct(i.alias("index"), F.greatest(offset - i * step, F.lit(0)).alias("start"), (F.least(offset + length, (i + 1) * step) - F.greatest(offset, i * step)).alias("length")),
    ))


def primary_hash(hash: Column, chunkhashes: Column) -> Column:
    """A file's hash or that of its first chunk, '' if it has neither."""
    return F.coalesce(hash, F.get(chunkhashes, F.lit(0)), F.lit(""))


def block_key(hash: Column, chunkhashes: Column, offset: Column, chunk: int = CHUNK_SIZE) -> Column:
    """The hash of the content that a byte of a file is in: of the whole file or of its chunk; null beyond the last."""
    at = F.floor(offset / F.lit(chunk)).cast("int")
    return F.when(hash.isNotNull(), hash).otherwise(F.get(chunkhashes, at))
