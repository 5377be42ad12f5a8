"""Content hashes. XXH3-128 is no Spark function and runs on Arrow batches; md5 and sha2 stay in the JVM."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def xxh128(value: Column) -> Column:
    """32 lower-case hex digits of XXH3-128 with seed 0; null for null."""

    def digest(values: pd.Series) -> pd.Series:
        import xxhash

        return values.map(lambda v: None if v is None else xxhash.xxh3_128_hexdigest(bytes(v)))

    return F.pandas_udf(digest, "string")(value.cast("binary"))


def fold(hexadecimal: Column) -> Column:
    """The upper 64 bits of 32 hex digits XOR the lower ones, as 16 hex digits."""
    half = lambda at: F.conv(F.substring(hexadecimal, at, 16), 16, -10).cast("long")
    return F.lpad(F.lower(F.hex(F.bitwiseXOR(half(1), half(17)) if hasattr(F, "bitwiseXOR") else half(1).bitwiseXOR(half(17)))), 16, "0")


def unique_directory(path: Column) -> Column:
    """A stable directory name for a path: a prefix and 20 hex digits of SHAKE-256."""

    def named(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else "assetroot-" + hashlib.shake_256(v.encode()).hexdigest(10))

    return F.pandas_udf(named, "string")(path)
