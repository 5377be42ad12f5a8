"""Access streams: keys seen for the first time, and counts by window of event time. State is bounded by the watermark.

Times without a zone are taken in the session's zone, as watermarks need an instant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, delay: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def first_seen(events: DataFrame, keys: Sequence[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One row of each key: what is to be uploaded or checked. A key that comes again after `delay` may pass again."""
    return _timed(events, time, delay).dropDuplicatesWithinWatermark(list(keys))


def access_counts(events: DataFrame, by: Sequence[str], time: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, *by, n) of each window that has ended; rows later than `delay` are left out."""
    counted = _timed(events, time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")
