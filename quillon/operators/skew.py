"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Inner join of rows to one record a key.

    Groups that are small are broadcast by their size at run time. Else Spark's adaptive execution deals the rows of a hot key over tasks, with
    its record in each. It does so only where both sides of the join are shuffles, which an aggregate that is joined on its own key is not: so
    the join is on the key within a struct, for which both sides are shuffled.
    """
    own = groups.where(F.col(key).isNotNull()).select(F.struct(key).alias("_key"), *[c for c in groups.columns if c != key])
    return rows.withColumn("_key", F.struct(key)).join(own, "_key").drop("_key")
