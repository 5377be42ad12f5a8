"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, join_groups, materialise


def _minima(pairs: DataFrame) -> DataFrame:
    """Of (u, v): the smallest of u and its neighbours, and how many neighbours there are."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another node; component is the smallest node reachable.

    A hub's edges are dealt over several tasks (join_groups), its minimum is pre-aggregated, each round is written to the shared
    folder. Only a count and a checksum a round reach the driver. Null ends and loops are no edges.
    """
    now = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_groups(both, _minima(both), ["u"], "n", 2 * mark[0], F.col("v")).where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")  # here u > v always
        count = large.count()
        small = join_groups(large, _minima(large), ["u"], "n", count, F.col("v"))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after = materialise(small.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u != v").distinct(), "small")
        discard(now)
        discard(large)
        now, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
