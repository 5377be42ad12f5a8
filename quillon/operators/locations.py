"""Storage locations, asset groups and path mapping: longest-prefix matches as equi-joins over the ancestors of a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths


def _found(items: DataFrame, path: Column, places: DataFrame, key: str) -> DataFrame:
    """(_path, _found) of the distinct paths below or at a place: the deepest place's row. Profiles are small, and Spark broadcasts them by
    their size; a larger table is joined by shuffle on a place, which a split of skewed joins serves."""
    distinct = items.select(path.alias("_path")).where("_path IS NOT NULL").distinct()
    tops = distinct.select("_path", F.explode(paths.ancestors(F.col("_path"), itself=True)).alias("_top"))
    hits = tops.join(places.where(F.col(key).isNotNull()), F.col("_top") == F.col(key))
    return hits.groupBy("_path").agg(F.max_by(F.struct(*places.columns), F.struct(F.length(key), *places.columns)).alias("_found"))


def deepest(items: DataFrame, path: Column, places: DataFrame, key: str = "place") -> DataFrame:
    """Items with the deepest place (column `key`) that is the path or above it by whole components, null if none is. Every row stays;
    of places with the same key the greatest row counts."""
    joined = items.withColumn("_own", path).join(_found(items, path, places, key), F.col("_own") == F.col("_path"), "left")
    return joined.select(*items.columns, *[F.col(f"_found.{c}").alias(c) for c in places.columns])


def below_any(items: DataFrame, path: Column, places: DataFrame, key: str = "place", negate: bool = False) -> DataFrame:
    """The items below or at one of the places, or (negate) the others, among them those without a path. Repeated rows stay."""
    hit = _found(items, path, places.select(key).distinct(), key).select("_path")
    return items.withColumn("_own", path).join(hit, F.col("_own") == F.col("_path"), "left_anti" if negate else "left_semi").select(*items.columns)


def _placed(assets: DataFrame, local: DataFrame, shared: DataFrame) -> DataFrame:
    """Distinct assets that are not shared, with their deepest local location and _group: that location, or the topmost directory."""
    own = below_any(assets.distinct(), F.col("path"), shared, negate=True)
    placed = deepest(own, F.col("path"), local.select("place", "location"))
    top = F.concat(F.lit("/"), F.substring_index(F.substr("path", F.lit(2)), "/", 1))
    return placed.withColumn("_group", F.coalesce("place", top))


def _root(low: Column, high: Column) -> Column:
    """The longest common directory, '/' where only that is common."""
    common = paths.common_directory(low, high)
    return F.when(common == "", "/").otherwise(common)


def asset_groups(assets: DataFrame, local: DataFrame, shared: DataFrame) -> DataFrame:
    """(location, root, inputs, outputs, references): numbers of assets (path, kind) that are not shared, by their deepest local location, or by
    their topmost directory where they have none; root is the location, or the longest common directory of the group."""
    keyed = _placed(assets, local, shared)
    parts = paths.components(paths.parent(F.col("path")))
    count = lambda k: F.count_if(F.col("kind") == k).alias(k + "s")
    grouped = keyed.groupBy("_group", "location").agg(F.max("place").alias("_place"), F.min(parts).alias("_low"), F.max(parts).alias("_high"), count("input"), count("output"), count("reference"))
    return grouped.select("location", F.coalesce("_place", _root(F.col("_low"), F.col("_high"))).alias("root"), "inputs", "outputs", "references")


def group_members(assets: DataFrame, local: DataFrame, shared: DataFrame) -> DataFrame:
    """(location, root, kind, path): each group's assets as rows, so that a group may be of any size; the sets of a group are its rows of a kind.

    root is here the longest path that all members are at or below, whatever the location. Rows of a written table come in the order of
    groups by root, then location, those without one first, if sorted by (root, location): nulls are first in Spark's order.
    """
    keyed = _placed(assets, local, shared)
    parts = paths.components(F.col("path"))
    roots = keyed.groupBy("_group", "location").agg(F.min(parts).alias("_low"), F.max(parts).alias("_high")).select("_group", F.col("location").alias("_location"), _root(F.col("_low"), F.col("_high")).alias("root"))
    both = keyed.join(roots, (keyed["_group"] == roots["_group"]) & keyed["location"].eqNullSafe(roots["_location"]))
    return both.select("location", "root", "kind", "path")


def checked_assets(assets: DataFrame, present: DataFrame, shared: DataFrame, strict: bool = True) -> DataFrame:
    """(path, kind, was) of assets against what is there (path, type: file or directory): kind is null for what takes no part in groups.

    was: shared, missing, directory, or null for what is in order. Inputs only are looked up. Strict: the first missing input or directory
    given as a file raises; else missing inputs become references, and directories take no part.
    """
    hit = below_any(assets.select("path").distinct(), F.col("path"), shared).select("path", F.lit(True).alias("_shared"))
    there = present.groupBy("path").agg(F.max("type").alias("_type"))
    joined = assets.join(hit, "path", "left").join(there, "path", "left")
    was = F.when(F.col("_shared"), "shared").when((F.col("kind") == "input") & F.col("_type").isNull(), "missing").when((F.col("kind") == "input") & (F.col("_type") == "directory"), "directory")
    if strict:
        bad = was.isin("missing", "directory")
        was = F.when(bad, F.raise_error(F.concat(F.lit("misconfigured input, "), was, F.lit(": "), F.col("path")))).otherwise(was)
    rows = joined.select("path", F.col("kind").alias("_kind"), was.alias("was"))
    kind = F.when(F.col("was") == "missing", "reference").when(F.col("was").isNull(), F.col("_kind"))
    return rows.select("path", kind.alias("kind"), "was")


def without_redundant(known: DataFrame) -> DataFrame:
    """Distinct paths that have no other of them above."""
    all_ = known.select("path").distinct()
    above = all_.select("path", F.explode(paths.ancestors(F.col("path"))).alias("_top"))
    redundant = above.join(all_.select(F.col("path").alias("_top")), "_top", "left_semi").select("path").distinct()
    return all_.join(redundant, "path", "left_anti")


def classify_known(items: DataFrame, known: DataFrame) -> DataFrame:
    """Adds is_known: at or below a known prefix."""
    hit = below_any(items, F.col("path"), known.select(F.col("path").alias("place"))).select("path").distinct().withColumn("_k", F.lit(True))
    return items.join(hit, "path", "left").withColumn("is_known", F.coalesce("_k", F.lit(False))).drop("_k")


def mapped_one(path: Column, source: str, destination: str, fold_case: bool = False) -> Column:
    """A path below or at source, moved to destination; null for others. fold_case: as on Windows, cases are alike and '\\' is '/'."""
    plain = (lambda p: F.lower(paths.to_posix(p))) if fold_case else (lambda p: p)
    root = F.lit(source.rstrip("/") if not fold_case else source.replace("\\", "/").rstrip("/"))
    inside = (plain(path) == plain(root)) | F.startswith(plain(path), F.concat(plain(root), F.lit("/")))
    rest = paths.to_posix(path) if fold_case else path
    return F.when(inside, F.concat(F.lit(destination.rstrip("/")), F.substr(rest, F.length(root) + 1)))


def mapping_rules(source: DataFrame, destination: DataFrame) -> DataFrame:
    """(name, source_path, destination_path) of locations that both profiles name."""
    return source.select("name", F.col("path").alias("source_path")).join(destination.select("name", F.col("path").alias("destination_path")), "name")


def map_paths(items: DataFrame, rules: DataFrame, fold_case: bool = False, strict: bool = False) -> DataFrame:
    """Adds mapped: the path with its deepest rule's source replaced; null where no rule holds, or with strict an error.

    fold_case: rules are sought by lower-cased paths with '/', as for Windows; what is below the source keeps its case.
    """
    plain = (lambda p: F.lower(paths.to_posix(p))) if fold_case else (lambda p: p)
    own = rules.select(plain(F.col("source_path")).alias("source_path"), "destination_path")
    found = deepest(items, plain(F.col("path")), own, "source_path")
    rest = F.substr(paths.to_posix(F.col("path")) if fold_case else F.col("path"), F.length("source_path") + 1)
    mapped = F.when(F.col("source_path").isNotNull(), F.concat("destination_path", rest))
    if strict:
        mapped = F.coalesce(mapped, F.raise_error(F.concat(F.lit("no mapping rule for "), F.coalesce("path", F.lit("null")))))
    return found.withColumn("mapped", mapped).drop("source_path", "destination_path")
