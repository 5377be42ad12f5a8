"""Finding output manifests in an object listing: filter, parse, the latest of each task, match to roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.skew import join_groups

#: Fixed key forms: task outputs, step outputs, and the session action in a folder's name.
TASK_KEY = r"step-[^/]+/(task-[^/]+)/([^/]+_sessionaction-[^/]+)/[^/]+_output"
STEP_KEY = r"step-[^/]+/([^/]+_sessionaction-[^/]+)/[^/]+_output"
SESSION_ACTION = r"(sessionaction-[^/]+)"


def output_objects(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("key").endswith("_output") | F.col("key").endswith("_output.json"))


def parse_keys(objects: DataFrame) -> DataFrame:
    """(key, last_modified, task_id, session_folder, session_action_id); task keys first, then step keys; others are left out.

    One search finds the part of the key that has the form; its names are cut at the slashes.
    """
    form = F.coalesce(F.nullif(F.regexp_extract("key", TASK_KEY, 0), F.lit("")), F.nullif(F.regexp_extract("key", STEP_KEY, 0), F.lit("")))
    found = objects.select("key", F.coalesce("last_modified", F.lit(0).cast("long")).alias("last_modified"), F.filter(F.array(form), lambda f: f.isNotNull()).alias("_form"))
    rows = found.select("key", "last_modified", F.explode("_form").alias("_form"))
    names = F.split("_form", "/")
    rows = rows.select("key", "last_modified", F.when(F.size(names) == 4, names[1]).alias("task_id"), F.get(names, F.size(names) - 2).alias("session_folder"))
    return rows.withColumn("session_action_id", F.regexp_extract("session_folder", SESSION_ACTION, 1))


def latest_per_task(parsed: DataFrame) -> DataFrame:
    """All rows of the session folder that each task's last modified row lies in, ties to the greater key; rows without task all stay.

    The winner comes from a partial aggregate, joined back; a window would sort each task's rows. A task with many rows is dealt over tasks of Spark.
    """
    own = parsed.where("task_id IS NOT NULL")
    last = own.groupBy("task_id").agg(F.max_by("session_folder", F.struct("last_modified", "key")).alias("_last"))
    tasks = join_groups(own, last, "task_id").where("session_folder = _last").select(*parsed.columns)
    return tasks.union(parsed.where("task_id IS NULL"))


def match_roots(parsed: DataFrame, roots: DataFrame, strict: bool = False) -> DataFrame:
    """(session_action_id, root_index, key): by the 32-digit root hash in a key's last part; the first root and then the last key win.

    A key of no root raises with strict, and is left out otherwise.
    """
    token = F.regexp_extract("key", r"([0-9a-f]{32})[^/]*$", 1)
    first = roots.groupBy("root_hash").agg(F.min("root_index").alias("root_index"))
    joined = parsed.withColumn("root_hash", token).join(first, "root_hash", "left" if strict else "inner")
    if strict:
        lost = F.raise_error(F.concat(F.lit("no asset root for "), F.col("key"))).cast("long")
        joined = joined.withColumn("root_index", F.coalesce(F.col("root_index").cast("long"), lost))
    return joined.groupBy("session_action_id", "root_index").agg(F.max("key").alias("key"))


def pivot_roots(matched: DataFrame, n_roots: int) -> DataFrame:
    """(session_action_id, keys): an array with a place for each root, null where there is no manifest."""
    by = F.map_from_entries(F.collect_list(F.struct("root_index", "key")))
    return matched.groupBy("session_action_id").agg(by.alias("_m")).select("session_action_id", F.transform(F.sequence(F.lit(0), F.lit(n_roots - 1)), lambda i: F.try_element_at("_m", i.cast("long"))).alias("keys"))


def by_session_action(parsed: DataFrame) -> DataFrame:
    """Of each session action the task keys, or the step keys where it has no task key."""
    level = F.when(F.col("task_id").isNotNull(), 0).otherwise(1)
    best = F.min(level).over(Window.partitionBy("session_action_id"))
    return parsed.withColumn("_best", best).where(level == F.col("_best")).drop("_best")
