"""Net effect of streams of changes on files and directories, in closed form over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _before(what: Column, key: str, order: list[str]) -> Column:
    """The last non-null value before a row; a running frame keeps one value, whatever the key's rows."""
    return F.last(what, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def net_changes(events: DataFrame, key: str = "path", order: list[str] = ("seq",)) -> DataFrame:
    """(key, created, modified, deleted) of events with op create, modify or delete; keys without a net change are left out.

    A create takes back a delete. A delete of what was created leaves nothing, also of an earlier delete. A modification counts
    if the path was not created before it, until a delete that finds it not created.
    """
    life = F.when(F.col("op").isin("create", "delete"), F.col("op"))
    at = F.struct(*order)
    e = events.withColumn("_was_created", F.coalesce(_before(life, key, order) == "create", F.lit(False)))
    created, deleted = F.col("op") == "create", (F.col("op") == "delete")
    bare = deleted & ~F.col("_was_created")
    folded = e.groupBy(key).agg(
        F.max_by(F.struct("op", "_was_created"), F.when(created | deleted, at)).alias("_last"),
        F.max(F.when((F.col("op") == "modify") & ~F.col("_was_created"), at)).alias("_modified"),
        F.max(F.when(bare, at)).alias("_bare"),
    )
    out = folded.select(
        key,
        F.coalesce(F.col("_last.op") == "create", F.lit(False)).alias("created"),
        (F.col("_modified").isNotNull() & (F.col("_bare").isNull() | (F.col("_bare") < F.col("_modified")))).alias("modified"),
        F.coalesce((F.col("_last.op") == "delete") & ~F.col("_last._was_created"), F.lit(False)).alias("deleted"),
    )
    return out.where("created OR modified OR deleted")


def with_renames(events: DataFrame) -> DataFrame:
    """A rename (path to new_path) as a delete and a create of the same moment."""
    parts = F.when(F.col("op") == "rename", F.array(F.struct(F.col("path").alias("path"), F.lit("delete").alias("op"), F.lit(0).alias("part")), F.struct(F.col("new_path").alias("path"), F.lit("create").alias("op"), F.lit(1).alias("part"))))
    return events.withColumn("_e", F.explode(F.coalesce(parts, F.array(F.struct("path", "op", F.lit(0).alias("part")))))).select("seq", F.col("_e.path").alias("path"), F.col("_e.op").alias("op"), F.col("_e.part").alias("part"))


def file_states(events: DataFrame, original: DataFrame, key: str = "path", order: list[str] = ("seq",)) -> DataFrame:
    """(key, state): new, modified or deleted against the original paths; what was made and removed again has no state."""
    folded = events.where(F.col("op").isin("create", "modify", "delete")).groupBy(key).agg(F.max_by("op", F.struct(*order)).alias("_op"))
    joined = folded.join(original.select(key).distinct().withColumn("_original", F.lit(True)), key, "left")
    was = F.coalesce("_original", F.lit(False))
    state = F.when(F.col("_op") == "delete", F.when(was, "deleted")).when(was, "modified").otherwise("new")
    return joined.select(key, state.alias("state")).where("state IS NOT NULL")


def directory_states(events: DataFrame, original: DataFrame, key: str = "path", order: list[str] = ("seq",)) -> DataFrame:
    """(key, state): new or deleted against the original directories; an original one that is made again has no state."""
    folded = events.where(F.col("op").isin("create", "delete")).groupBy(key).agg(F.max_by("op", F.struct(*order)).alias("_op"))
    joined = folded.join(original.select(key).distinct().withColumn("_original", F.lit(True)), key, "left")
    was = F.coalesce("_original", F.lit(False))
    state = F.when((F.col("_op") == "delete") & was, "deleted").when((F.col("_op") == "create") & ~was, "new")
    return joined.select(key, state.alias("state")).where("state IS NOT NULL")


def summary(states: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    return states.agg(count("new"), count("modified"), count("deleted"), F.count("*").alias("n_total"), (F.count("*") > 0).alias("has_changes"))


def outputs_since(walked: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files of a walk (path, mtime) that are newer than recorded, or not recorded: what a job has put out. Two rows of a path count as the later."""
    known = recorded.groupBy("path").agg(F.max("mtime").alias("_known"))
    return walked.join(known, "path", "left").where("_known IS NULL OR mtime > _known").select(*walked.columns)


def difference_rows(states: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a difference manifest from (path, state): new and modified files as they are now, and a bare marker for each deleted one.

    A new or modified path that is not among the files has gone since, and is left out.
    """
    put = files.join(states.where("state IN ('new', 'modified')").select("path"), "path", "left_semi").withColumn("deleted", F.lit(False))
    gone = states.where("state = 'deleted'").select("path", F.lit(True).alias("deleted"))
    return put.unionByName(gone, allowMissingColumns=True)


def in_directory(states: DataFrame, directory: str, state: str | None = "new") -> DataFrame:
    """(name, path, state) of the changed files that lie in a directory itself."""
    top = directory.rstrip("/")
    own = states.where(F.regexp_replace("path", "/?[^/]*$", "") == top)
    return (own if state is None else own.where(F.col("state") == state)).select(F.substring_index("path", "/", -1).alias("name"), "path", "state")
