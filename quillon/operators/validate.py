"""Rules that manifests must keep, as one expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.schema import CHUNK_SIZE


def link_problem(path: Column, target: Column) -> Column:
    """Why a link may not be: null if it may. Targets are relative and stay within the root."""
    resolved = paths.normalize(paths.join_path(paths.parent(path), target))
    return F.when(paths.is_absolute(target) | target.startswith("//"), "AbsoluteTarget").when((resolved == "..") | resolved.startswith("../"), "EscapesRoot")


def file_problem(chunk: int = CHUNK_SIZE, allow_unhashed: bool = False) -> Column:
    """The first rule that a file row breaks, or null."""
    c = F.col
    some = lambda n: c(n).isNotNull()
    kinds = some("hash").cast("int") + some("chunkhashes").cast("int") + some("symlink_target").cast("int")
    deleted = F.coalesce("deleted", F.lit(False))
    return (
        F.when(deleted & ((kinds > 0) | F.coalesce("runnable", F.lit(False)) | some("size") | some("mtime")), "DeletedWithFields")
        .when(deleted, None)
        .when(kinds > 1, "SeveralContents")
        .when((kinds == 0) & F.lit(not allow_unhashed), "NoContent")
        .when(c("symlink_target").isNull() & (c("size").isNull() | c("mtime").isNull()), "NoSizeOrTime")
        .when(some("chunkhashes") & ~(c("size") > chunk), "ChunkedTooSmall")
        .when(some("chunkhashes") & (F.size("chunkhashes") != F.ceil(c("size") / chunk)), "WrongChunkCount")
        .when(some("symlink_target"), link_problem(c("path"), c("symlink_target")))
    )


#: What becomes of a link by policy, fixed: (policy, escaping) to what is done.
LINK_POLICY = (
    ("collapse_escaping", True, "follow"), ("collapse_escaping", False, "preserve"),
    ("collapse_all", True, "follow"), ("collapse_all", False, "follow"),
    ("exclude_escaping", True, "exclude"), ("exclude_escaping", False, "preserve"),
    ("exclude_all", True, "exclude"), ("exclude_all", False, "exclude"),
    ("preserve", True, "preserve"), ("preserve", False, "preserve"),
    ("transitive_include_targets", True, "preserve"), ("transitive_include_targets", False, "preserve"),
)


def link_action(policy: Column, escaping: Column) -> Column:
    """follow, preserve or exclude; transitive_include_targets takes the target too."""
    out = F.lit(None).cast("string")
    for p, e, action in reversed(LINK_POLICY):
        out = F.when((policy == p) & (escaping == F.lit(e)), action).otherwise(out)
    return out
