"""Manifests in their JSON form as tables of directories and files.

Paths may stand as `$N/rest`, N being the place of a directory of the same manifest. A directory may refer to an earlier one, which is
followed in the manifest's own row; files are then joined to directories on (manifest, N), so that a manifest with many files is spread over tasks.

The older form has `paths` alone, without directories and flags.

Cases: missing and wrongly typed fields are null, flags are then false; a reference to no directory, or a directory to a later one, raises;
no `dirs` or `files` is an empty list; text that is no JSON object raises. Versions are told and checked by `versions` and `checked` alone.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = r"(?s)^\$(\d+)/(.*)$"
#: Fixed names of the forms.
VERSIONS = ("2023-03-03", "2025-12")
SPEC_VERSIONS = (
    "absolute-manifest-snapshot-beta-2025-12", "absolute-manifest-diff-beta-2025-12",
    "relative-manifest-snapshot-beta-2025-12", "relative-manifest-diff-beta-2025-12",
)
FILE = "path string, hash string, size long, mtime long, runnable boolean, chunkhashes array<string>, symlink struct<target: string>, deleted boolean"
OLDER_FILE = "path string, hash string, size long, mtime long"
MANIFEST = f"struct<specificationVersion: string, manifestVersion: string, paths: array<struct<{OLDER_FILE}>>, hashAlg: string, totalSize: long, parentManifestHash: string, dirs: array<struct<path: string, deleted: boolean>>, files: array<struct<{FILE}>>>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(manifest_id, json) of the files at a path; manifest_id is the file's own path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("manifest_id"), F.col("value").alias("json"))


def _parsed(manifests: DataFrame) -> DataFrame:
    m = F.from_json("json", MANIFEST)
    return manifests.select("manifest_id", F.when(F.get_json_object("json", "$").isNull(), F.raise_error(F.lit("a manifest is no JSON"))).otherwise(m).alias("m"))


def versions(manifests: DataFrame) -> DataFrame:
    """(manifest_id, version, spec_version): by the specification's name, else by the older field; an unknown or missing one raises."""
    spec, older = F.col("m.specificationVersion"), F.col("m.manifestVersion")
    unknown = F.raise_error(F.concat(F.lit("unknown manifest version: "), F.coalesce(spec, older, F.lit("none")))).cast("string")
    version = F.when(spec.isNotNull(), F.when(spec.isin(*SPEC_VERSIONS), VERSIONS[1])).when(older.isin(*VERSIONS), older)
    rows = _parsed(manifests).select("manifest_id", F.coalesce(version, unknown).alias("version"), spec.alias("spec_version"))
    return rows.withColumn("spec_version", F.when(F.col("version") == VERSIONS[1], F.coalesce("spec_version", F.lit(SPEC_VERSIONS[2]))))


def checked(manifests: DataFrame) -> DataFrame:
    """The manifests again; one of no known version raises."""
    return manifests.join(versions(manifests).where("version IS NOT NULL").select("manifest_id"), "manifest_id", "left_semi")


def spec_version(form: Column) -> Column:
    """Struct of path_style (absolute, relative) and type (snapshot, diff) of a version's name; null for unknown ones."""
    parts = F.split(form, "-")
    return F.when(form.isin(*SPEC_VERSIONS), F.struct(parts[0].alias("path_style"), parts[2].alias("type")))


def spec_name(path_style: Column, kind: Column) -> Column:
    name = F.concat_ws("-", path_style, F.lit("manifest"), kind, F.lit("beta-2025-12"))
    return F.when(name.isin(*SPEC_VERSIONS), name)


def narrowed(headers: DataFrame, path_style: str | None = None, kind: str | None = None) -> DataFrame:
    """The headers of manifests that must be absolute or relative, snapshot or diff; another one raises, as does a diff without its parent's hash."""
    v = spec_version(F.col("spec_version"))
    bad = F.coalesce(v["path_style"] != path_style, F.lit(True)) if path_style else F.lit(False)
    if kind:
        bad = bad | F.coalesce(v["type"] != kind, F.lit(True))
    bad = bad | F.coalesce((v["type"] == "diff") & F.col("parent_manifest_hash").isNull(), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("not the kind of manifest that is asked for: "), F.coalesce("spec_version", F.lit("none")))).cast("string")
    return headers.withColumn("spec_version", F.when(bad, wrong).otherwise(F.col("spec_version")))


def restyled(headers: DataFrame, path_style: str) -> DataFrame:
    """The headers as those of absolute or relative paths; the paths themselves go by select.join_prefix and select.subtree."""
    return headers.withColumn("spec_version", spec_name(F.lit(path_style), spec_version(F.col("spec_version"))["type"]))


def header_problem(files: DataFrame, dirs: DataFrame, headers: DataFrame) -> DataFrame:
    """(manifest_id, problem): a snapshot that deletes, a diff without its parent's hash; null for what is in order."""
    gone = lambda rows: rows.where(F.coalesce("deleted", F.lit(False))).select("manifest_id")
    deletes = gone(files).union(gone(dirs)).distinct().withColumn("_deletes", F.lit(True))
    kind = spec_version(F.col("spec_version"))["type"]
    problem = F.when((kind == "snapshot") & F.coalesce("_deletes", F.lit(False)), "SnapshotWithDeletions").when((kind == "diff") & F.col("parent_manifest_hash").isNull(), "DiffWithoutParent")
    return headers.join(deletes, "manifest_id", "left").select("manifest_id", problem.alias("problem"))


def content_type(version: Column, parent_manifest_hash: Column, names: tuple[str, str, str]) -> Column:
    """The media type under which a manifest is stored; names: those of the older form, of snapshots and of differences."""
    older, plain, diff = names
    return F.when(version == VERSIONS[0], older).when(parent_manifest_hash.isNull(), plain).otherwise(diff)


def _place(path: Column) -> Column:
    return F.when(path.rlike(REFERENCE), F.regexp_extract(path, REFERENCE, 1).cast("int"))


def _expanded(path: Column, directory: Column) -> Column:
    joined = F.concat(directory, F.lit("/"), F.regexp_extract(path, REFERENCE, 2))
    return F.when(~path.rlike(REFERENCE), path).when(directory.isNotNull(), joined).when(path.isNotNull(), F.raise_error(F.concat(F.lit("no such directory: "), path)))


def headers(manifests: DataFrame) -> DataFrame:
    """(manifest_id, spec_version, hash_alg, total_size, parent_manifest_hash); total_size is what the JSON says."""
    return _parsed(manifests).select("manifest_id", F.col("m.specificationVersion").alias("spec_version"), F.col("m.hashAlg").alias("hash_alg"), F.col("m.totalSize").alias("total_size"), F.col("m.parentManifestHash").alias("parent_manifest_hash"))


def older_files(manifests: DataFrame) -> DataFrame:
    """(manifest_id, place, path, hash, size, mtime) of the manifests in the older form."""
    rows = _parsed(manifests).where(F.col("m.specificationVersion").isNull() & (F.col("m.manifestVersion") == VERSIONS[0]))
    return rows.select("manifest_id", F.posexplode("m.paths").alias("place", "f")).select("manifest_id", "place", "f.*")


def _followed(lists: pd.Series) -> pd.Series:
    """Each list of paths with references to places before their own followed, in one pass."""

    def follow(names) -> list[str | None]:
        done: list[str | None] = []
        for path in names:
            found = re.match(REFERENCE, path) if path is not None else None
            if found:
                place = int(found[1])
                if place >= len(done) or done[place] is None:
                    raise ValueError(f"no such directory: {path}")
                path = f"{done[place]}/{found[2]}"
            done.append(path)
        return done

    return lists.map(follow)


def directories(manifests: DataFrame) -> DataFrame:
    """(manifest_id, place, path, deleted)."""

    dirs = F.coalesce("m.dirs", F.from_json(F.lit("[]"), "array<struct<path: string, deleted: boolean>>"))
    paths = F.pandas_udf(_followed, "array<string>")(F.transform(dirs, lambda x: x["path"]))
    rows = _parsed(manifests).select("manifest_id", F.posexplode(F.arrays_zip(paths.alias("path"), F.transform(dirs, lambda x: x["deleted"]).alias("deleted"))).alias("place", "d"))
    return rows.select("manifest_id", "place", F.col("d.path").alias("path"), F.coalesce("d.deleted", F.lit(False)).alias("deleted"))


def files(manifests: DataFrame) -> DataFrame:
    """(manifest_id, place, path, hash, size, mtime, runnable, chunkhashes, symlink_target, deleted)."""
    rows = _parsed(manifests).select("manifest_id", F.posexplode("m.files").alias("place", "f")).select("manifest_id", "place", "f.*")
    rows = rows.withColumns({"_own": _place(F.col("path")), "_link": _place(F.col("symlink.target"))})
    dirs = directories(manifests).select("manifest_id", "place", "path")
    of = lambda name: dirs.select("manifest_id", F.col("place").alias(name), F.col("path").alias(f"{name}_path"))
    rows = rows.join(of("_own"), ["manifest_id", "_own"], "left").join(of("_link"), ["manifest_id", "_link"], "left")
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return rows.select(
        "manifest_id", "place", _expanded(F.col("path"), F.col("_own_path")).alias("path"), "hash", "size", "mtime", flag("runnable"), "chunkhashes",
        _expanded(F.col("symlink.target"), F.col("_link_path")).alias("symlink_target"), flag("deleted"),
    )
