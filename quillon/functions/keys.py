"""Keys, prefixes and metadata of stored manifests and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_key(*parts: Column | str) -> Column:
    """Parts with '/' between; empty and null ones are left out."""
    return F.concat_ws("/", *[F.nullif(F.lit(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def content_key(root: Column | str, prefix: Column | str, digest: Column, algorithm: str = "xxh128") -> Column:
    return join_key(root, prefix, F.concat(digest, F.lit(f".{algorithm}")))


def output_prefix(root, farm, queue, job, step=None, task=None) -> Column:
    """Prefix of a job's, a step's or a task's outputs, by what is given."""
    return F.concat(join_key(root, "Manifests", farm, queue, job, *([step] if step is not None else []), *([task] if task is not None else [])), F.lit("/"))


def iso_timestamp(seconds: Column) -> Column:
    """Seconds as a double to a time with six decimals, cut off."""
    micros = F.floor(seconds).cast("long") * 1_000_000 + F.floor((seconds - F.floor(seconds)) * 1_000_000).cast("long")
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def to_metadata(root: Column, location: Column) -> Column:
    """User metadata: a plain entry for an ASCII root, else a JSON one; the location if there is one."""
    plain = ~root.rlike("[^\\x00-\\x7F]")
    entries = F.array(
        F.struct(F.when(plain, F.lit("asset-root")).otherwise(F.lit("asset-root-json")).alias("k"), F.when(plain, root).otherwise(F.to_json(F.array(root))).alias("v")),
        F.struct(F.lit("file-system-location-name").alias("k"), location.alias("v")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def from_metadata(metadata: Column) -> Column:
    """Struct of root and location; the JSON entry comes first."""
    coded = F.element_at(F.from_json(F.try_element_at(metadata, F.lit("asset-root-json")), "array<string>"), 1)
    return F.struct(F.coalesce(coded, F.try_element_at(metadata, F.lit("asset-root"))).alias("root"), F.try_element_at(metadata, F.lit("file-system-location-name")).alias("location"))


def manifest_key(root: Column | str, prefix: Column | str, path: Column) -> Column:
    return join_key(root, prefix, path)


def input_manifest_key(prefix, farm, queue, guid, name) -> Column:
    return join_key(prefix, farm, queue, "Inputs", guid, name)


def output_manifest_key(prefix: str, farm, queue, job, step, time, session_action, name, task=None) -> Column:
    """Key of a task's output manifest, or without a task a step's: its folder is named by time and session action."""
    folder = F.concat_ws("_", time, session_action)
    parts = [prefix, farm, queue, job, step, *([task] if task is not None else [])]
    return join_key(*parts, folder, name)


def partial_key(key: Column, prefix: str) -> Column:
    """A key without a prefix and the slashes after it; other keys as they are."""
    return F.when(key.startswith(prefix), F.regexp_replace(F.substr(key, F.lit(len(prefix) + 1)), "^/+", "")).otherwise(key)


def root_name(location: Column, root: Column) -> Column:
    """What a root's manifest is named by: the hash of the location's name, if there is one, and the root."""
    from quillon.functions.hashing import xxh128

    return xxh128(F.encode(F.concat(F.coalesce(location, F.lit("")), root), "UTF-8"))


def manifest_properties(root: Column, outputs: Column, key: Column, digest: Column, location: Column, path_format: str = "posix") -> Column:
    """Struct by which a job names a root's manifest. Outputs below the root stand relative to it, others are left out; no outputs at all: null."""
    below = F.transform(F.filter(outputs, lambda p: (p == root) | F.startswith(p, F.concat(root, F.lit("/")))), lambda p: F.replace(F.substr(p, F.length(root) + 2), F.lit("\\"), F.lit("/")))
    return F.struct(
        root.alias("rootPath"), F.lit(path_format).alias("rootPathFormat"), key.alias("inputManifestPath"), digest.alias("inputManifestHash"),
        F.when(F.size(outputs) > 0, below).alias("outputRelativeDirectories"), location.alias("fileSystemLocationName"),
    )


def job_payload(properties: Column, file_system: str = "COPIED") -> Column:
    """The JSON by which a job names its manifests; nulls are left out."""
    return F.to_json(F.struct(properties.alias("manifests"), F.lit(file_system).alias("fileSystem")))
