"""Manifests written as canonical JSON: sorted keys, no white space, files by UTF-16 units, directories by code points as references.

Entries are made as rows, spread over tasks; `encode` then puts those of a manifest together, as a manifest is one JSON text: its row is as
large as the text. Rows hold manifest_id beside the columns of the model. Several rows of a directory count once; files stay as they are.

Cases: a manifest without files or directories has empty lists; nulls are left out; of hash, chunk hashes and link the first that is set is
written; deleted files and links have no size, time or flag; an empty header table gives no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import paths


def json_text(value: Column) -> Column:
    """A string as JSON, with only what must be escaped; null for null."""
    one = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substr(one, F.lit(2), F.length(one) - 2))


def _object(*members: tuple[str, Column]) -> Column:
    """A JSON object of (key, JSON text), in the given order, without those that are null."""
    pairs = F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in members])
    return F.concat(F.lit("{"), F.array_join(F.filter(pairs, lambda x: x.isNotNull()), ","), F.lit("}"))


def _true(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), F.lit("true"))


def places(dirs: DataFrame) -> DataFrame:
    """(manifest_id, path, deleted, place) of the distinct directories, in the order of code points; deleted if the first row of a path is."""
    flag = F.coalesce("deleted", F.lit(False)) if "deleted" in dirs.columns else F.lit(False)
    distinct = dirs.groupBy("manifest_id", "path").agg(F.max(flag).alias("deleted"))
    return distinct.withColumn("place", F.row_number().over(Window.partitionBy("manifest_id").orderBy("path")) - 1)


def _referred(rows: DataFrame, path: str, to: str, placed: DataFrame) -> DataFrame:
    """Adds `to`: the path as $place/name where its folder is a directory of the manifest."""
    folders = placed.select("manifest_id", F.col("path").alias("_folder"), F.col("place").alias("_place"))
    own = rows.withColumn("_folder", F.when(F.instr(path, "/") > 0, paths.parent(F.col(path))))
    coded = F.when(F.col("_place").isNotNull(), F.concat(F.lit("$"), F.col("_place").cast("string"), F.lit("/"), paths.name(F.col(path)))).otherwise(F.col(path))
    return own.join(folders, ["manifest_id", "_folder"], "left").withColumn(to, coded).drop("_folder", "_place")


def directory_entries(dirs: DataFrame) -> DataFrame:
    """(manifest_id, place, json)."""
    placed = places(dirs)
    return _referred(placed, "path", "_coded", placed).select("manifest_id", "place", _object(("deleted", _true(F.col("deleted"))), ("path", json_text(F.col("_coded")))).alias("json"))


def file_entries(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(manifest_id, path, json)."""
    placed = places(dirs)
    rows = _referred(_referred(files, "path", "_coded", placed), "symlink_target", "_target", placed)
    deleted = F.coalesce("deleted", F.lit(False))
    plain = ~deleted & F.col("symlink_target").isNull()
    number = lambda c: F.when(plain, F.col(c).cast("string"))
    json = _object(
        ("chunkhashes", F.when(F.col("hash").isNull(), F.to_json("chunkhashes"))), ("deleted", _true(deleted)), ("hash", json_text(F.col("hash"))), ("mtime", number("mtime")),
        ("path", json_text(F.col("_coded"))), ("runnable", _true(plain & F.coalesce("runnable", F.lit(False)))), ("size", number("size")),
        ("symlink", F.when(F.col("hash").isNull() & F.col("chunkhashes").isNull() & F.col("_target").isNotNull(), _object(("target", json_text(F.col("_target")))))),
    )
    return rows.select("manifest_id", "path", json.alias("json"))


def _gathered(entries: DataFrame, order: Column, name: str) -> DataFrame:
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("json").alias("j")))), lambda e: e["j"])
    return entries.groupBy("manifest_id").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias(name))


def total_sizes(files: DataFrame) -> DataFrame:
    """(manifest_id, total_size): bytes of files that are neither deleted nor links."""
    counted = F.when(~F.coalesce("deleted", F.lit(False)) & F.col("symlink_target").isNull(), F.col("size"))
    return files.groupBy("manifest_id").agg(F.coalesce(F.sum(counted), F.lit(0)).cast("long").alias("total_size"))


def encode(headers: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(manifest_id, json) of headers (manifest_id, spec_version, hash_alg, parent_manifest_hash), one text a manifest; total sizes are summed."""
    f = _gathered(file_entries(files, dirs), paths.utf16_order(F.col("path")), "_files")
    d = _gathered(directory_entries(dirs), F.col("place"), "_dirs")
    rows = headers.join(d, "manifest_id", "left").join(f, "manifest_id", "left").join(total_sizes(files), "manifest_id", "left")
    parent = F.when(F.col("spec_version").contains("-diff-"), json_text(F.col("parent_manifest_hash")))
    json = _object(
        ("dirs", F.coalesce("_dirs", F.lit("[]"))), ("files", F.coalesce("_files", F.lit("[]"))), ("hashAlg", json_text(F.col("hash_alg"))), ("parentManifestHash", parent),
        ("specificationVersion", json_text(F.col("spec_version"))), ("totalSize", F.coalesce("total_size", F.lit(0).cast("long")).cast("string")),
    )
    return rows.select("manifest_id", json.alias("json"))


def encode_2023(files: DataFrame, hash_alg: str = "xxh128") -> DataFrame:
    """(manifest_id, json) in the older form: hash, mtime, path and size of each file (manifest_id, path, hash, size, mtime)."""
    number = lambda c: F.col(c).cast("string")
    json = _object(("hash", json_text(F.col("hash"))), ("mtime", number("mtime")), ("path", json_text(F.col("path"))), ("size", number("size")))
    entries = _gathered(files.select("manifest_id", "path", json.alias("json")), paths.utf16_order(F.col("path")), "_paths")
    sizes = files.groupBy("manifest_id").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))
    whole = _object(("hashAlg", json_text(F.lit(hash_alg))), ("manifestVersion", F.lit('"2023-03-03"')), ("paths", F.col("_paths")), ("totalSize", number("total_size")))
    return entries.join(sizes, "manifest_id").select("manifest_id", whole.alias("json"))


def write_manifests(encoded: DataFrame, folder: str) -> None:
    """Write (manifest_id, json) as text files below the folder, one a manifest, in a folder of its id; an earlier version is replaced."""
    encoded.select("manifest_id", F.col("json").alias("value")).write.partitionBy("manifest_id").mode("overwrite").text(folder)
