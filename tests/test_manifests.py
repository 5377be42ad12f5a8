"""Manifests read from JSON."""

from __future__ import annotations

import json

import pytest

from quillon.sources import manifests

ONE = {
    "specificationVersion": "relative-manifest-snapshot-beta-2025-12", "hashAlg": "xxh128", "totalSize": 3,
    "dirs": [{"path": "a"}, {"path": "$0/b", "deleted": True}, {"path": "$1/c"}],
    "files": [{"path": "$2/x.txt", "hash": "h", "size": 3, "mtime": 7, "runnable": True}, {"path": "top", "symlink": {"target": "$0/y"}}, {"path": "$1/big", "chunkhashes": ["p", "q"], "size": "wrong"}],
}


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "manifest_id int, json string")


def test_references(spark):
    found = table(spark, json.dumps(ONE), "{}")
    assert [tuple(r) for r in manifests.directories(found).orderBy("place").collect()] == [(0, 0, "a", False), (0, 1, "a/b", True), (0, 2, "a/b/c", False)]
    rows = [tuple(r)[1:] for r in manifests.files(found).orderBy("place").collect()]
    assert rows == [(0, "a/b/c/x.txt", "h", 3, 7, True, None, None, False), (1, "top", None, None, None, False, None, "a/y", False), (2, "a/b/big", None, None, None, False, ["p", "q"], None, False)]
    assert [tuple(r) for r in manifests.headers(found).orderBy("manifest_id").collect()] == [(0, ONE["specificationVersion"], "xxh128", 3, None), (1, None, None, None, None)]


@pytest.mark.parametrize("text", ['{"dirs": [], "files": [{"path": "$0/x"}]}', '{"dirs": [{"path": "$1/x"}, {"path": "y"}], "files": []}', "no json"])
def test_wrong_manifests_raise(spark, text):
    with pytest.raises(Exception, match="no such directory|no JSON"):
        manifests.directories(table(spark, text)).collect()
        manifests.files(table(spark, text)).collect()


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(ONE, indent=1))
    assert manifests.files(manifests.read_manifests(spark, str(tmp_path))).count() == 3


def test_canonical_order_and_round_trip(spark):
    """Files come by UTF-16 units: what is above the basic plane stands before private and presentation forms."""
    from quillon.sources import encode

    names = ["\r", "1", "another_test_file", "test_dir/test_file", "test_file", "\u0080", "\u00c3\u00b1", "\u00f6", "\u20ac", "\U0001f600", "\ue00a", "\ufb33"]
    rows = [(1, p, f"h{i}", 1, i) for i, p in enumerate(reversed(names))]
    text = encode.encode_2023(spark.createDataFrame(rows, "manifest_id int, path string, hash string, size long, mtime long")).first().json
    read = json.loads(text)
    assert [p["path"] for p in read["paths"]] == names and (read["totalSize"], read["manifestVersion"], read["hashAlg"]) == (12, "2023-03-03", "xxh128")
    assert text == json.dumps(read, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    found = table(spark, text)
    assert sorted(r.path for r in manifests.older_files(found).collect()) == sorted(names) and manifests.versions(found).first().version == "2023-03-03"


def test_encoding_of_every_kind(spark):
    from quillon.sources import encode

    headers = spark.createDataFrame([(0, manifests.SPEC_VERSIONS[1], "xxh128", "p\"q"), (1, manifests.SPEC_VERSIONS[2], "xxh128", "left out")], "manifest_id int, spec_version string, hash_alg string, parent_manifest_hash string")
    files = spark.createDataFrame(
        [(0, "/d/e/f\n\"é", "h", 5, 6, True, None, None, False), (0, "/d/l", None, None, None, False, None, "/d/e/x", False), (0, "/d/gone", None, None, None, False, None, None, True), (0, "top", None, 600, 7, False, ["p", "q"], None, False)],
        "manifest_id int, path string, hash string, size long, mtime long, runnable boolean, chunkhashes array<string>, symlink_target string, deleted boolean",
    )
    dirs = spark.createDataFrame([(0, "/d/e", False), (0, "/d", False), (0, "/d", False), (0, "/d/old", True)], "manifest_id int, path string, deleted boolean")
    got = {r.manifest_id: r.json for r in encode.encode(headers, files, dirs).collect()}
    assert json.loads(got[1]) == {"dirs": [], "files": [], "hashAlg": "xxh128", "specificationVersion": manifests.SPEC_VERSIONS[2], "totalSize": 0}
    one = json.loads(got[0])
    assert got[0] == json.dumps(one, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert one["dirs"] == [{"path": "/d"}, {"path": "$0/e"}, {"deleted": True, "path": "$0/old"}] and one["parentManifestHash"] == "p\"q" and one["totalSize"] == 605
    assert one["files"][0] == {"hash": "h", "mtime": 6, "path": "$1/f\n\"é", "runnable": True, "size": 5} and one["files"][2] == {"path": "$0/l", "symlink": {"target": "$1/x"}}
    found = table(spark, got[0])
    keep = lambda rows: sorted(map(str, (tuple(r[c] for c in ("path", "hash", "size", "mtime", "runnable", "chunkhashes", "symlink_target", "deleted")) for r in rows.collect())))
    assert keep(manifests.files(found)) == keep(files)


@pytest.mark.parametrize("text", ["{}", '{"manifestVersion": "1999"}', '{"specificationVersion": "other"}'])
def test_unknown_versions_raise(spark, text):
    with pytest.raises(Exception, match="unknown manifest version"):
        manifests.checked(table(spark, text)).collect()


def test_deep_directories(spark):
    dirs = [{"path": "d"}] + [{"path": f"${i}/d"} for i in range(300)]
    got = manifests.directories(table(spark, json.dumps({"dirs": dirs, "files": []})))
    assert [r.path for r in got.where("place = 300").collect()] == ["/".join(["d"] * 301)]


def test_written_manifests(spark, tmp_path):
    from quillon.sources import encode

    encode.write_manifests(spark.createDataFrame([(1, "{}"), (2, '{"a":1}')], "manifest_id int, json string"), str(tmp_path / "m"))
    assert sorted(r.json for r in manifests.read_manifests(spark, str(tmp_path / "m")).collect()) == ['{"a":1}\n', "{}\n"]
