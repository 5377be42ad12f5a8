"""Every operator as a named query on the test tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import chunks, hashing, keys, paths
from quillon.operators import changes, diff, discovery, locations, merge, scan, select, transfer, tree, validate
from quillon.plans import tables as t
from quillon.sources import directory, encode, manifests, store
from quillon.sources.shared import new_folder
from quillon.streaming import access, incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Differences ---------------------------------------------------------------------------------------------------------


def _joined(differ: str) -> str:
    return f"""SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN {differ} THEN 'modified' ELSE 'unchanged' END AS status
    FROM {t.PARENT} p FULL OUTER JOIN {t.CURRENT} c ON p.path = c.path"""


_DIFFER = "p.size <> c.size OR abs(p.mtime - c.mtime) > 1 OR p.hash <> c.hash OR p.runnable <> c.runnable"


@query(_joined(_DIFFER))
def diff_status(spark, d):
    return diff.classify(t.parent(spark, d), t.current(spark, d)).select("path", "status")


@query(f"""SELECT coalesce(c.path, p.path) AS path, c.hash, c.size, c.mtime, c.runnable, c.path IS NULL AS deleted FROM {t.PARENT} p FULL OUTER JOIN {t.CURRENT} c ON p.path = c.path
    WHERE p.path IS NULL OR c.path IS NULL OR {_DIFFER}""")
def diff_manifest(spark, d):
    return diff.diff_files(t.parent(spark, d), t.current(spark, d)).select("path", "hash", "size", "mtime", "runnable", "deleted")


@query(_joined("p.size <> c.size OR abs(p.mtime - c.mtime) > 1 OR p.runnable <> c.runnable"))
def diff_ignore_hash(spark, d):
    return diff.classify(t.parent(spark, d), t.current(spark, d), ignore_hashes=True).select("path", "status")


@query(_joined("p.size <> c.size OR abs(p.mtime - c.mtime) > 1 OR p.hash <> c.hash"))
def diff_preserve_runnable(spark, d):
    return diff.classify(t.parent(spark, d), t.current(spark, d), preserve_runnable=True).select("path", "status")


@query(f"SELECT status, count(*) AS n FROM ({_joined(_DIFFER)}) GROUP BY status")
def diff_summary(spark, d):
    return diff.rollup(diff_status(spark, d))


@query(_joined("p.size <> c.size OR abs(p.mtime - c.mtime) > 1"))
def diff_fast_mode(spark, d):
    return diff.fast_status(t.parent(spark, d), t.current(spark, d))


@query(_joined("p.size <> c.size OR p.hash <> c.hash"))
def diff_hash_mode(spark, d):
    return diff.hash_status(t.parent(spark, d), t.current(spark, d))


def _dirs(spark, d, keep):
    rows = t.read(spark, d, "part").where(keep)
    return rows.select(F.concat_ws("/", "p_type", "p_brand", F.col("p_size").cast("string")).alias("path")).distinct()


_PART_DIRS = "SELECT DISTINCT p_type || '/' || p_brand || '/' || p_size AS path FROM part WHERE p_partkey % "
_PART_FILES = "(SELECT p_type || '/' || p_brand || '/' || p_size || '/' || p_name AS path FROM part WHERE p_partkey % 5 <> 1 AND p_partkey % 3 <> 0)"


_SAME = " AND ".join(f"p.{c} IS NOT DISTINCT FROM c.{c}" for c in ("symlink_target", "size", "hash", "chunkhashes"))
_MIXED_STATUS = """SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN {differ} THEN 'modified' ELSE 'unchanged' END AS status
    FROM (SELECT * FROM {parent} WHERE NOT deleted) p FULL OUTER JOIN (SELECT * FROM {current} WHERE NOT deleted) c ON p.path = c.path"""
_MIXED_SQL = {"parent": t.MIXED_PARENT, "current": t.MIXED_CURRENT}


@query(_MIXED_STATUS.format(differ=f"NOT ({_SAME}) OR abs(p.mtime - c.mtime) > 1 OR p.runnable <> c.runnable", **_MIXED_SQL))
def diff_kinds(spark, d):
    """Of manifests with links, chunked files, deleted rows and rows without a time."""
    return diff.classify(t.mixed_parent(spark, d), t.mixed_current(spark, d)).select("path", "status")


@query(_MIXED_STATUS.format(differ=f"NOT ({_SAME})", **_MIXED_SQL))
def diff_content(spark, d):
    return diff.content_status(t.mixed_parent(spark, d), t.mixed_current(spark, d))


@query(_MIXED_STATUS.format(differ="NOT coalesce(p.size = c.size AND abs(p.mtime - c.mtime) <= 1, false)", **_MIXED_SQL).replace("(SELECT * FROM " + t.MIXED_CURRENT + " WHERE NOT deleted) c", t.MIXED_CURRENT + " c"))
def diff_fast_kinds(spark, d):
    return diff.fast_status(t.mixed_parent(spark, d), t.mixed_current(spark, d))


@query(f"SELECT path, symlink_target IS NULL AS is_file, chunkhashes IS NOT NULL AS is_chunked, runnable AS is_runnable, coalesce(hash, chunkhashes[1], '') AS primary_hash FROM {t.MIXED_PARENT} WHERE NOT deleted")
def file_kinds(spark, d):
    rows = select.additions(t.mixed_parent(spark, d))
    return rows.select("path", *[select.of_kind(k).alias(f"is_{k}") for k in ("file", "chunked", "runnable")], chunks.primary_hash(F.col("hash"), F.col("chunkhashes")).alias("primary_hash"))


@query(f"SELECT path, hash, size FROM {t.MIXED_CURRENT} WHERE NOT deleted UNION ALL SELECT path, hash, size FROM {t.MIXED_PARENT} p WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM {t.MIXED_CURRENT} c WHERE c.path = p.path)")
def apply_plainly(spark, d):
    return merge.apply_plainly(t.mixed_parent(spark, d), t.mixed_current(spark, d)).select("path", "hash", "size")


@query(f"""WITH p AS ({_PART_DIRS}7 <> 0), c AS ({_PART_DIRS}5 <> 1), gone AS (SELECT path FROM p EXCEPT SELECT path FROM c)
    SELECT path, false AS deleted FROM (SELECT path FROM c EXCEPT SELECT path FROM p) UNION ALL
    SELECT path, true FROM gone WHERE NOT EXISTS (SELECT 1 FROM {_PART_FILES} f WHERE starts_with(f.path, gone.path) AND f.path <> gone.path)""")
def diff_dirs(spark, d):
    below = t.read(spark, d, "part").where("p_partkey % 5 <> 1 AND p_partkey % 3 <> 0").select(F.concat_ws("/", "p_type", "p_brand", F.col("p_size").cast("string"), "p_name").alias("path"))
    return diff.diff_directories(_dirs(spark, d, "p_partkey % 7 <> 0"), _dirs(spark, d, "p_partkey % 5 <> 1"), below)


# Sequences -----------------------------------------------------------------------------------------------------------


@query(f"SELECT path, idx, ts, seq, size, deleted FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx DESC, seq DESC, size DESC, deleted DESC) AS n FROM {t.VERSIONS}) WHERE n = 1")
def merge_last_wins(spark, d):
    return merge.merge(t.versions(spark, d), ["idx", "seq", "size", "deleted"])


@query(f"SELECT path, size, deleted FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, idx DESC, seq DESC, size DESC, deleted DESC) AS n FROM {t.VERSIONS}) WHERE n = 1")
def merge_chronological(spark, d):
    return merge.merge(t.versions(spark, d), ["ts", "idx", "seq", "size", "deleted"]).select("path", "size", "deleted")


@query(f"SELECT idx, path, max(size) AS size FROM (SELECT *, row_number() OVER (PARTITION BY idx, path ORDER BY ts DESC, seq DESC, size DESC, deleted DESC) AS n FROM {t.VERSIONS}) WHERE n = 1 GROUP BY ALL")
def merge_by_root(spark, d):
    return merge.merge(t.versions(spark, d), ["ts", "seq", "size", "deleted"], by=["idx", "path"]).select("idx", "path", "size")


_FOLD = f"""WITH f AS (SELECT path, idx, 1 AS phase, seq, deleted, size FROM {t.VERSIONS}), g AS (SELECT path, idx, 0 AS phase, seq, deleted FROM {t.VERSION_DIRS}),
    gone AS (SELECT path, idx, phase, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx DESC, seq DESC) AS n FROM g WHERE deleted) WHERE n = 1)"""


@query(f"""{_FOLD}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx DESC, seq DESC, size DESC, deleted DESC) AS n FROM f) WHERE n = 1 AND NOT deleted)
    SELECT path, size FROM last WHERE NOT EXISTS (SELECT 1 FROM gone WHERE (gone.path = last.path OR starts_with(last.path, gone.path || '/')) AND (gone.idx, gone.phase, gone.seq) > (last.idx, last.phase, last.seq))""")
def apply_diffs_files(spark, d):
    rows = t.versions(spark, d).withColumn("seq", F.struct("seq", "size", "deleted")).drop("ts")
    dirs = t.version_dirs(spark, d).withColumn("seq", F.struct("seq", F.lit(0).cast("long").alias("size"), "deleted"))
    return merge.apply_diffs(rows, dirs)[0].select("path", "size")


@query(f"""{_FOLD}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx DESC, seq DESC) AS n FROM g) WHERE n = 1 AND NOT deleted)
    SELECT path FROM last WHERE NOT EXISTS (SELECT 1 FROM gone WHERE (gone.path = last.path OR starts_with(last.path, gone.path || '/')) AND (gone.idx, gone.phase, gone.seq) > (last.idx, last.phase, last.seq))""")
def apply_diffs_dirs(spark, d):
    return merge.apply_diffs(t.versions(spark, d).drop("ts"), t.version_dirs(spark, d))[1].select("path")


@query(f"SELECT idx, count(*) AS n_files, sum(size)::BIGINT AS total_size, min(path) AS first_path, max(path) AS last_path FROM {t.VERSIONS} GROUP BY idx")
def path_groups(spark, d):
    return merge.path_groups(t.versions(spark, d), "idx")


@query(f"SELECT idx, coalesce(sum(size) FILTER (NOT deleted), 0)::BIGINT AS total_size, count(*) AS file_count, count(*) FILTER (deleted) AS n_deleted FROM {t.VERSIONS} GROUP BY idx")
def manifest_header(spark, d):
    live = F.when(~F.col("deleted"), F.col("size"))
    return t.versions(spark, d).groupBy("idx").agg(F.coalesce(F.sum(live), F.lit(0)).alias("total_size"), F.count("*").alias("file_count"), F.count_if("deleted").alias("n_deleted"))


@query("""SELECT path, md5(text) AS hash, n_chars AS size, doc_id AS mtime, false AS runnable, false AS deleted FROM (SELECT *, 'v1/' || doc_id AS path FROM documents)""")
def lift_v2023(spark, d):
    """The older manifest form, without flags, as file rows."""
    return t.read(spark, d, "documents").select(F.concat(F.lit("v1/"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("hash"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"), F.lit(False).alias("runnable"), F.lit(False).alias("deleted"))


# Selection -----------------------------------------------------------------------------------------------------------


@query(f"SELECT path, size FROM {t.FILES} WHERE size > 2000")
def filter_files(spark, d):
    return select.filter_manifest(t.files(spark, d), t.files(spark, d).limit(0), F.col("size") > 2000)[0].select("path", "size")


@query(f"SELECT DISTINCT source || '/' || lang AS path FROM {t.FILES} WHERE size > 9000")
def filter_dirs(spark, d):
    f = t.files(spark, d)
    dirs = f.select(paths.parent(F.col("path")).alias("path")).distinct()
    return select.filter_manifest(f, dirs, F.col("size") > 9000, strict=True)[1]


@query(f"""SELECT path FROM (SELECT DISTINCT source || '/' || left(lang, 1) AS path FROM {t.FILES}) x WHERE EXISTS (SELECT 1 FROM {t.FILES} f WHERE starts_with(f.path, x.path) AND f.size > 12000)""")
def filter_dirs_raw_prefix(spark, d):
    f = t.files(spark, d)
    dirs = f.select(F.regexp_replace("path", "^([^/]*/.).*$", "$1").alias("path")).distinct()
    return select.filter_manifest(f, dirs, F.col("size") > 12000)[1]


@query(f"SELECT path FROM {t.FILES} WHERE regexp_matches(path, '^src1.*/e./.*\\.txt$') AND NOT regexp_matches(path, '^.*/[0-9]*7\\.txt$') AND NOT path LIKE 'src1/%'")
def include_exclude(spark, d):
    return t.files(spark, d).where(paths.matches_globs(F.col("path"), ["src1*/e?/*.txt"], ["*/*7.txt", "src1/*"])).select("path")


@query(f"SELECT path FROM {t.FILES} WHERE regexp_matches(path, '^(.*/)?(de|fr)/.*[02468]\\.(txt|md)$')")
def glob_set(spark, d):
    return t.files(spark, d).where(paths.matches_globs(F.col("path"), ["**/{de,fr}/*[02468].{txt,md}"], braces=True)).select("path")


@query(f"SELECT substr(path, length('src2/en/') + 1) AS path, size FROM {t.FILES} WHERE starts_with(path, 'src2/en/')")
def subtree(spark, d):
    return select.subtree(t.files(spark, d), "src2\\en/").select("path", "size")


@query(f"SELECT '/mnt/data/' || path AS path, size FROM {t.FILES}")
def join_prefix(spark, d):
    return select.join_prefix(t.files(spark, d), "/mnt/data/").select("path", "size")


@query(f"SELECT path, size FROM {t.FILES}")
def subtree_of_join(spark, d):
    return select.subtree(select.join_prefix(t.files(spark, d), "/mnt/data"), "/mnt/data").select("path", "size")


@query(f"""SELECT r.root, substr(path, length(r.root) + 2) AS path, size FROM {t.FILES} f JOIN (VALUES ('src1'), ('src2'), ('src2/en')) r(root) ON starts_with(f.path, r.root || '/')""")
def partition_explicit(spark, d):
    return select.partition(t.files(spark, d), ["src1", "src2", "src2/en"]).select("root", "path", "size")


def _common(paths_sql: str) -> str:
    """SQL of the longest common run of names of each group's parents (g, path): names that are alike in all of a group, from the front."""
    return f"""(WITH p AS (SELECT g, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS c FROM {paths_sql}),
    u AS (SELECT g, i, array_to_string(c[1:i], '/') AS head FROM (SELECT g, c, unnest(range(1, len(c) + 1)) AS i FROM p)),
    s AS (SELECT g, i, min(head) AS head FROM u GROUP BY g, i HAVING count(DISTINCT head) = 1 AND count(*) = (SELECT count(*) FROM p WHERE p.g = u.g))
    SELECT g, CASE WHEN arg_max(head, i) = '' THEN '/' ELSE arg_max(head, i) END AS root FROM s GROUP BY g)"""


_SIBLINGS = f"(SELECT location AS g, CASE WHEN k % 3 = 0 THEN regexp_replace(path, '^(/[^/]*/[^/]*)/', '\\1-x/') WHEN k % 3 = 1 AND location < 'M' THEN regexp_replace(path, '^(/[^/]*/[^/]*)/', '\\1/é/') ELSE path END AS path FROM (SELECT path, split_part(path, '/', 3) AS location, length(path) AS k FROM {t.ASSETS}))"


@query(f"SELECT * FROM {_common(_SIBLINGS)}")
def partition_detect(spark, d):
    """Roots of each nation's assets, some of which lie in siblings whose names go on with '-' or hold other letters."""
    k, g = F.length("path") % 3, F.split("path", "/")[2]
    moved = lambda to: F.regexp_replace("path", "^(/[^/]*/[^/]*)/", to)
    rows = t.assets(spark, d).select(g.alias("g"), F.when(k == 0, moved("$1-x/")).when((k == 1) & (g < "M"), moved("$1/é/")).otherwise(F.col("path")).alias("path"))
    return select.detect_root(rows, ("g",))


@query(f"SELECT root FROM {_common(f'(SELECT 1 AS g, path FROM {t.ASSETS})')}")
def partition_roots(spark, d):
    return select.detect_roots(t.assets(spark, d))


@query("SELECT DISTINCT upper(substr('cdEF', (c_custkey % 4 + 1)::INT, 1)) || ':' AS root FROM customer")
def partition_roots_windows(spark, d):
    drive = F.substr(F.lit("cdEF"), (F.col("c_custkey") % 4 + 1).cast("int"), F.lit(1))
    return select.detect_roots(t.read(spark, d, "customer").select(F.concat(drive, F.lit(":/"), F.col("c_name")).alias("path")))


@query(f"SELECT r.root, CASE WHEN r.root = '/' THEN substr(path, 2) ELSE substr(path, length(r.root) + 2) END AS path FROM {t.ASSETS} a JOIN (VALUES ('/'), ('/ASIA'), ('/ASIA/CHINA')) r(root) ON r.root = '/' OR starts_with(a.path, r.root || '/')")
def partition_by_slash(spark, d):
    return select.partition(t.assets(spark, d), ["/", "/ASIA", "/ASIA/CHINA"]).select("root", "path")


@query("""SELECT upper(substr('cdEF', (c_custkey % 4 + 1)::INT, 1)) || ':' AS root, c_mktsegment || '/' || c_name AS path FROM customer""")
def partition_drives(spark, d):
    drive = F.substr(F.lit("cdEF"), (F.col("c_custkey") % 4 + 1).cast("int"), F.lit(1))
    rows = t.read(spark, d, "customer").select(F.concat(drive, F.lit(":\\"), F.col("c_mktsegment"), F.lit("\\"), F.col("c_name")).alias("path"))
    return select.partition_drives(rows).select("root", "path")


# Rules ---------------------------------------------------------------------------------------------------------------


@query(f"""SELECT path, CASE WHEN deleted AND (o_orderkey % 2 = 0) THEN 'DeletedWithFields' WHEN deleted THEN NULL WHEN o_orderkey % 17 = 0 THEN 'NoContent'
    WHEN o_orderkey % 19 = 0 THEN 'NoSizeOrTime' WHEN size > 268435456 AND o_orderkey % 23 = 0 THEN 'WrongChunkCount' END AS problem FROM {t.LARGE}""")
def validate_files(spark, d):
    k = F.col("o_orderkey")
    bare = F.col("deleted") & (k % 2 != 0)
    none = lambda n: F.when(bare | (~F.col("deleted") & (k % 17 == 0)), None).otherwise(F.col(n))
    rows = t.large_files(spark, d).withColumns({"hash": none("hash"), "chunkhashes": none("chunkhashes"), "size": F.when(~bare, F.col("size")), "mtime": F.when(~bare & ((k % 19 != 0) | F.col("deleted")), F.col("mtime"))})
    rows = rows.withColumn("chunkhashes", F.when((k % 23 == 0) & ~F.col("deleted"), F.concat("chunkhashes", F.array(F.lit("x")))).otherwise(F.col("chunkhashes")))
    return rows.select("path", validate.file_problem().alias("problem"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'AbsoluteTarget' WHEN 1 THEN 'EscapesRoot' WHEN 3 THEN 'AbsoluteTarget' WHEN 5 THEN 'EscapesRoot' END AS problem FROM part""")
def validate_links(spark, d):
    target = F.element_at(F.array(*[F.lit(x) for x in ("/etc/x", "../../../up", "../b/./c", "C:\\x", "x/../y", "a/../../../../z")]), (F.col("p_size") % 6 + 1).cast("int"))
    return t.read(spark, d, "part").select("p_partkey", validate.link_problem(F.concat_ws("/", "p_type", "p_brand", F.lit("link")), target).alias("problem"))


@query("""SELECT policy, escaping, CASE WHEN policy IN ('preserve', 'transitive_include_targets') THEN 'preserve' WHEN policy = 'collapse_all' THEN 'follow' WHEN policy = 'exclude_all' THEN 'exclude'
    WHEN NOT escaping THEN 'preserve' WHEN policy = 'collapse_escaping' THEN 'follow' ELSE 'exclude' END AS action
    FROM (SELECT ['collapse_escaping', 'collapse_all', 'exclude_escaping', 'exclude_all', 'preserve', 'transitive_include_targets'][(p_partkey % 6 + 1)::INT] AS policy, p_size % 2 = 0 AS escaping FROM part)""")
def link_policy(spark, d):
    policy = F.element_at(F.array(*[F.lit(x) for x in ("collapse_escaping", "collapse_all", "exclude_escaping", "exclude_all", "preserve", "transitive_include_targets")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = t.read(spark, d, "part").select(policy.alias("policy"), (F.col("p_size") % 2 == 0).alias("escaping"))
    return rows.withColumn("action", validate.link_action(F.col("policy"), F.col("escaping")))


# Functions -----------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_type || '/' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'x' END AS path FROM part""")
def lexical_normalize(spark, d):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat_ws("/", F.lit("."), "p_type", F.lit("a"), F.lit(".."), "p_brand", F.lit("."))).otherwise(F.concat_ws("/", "p_type", F.lit(""), "p_brand", F.lit(".."), F.lit("x")))
    return t.read(spark, d, "part").select("p_partkey", paths.normalize(raw).alias("path"))


@query(f"""SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name, len(string_split(path, '/')) - 1 AS depth FROM {t.FILES}""")
def split_paths(spark, d):
    p = F.col("path")
    return t.files(spark, d).select("path", paths.parent(p).alias("parent"), paths.name(p).alias("name"), F.size(paths.ancestors(p)).cast("long").alias("depth"))


@query("""SELECT p_partkey, replace(p_name, ' ', '\\[') || '\\*' AS pattern FROM part""")
def escape_glob(spark, d):
    return t.read(spark, d, "part").select("p_partkey", paths.escape_glob(F.concat(F.replace("p_name", F.lit(" "), F.lit("[")), F.lit("*"))).alias("pattern"))


@query(f'SELECT path, index, "offset", length FROM {t.PARTS}')
def chunk_table(spark, d):
    e = t.large_files(spark, d).where("NOT deleted").select("path", F.explode(chunks.chunk_list(F.col("size"))).alias("c"))
    return e.select("path", "c.index", "c.offset", "c.length")


@query(f"SELECT size > 268435456 AS chunked, greatest(1, (size + 268435455) // 268435456) AS chunks, count(*) AS n FROM {t.LARGE} GROUP BY ALL")
def chunk_counts(spark, d):
    size = F.col("size")
    return t.large_files(spark, d).groupBy(chunks.needs_chunks(size).alias("chunked"), chunks.chunk_count(size).alias("chunks")).agg(F.count("*").alias("n"))


@query(f"SELECT path, 'root/Data/' || hash || '.xxh128' AS key, 'Data/' || hash || '.xxh128' AS key_without_root FROM {t.FILES}")
def content_keys(spark, d):
    return t.files(spark, d).select("path", keys.content_key("root", "Data", F.col("hash")).alias("key"), keys.content_key("", "Data", F.col("hash")).alias("key_without_root"))


@query("""SELECT event_id, 'Manifests/f/q/j/' AS job, 'Manifests/f/q/j/s' || user_id || '/' AS step, 'r/Manifests/f/q/j/s' || user_id || '/t/' AS task FROM events""")
def output_prefixes(spark, d):
    step = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    return t.read(spark, d, "events").select("event_id", keys.output_prefix("", "f", "q", "j").alias("job"), keys.output_prefix("", "f", "q", "j", step).alias("step"), keys.output_prefix("r", "f", "q", "j", step, "t").alias("task"))


@query("""SELECT event_id, strftime(make_timestamp((1700000000 + event_id) * 1000000 + (event_id % 8) * 125000), '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM events""")
def iso_timestamps(spark, d):
    return t.read(spark, d, "events").select("event_id", keys.iso_timestamp(F.lit(1_700_000_000.0) + F.col("event_id") + (F.col("event_id") % 8) / 8).alias("iso"))


@query(f"SELECT path, path || CASE WHEN doc_id % 2 = 0 THEN '/é' ELSE '' END AS root, CASE WHEN doc_id % 3 = 0 THEN source END AS location, CASE WHEN doc_id % 2 = 0 THEN 'asset-root-json' ELSE 'asset-root' END AS entry FROM {t.FILES}")
def metadata_round_trip(spark, d):
    root = F.concat("path", F.when(F.col("doc_id") % 2 == 0, "/é").otherwise(""))
    rows = t.files(spark, d).select("path", keys.to_metadata(root, F.when(F.col("doc_id") % 3 == 0, F.substring_index("path", "/", 1))).alias("m"))
    entry = F.when(F.map_contains_key("m", "asset-root-json"), "asset-root-json").otherwise("asset-root")
    return rows.select("path", keys.from_metadata(F.col("m")).alias("x"), entry.alias("entry")).select("path", "x.root", "x.location", "entry")


@query("SELECT p_partkey, (p_size & 73) <> 0 AS runnable, p_size | ((p_size & 292) >> 2) AS executable_mode FROM part")
def mode_bits(spark, d):
    mode = F.col("p_size")
    return t.read(spark, d, "part").select("p_partkey", (mode.bitwiseAND(73) != 0).alias("runnable"), mode.bitwiseOR(F.shiftright(mode.bitwiseAND(292), 2)).alias("executable_mode"))


#: Letters in the order of UTF-16 units, which differs from that of code points for the last two.
_LETTERS = ("z", "é", "Ω", "😀", "ﬁ")


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id % 5, doc_id // 5 + 100000)::INT AS place FROM {t.FILES}")
def canonical_order_unicode(spark, d):
    k = F.col("doc_id")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in _LETTERS]), (k % 5 + 1).cast("int")), (F.floor(k / 5) + 100_000).cast("string"))
    rows = t.read(spark, d, "documents").select("doc_id", "source", name.alias("path"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(paths.utf16_order(F.col("path")))).alias("place"))


@query("SELECT doc_id, lower(lpad(to_hex(xor(('0x' || substr(h, 1, 16))::UBIGINT, ('0x' || substr(h, 17, 16))::UBIGINT)), 16, '0')) AS folded FROM (SELECT doc_id, md5(text) AS h FROM documents)")
def folded_hashes(spark, d):
    return t.read(spark, d, "documents").select("doc_id", hashing.fold(F.md5("text")).alias("folded"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 493 WHEN 1 THEN 511 WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 493 ELSE 420 END END::INT AS mode, p_name ILIKE 'b%' AS named FROM part")
def tree_permissions(spark, d):
    kind = F.element_at(F.array(F.lit("directory"), F.lit("symlink"), F.lit("file")), (F.col("p_size") % 3 + 1).cast("int"))
    return t.read(spark, d, "part").select("p_partkey", paths.permissions(kind, F.col("p_partkey") % 2 == 0).alias("mode"), paths.name_matches(F.col("p_name"), "B*").alias("named"))


@query("""SELECT p_partkey, p_type || '/x/' || p_brand AS path, p_partkey % 2 = 0 AS inside FROM part""")
def manifest_paths(spark, d):
    root = F.concat(F.lit("/r/"), F.lit("./s"))
    raw = F.concat_ws("/", F.lit("/r/s"), "p_type", F.lit("y/../x"), "p_brand")
    inside = paths.within_root(F.when(F.col("p_partkey") % 2 == 0, raw).otherwise(F.concat(F.lit("/r/s/../st/"), F.col("p_brand"))), "/r/s")
    return t.read(spark, d, "part").select("p_partkey", paths.for_manifest(raw, root).alias("path"), inside.alias("inside"))


@query("""SELECT event_id, 'root/M/f/q/Inputs/g' || user_id || '/n_input' AS input_key, 'M/f/q/j/s/' || CASE WHEN event_id % 2 = 0 THEN 't' || user_id || '/' ELSE '' END || '2024_sa-' || user_id || '/n_output' AS output_key,
    'f/q/Inputs/g' || user_id || '/n_input' AS partial_key FROM events""")
def manifest_keys(spark, d):
    user = lambda x: F.concat(F.lit(x), F.col("user_id").cast("string"))
    output = lambda task: keys.output_manifest_key("M", F.lit("f"), F.lit("q"), F.lit("j"), F.lit("s"), F.lit("2024"), user("sa-"), F.lit("n_output"), task)
    whole = keys.manifest_key("root", "M", keys.join_key(F.lit("f"), F.lit("q"), F.lit("Inputs"), user("g"), F.lit("n_input")))
    return t.read(spark, d, "events").select("event_id", whole.alias("input_key"), F.when(F.col("event_id") % 2 == 0, output(user("t"))).otherwise(output(None)).alias("output_key"), keys.partial_key(whole, "root/M").alias("partial_key"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE p_brand || '/o' END AS directories, '/r/' || p_type AS root FROM part""")
def manifest_properties(spark, d):
    root = F.concat(F.lit("/r/"), F.col("p_type"))
    outputs = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array(F.lit("/elsewhere/x"))).otherwise(F.array(F.concat_ws("/", root, "p_brand", F.lit("o")), F.lit("/rx")))
    p = keys.manifest_properties(root, outputs, F.lit("k"), F.lit("h"), F.lit(None).cast("string"))
    return t.read(spark, d, "part").select("p_partkey", p.alias("p")).select("p_partkey", F.array_join("p.outputRelativeDirectories", ";").alias("directories"), F.col("p.rootPath").alias("root"))


@query(f"SELECT path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path)::INT AS place FROM {t.FILES}")
def canonical_order(spark, d):
    w = Window.partitionBy(F.substring_index("path", "/", 1)).orderBy(paths.utf16_order(F.col("path")))
    return t.files(spark, d).select("path", F.row_number().over(w).alias("place"))


@query(f"""WITH dirs AS (SELECT DISTINCT source, source || '/' || lang AS dir FROM {t.FILES}), n AS (SELECT dir, row_number() OVER (PARTITION BY source ORDER BY dir) - 1 AS n FROM dirs)
    SELECT path, '$' || n || '/' || doc_id || '.txt' AS encoded FROM {t.FILES} JOIN n ON dir = source || '/' || lang""")
def directory_references(spark, d):
    """Paths of each source's manifest as a reference to the directory's place and the name."""
    f = t.files(spark, d).withColumn("dir", paths.parent(F.col("path"))).withColumn("m", F.substring_index("path", "/", 1))
    w = Window.partitionBy("m").orderBy("dir")
    places = f.select("m", "dir").distinct().withColumn("n", F.row_number().over(w) - 1)
    return f.join(places, ["m", "dir"]).select("path", F.concat(F.lit("$"), F.col("n").cast("string"), F.lit("/"), paths.name(F.col("path"))).alias("encoded"))


# Transfers -----------------------------------------------------------------------------------------------------------

_SEEN = "(SELECT DISTINCT 'r/Data/' || md5(h::VARCHAR) || '.xxh128' AS key FROM (SELECT o_orderkey % 100 AS h FROM orders) WHERE h % 10 = 3)"
_STORED = f"(SELECT DISTINCT key, length FROM (SELECT 'r/Data/' || hash || '.xxh128' AS key, min(length) AS length FROM {t.PARTS} GROUP BY 1) WHERE key LIKE 'r/Data/a%')"
_PLAN = f"""(WITH p AS (SELECT *, 'r/Data/' || hash || '.xxh128' AS key FROM {t.PARTS}), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path, index) AS n FROM p)
    SELECT n.path, n.index, n.length, n.key, CASE WHEN s.key IS NOT NULL OR st.key IS NOT NULL THEN 'skip_stored' WHEN n = 1 THEN 'upload' ELSE 'skip_repeated' END AS action
    FROM n LEFT JOIN {_SEEN} s ON n.key = s.key LEFT JOIN {_STORED} st ON n.key = st.key AND n.length = st.length)"""


def _plan(spark, d):
    parts = transfer.uploads(t.large_files(spark, d), "r", "Data")
    seen = t.read(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("h")).where("h % 10 = 3").select(keys.content_key("r", "Data", F.md5(F.col("h").cast("string"))).alias("key"))
    stored = parts.groupBy("key").agg(F.min("length").alias("size")).where("startswith(key, 'r/Data/a')")
    return transfer.upload_plan(parts, seen, stored)


@query(f"SELECT path, index, length, key, action FROM {_PLAN}")
def upload_plan(spark, d):
    return _plan(spark, d).select("path", "index", "length", "key", "action")


@query(f"""SELECT count(DISTINCT path) AS files_processed, count(*) FILTER (action = 'upload') AS files_transferred, count(*) FILTER (action <> 'upload') AS files_skipped,
    coalesce(sum(length) FILTER (action = 'upload'), 0)::BIGINT AS bytes_transferred, coalesce(sum(length) FILTER (action <> 'upload'), 0)::BIGINT AS bytes_skipped FROM {_PLAN}""")
def transfer_statistics(spark, d):
    return transfer.transfer_statistics(_plan(spark, d))


@query("SELECT md5(text) AS hash, count(*) AS n, min(n_chars) AS size FROM documents GROUP BY 1")
def content_dedup(spark, d):
    return t.files(spark, d).groupBy("hash").agg(F.count("*").alias("n"), F.min("size").alias("size"))


@query(f"""SELECT CASE WHEN grouping(hour) = 1 THEN NULL ELSE hour END AS hour, count(*) FILTER (action = 'upload') AS n_transferred, count(*) FILTER (action <> 'upload') AS n_skipped,
    coalesce(sum(length) FILTER (action = 'upload'), 0)::BIGINT AS bytes_transferred, coalesce(sum(length) FILTER (action <> 'upload'), 0)::BIGINT AS bytes_skipped, grouping(hour)::TINYINT AS is_total
    FROM (SELECT *, split_part(path, '/', 1) AS hour FROM {_PLAN}) GROUP BY GROUPING SETS ((hour), ())""")
def transfer_summary(spark, d):
    return transfer.group_statistics(_plan(spark, d).withColumn("hour", F.substring_index("path", "/", 1)), "hour")


@query(f"SELECT path, size > 268435456 AS is_large, CASE WHEN size > 268435456 THEN 'chunked' ELSE 'single' END AS strategy, CASE WHEN size > 268435456 THEN md5(h || ':' || (size - 1) // 268435456) ELSE md5(h::VARCHAR) END AS last_block FROM {t.LARGE}")
def upload_strategies(spark, d):
    return t.large_files(spark, d).select("path", transfer.is_large(F.col("size")).alias("is_large"), transfer.upload_strategy(F.col("size")).alias("strategy"), chunks.block_key(F.col("hash"), F.col("chunkhashes"), F.col("size") - 1).alias("last_block"))


@query(f"SELECT CASE WHEN size < 83886080 THEN 'small' ELSE 'large' END AS class, count(*) AS n, sum(size)::BIGINT AS bytes FROM {t.LARGE} GROUP BY 1")
def size_classes(spark, d):
    return transfer.size_classes(t.large_files(spark, d))


@query(f"SELECT path, CASE WHEN doc_id % 4 <> 0 THEN path END AS target, CASE WHEN doc_id % 4 = 0 THEN 'skip' ELSE 'write' END AS action FROM {t.FILES}")
def download_skip(spark, d):
    f = t.files(spark, d)
    return transfer.download_plan(f, f.where("doc_id % 4 = 0"), "skip")


@query(f"""SELECT path, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(path, '\\.txt$', '') || CASE WHEN doc_id % 8 = 0 THEN ' (2).txt' ELSE ' (1).txt' END ELSE path END AS target,
    CASE WHEN doc_id % 4 = 0 THEN 'create_copy' ELSE 'write' END AS action FROM {t.FILES}""")
def download_copies(spark, d):
    f = t.files(spark, d)
    number = lambda n: F.regexp_replace("path", r"\.txt$", f" ({n}).txt").alias("path")
    existing = f.where("doc_id % 4 = 0").select("path").union(f.where("doc_id % 8 = 0").select(number(1))).union(f.where("doc_id % 8 = 0").select(number(3)))
    return transfer.download_plan(f, existing, "create_copy")


# Caches --------------------------------------------------------------------------------------------------------------

_NOW = 1_704_500_000
_ENTRIES = "(SELECT user_id AS k, event_type AS p, event_id, value, epoch_us(ts) // 1000000 + 86400 AS expires_at FROM events)"
_CACHE = f"(SELECT k, p, value, expires_at FROM (SELECT *, row_number() OVER (PARTITION BY k, p ORDER BY event_id DESC) AS n FROM {_ENTRIES}) WHERE n = 1)"


def _cache(spark, d):
    e = t.read(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("p"), "event_id", "value", (F.unix_timestamp("ts") + 86400).alias("expires_at"))
    return transfer.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["k", "p"], "event_id").drop("event_id")


@query(f"SELECT k, p, value, expires_at FROM {_CACHE}")
def hash_cache_upsert(spark, d):
    return _cache(spark, d)


@query(f"SELECT c_custkey, a.k, a.p, value FROM (SELECT c_custkey, c_custkey % 200 AS k, CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'error' END AS p FROM customer) a LEFT JOIN {_CACHE} c ON a.k = c.k AND a.p = c.p AND c.expires_at > {_NOW + 2_000_000}")
def hash_cache_lookup(spark, d):
    asked = t.read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 200).alias("k"), F.when(F.col("c_custkey") % 2 == 0, "click").otherwise("error").alias("p"))
    return transfer.lookup(asked, _cache(spark, d), ["k", "p"], F.lit(_NOW + 2_000_000)).drop("expires_at")


@query(f"SELECT k, p, value, expires_at FROM {_CACHE} WHERE NOT expires_at < {_NOW + 2_000_000}")
def hash_cache_cleanup(spark, d):
    return transfer.cleanup(_cache(spark, d), F.lit(_NOW + 2_000_000))


@query(f"SELECT 'bucket/' || event_id AS s3_key FROM events WHERE event_id % 7 <> 0 AND epoch_us(ts) // 1000000 >= {_NOW + 2_000_000} - 30 * 86400")
def check_cache_seen(spark, d):
    seen = F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(F.unix_timestamp("ts").cast("string"))
    rows = t.read(spark, d, "events").select(F.concat(F.lit("bucket/"), F.col("event_id").cast("string")).alias("s3_key"), seen.alias("last_seen_time"))
    return transfer.seen_keys(rows, F.lit(_NOW + 2_000_000), 30)


@query(f"SELECT count(*) AS n, count(*) FILTER (expires_at > {_NOW + 2_000_000}) AS n_live FROM {_CACHE}")
def cache_counts(spark, d):
    return transfer.cache_counts(_cache(spark, d), F.lit(_NOW + 2_000_000))


def _check_cache(spark, d):
    seen = F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(F.unix_timestamp("ts").cast("string"))
    return t.read(spark, d, "events").select(F.concat(F.lit("bucket/"), F.col("event_id").cast("string")).alias("s3_key"), seen.alias("last_seen_time"), "event_id")


@query(f"""SELECT 'bucket' AS bucket, event_id::VARCHAR AS key, CASE WHEN event_id % 3 = 0 THEN '{_NOW + 2_000_000}' WHEN event_id % 7 = 0 THEN 'unknown' ELSE (epoch_us(ts) // 1000000)::VARCHAR END AS last_seen_time FROM events
    WHERE event_id % 5 <> 0 AND (event_id % 3 = 0 OR (event_id % 7 <> 0 AND epoch_us(ts) // 1000000 >= {_NOW + 2_000_000} - 30 * 86400))""")
def check_cache_kept(spark, d):
    """Marked as uploaded, some taken out, old ones cleaned up."""
    cache = _check_cache(spark, d)
    marked = transfer.mark_uploaded(cache, cache.where("event_id % 3 = 0"), F.lit(_NOW + 2_000_000))
    kept = transfer.forget_old(transfer.forget(marked, cache.where("event_id % 5 = 0")), F.lit(_NOW + 2_000_000), 30)
    return kept.select(transfer.bucket_and_key(F.col("s3_key")).alias("k"), "last_seen_time").select("k.bucket", "k.key", "last_seen_time")


# Discovery -----------------------------------------------------------------------------------------------------------


@query(f"SELECT key, event_id FROM {t.OBJECTS} WHERE event_id % 5 <> 1")
def output_objects(spark, d):
    return discovery.output_objects(t.objects(spark, d)).select("key", "event_id")


@query(f"SELECT key, last_modified, task_id, session_folder, session_action_id FROM {t.PARSED}")
def parse_keys(spark, d):
    return discovery.parse_keys(discovery.output_objects(t.objects(spark, d)))


_LATEST = f"""(WITH w AS (SELECT task_id, session_folder, row_number() OVER (PARTITION BY task_id ORDER BY last_modified DESC, key DESC) AS n FROM {t.PARSED} WHERE task_id IS NOT NULL)
    SELECT p.* FROM {t.PARSED} p LEFT JOIN w ON p.task_id = w.task_id AND w.n = 1 WHERE p.task_id IS NULL OR p.session_folder = w.session_folder)"""


@query(f"SELECT * FROM {_LATEST}")
def latest_per_task(spark, d):
    return discovery.latest_per_task(parse_keys(spark, d))


@query(f"SELECT task_id, count(*) AS n, count(DISTINCT session_folder) AS folders FROM {_LATEST} GROUP BY task_id")
def discover_outputs(spark, d):
    return latest_per_task(spark, d).groupBy("task_id").agg(F.count("*").alias("n"), F.countDistinct("session_folder").alias("folders"))


def _roots(spark, d):
    return t.read(spark, d, "nation").select((F.col("n_nationkey") % 5).cast("long").alias("root_index"), F.md5((F.col("n_nationkey") % 5).cast("string")).alias("root_hash"))


_MATCHED = f"""(SELECT session_action_id, i AS root_index, max(key) AS key FROM {t.PARSED} JOIN (SELECT i, md5(i::VARCHAR) AS h FROM range(5) r(i)) ON contains(key, h) GROUP BY ALL)"""


@query(f"SELECT * FROM {_MATCHED}")
def match_roots(spark, d):
    return discovery.match_roots(parse_keys(spark, d), _roots(spark, d))


@query(f"""SELECT session_action_id, string_agg(coalesce(key, '-'), '|' ORDER BY i) AS keys FROM (SELECT a.session_action_id, r.i, m.key FROM (SELECT DISTINCT session_action_id FROM {_MATCHED}) a
    CROSS JOIN range(5) r(i) LEFT JOIN {_MATCHED} m ON m.session_action_id = a.session_action_id AND m.root_index = r.i) GROUP BY 1""")
def pivot_roots(spark, d):
    pivoted = discovery.pivot_roots(match_roots(spark, d), 5)
    return pivoted.select("session_action_id", F.array_join("keys", "|", "-").alias("keys"))


@query(f"""SELECT session_action_id, key, task_id FROM (SELECT *, min(CASE WHEN task_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_action_id) AS b FROM {t.PARSED}) WHERE (task_id IS NULL)::INT = b""")
def session_action_keys(spark, d):
    return discovery.by_session_action(parse_keys(spark, d)).select("session_action_id", "key", "task_id")


# Locations and mapping -----------------------------------------------------------------------------------------------

_DEEPEST = f"(SELECT a.path, a.kind, l.place, l.location FROM {t.ASSETS} a LEFT JOIN LATERAL (SELECT place, location FROM {t.LOCAL} l WHERE starts_with(a.path, l.place || '/') ORDER BY length(place) DESC LIMIT 1) l ON true)"


@query(f"SELECT path, kind, place, location FROM {_DEEPEST}")
def location_of_path(spark, d):
    return locations.deepest(t.assets(spark, d), F.col("path"), t.places(spark, d)[0])


@query(f"SELECT path, kind FROM {t.ASSETS} a WHERE NOT EXISTS (SELECT 1 FROM {t.SHARED} s WHERE starts_with(a.path, s.place || '/'))")
def skip_shared(spark, d):
    return locations.below_any(t.assets(spark, d), F.col("path"), t.places(spark, d)[1], negate=True)


@query(f"""WITH x AS (SELECT * FROM {_DEEPEST} y WHERE NOT EXISTS (SELECT 1 FROM {t.SHARED} s WHERE starts_with(y.path, s.place || '/'))),
    y AS (SELECT *, coalesce(place, '/' || split_part(path, '/', 2)) AS g FROM x)
    SELECT location, coalesce(place, root) AS root, count(*) FILTER (kind = 'input') AS inputs, count(*) FILTER (kind = 'output') AS outputs, count(*) FILTER (kind = 'reference') AS "references"
    FROM y JOIN """ + _common("y") + """ r USING (g) GROUP BY ALL""")
def asset_groups(spark, d):
    local, shared = t.places(spark, d)
    return locations.asset_groups(t.assets(spark, d), local, shared)


@query(f"""WITH x AS (SELECT * FROM {_DEEPEST} y WHERE NOT EXISTS (SELECT 1 FROM {t.SHARED} s WHERE starts_with(y.path, s.place || '/'))),
    y AS (SELECT DISTINCT *, coalesce(place, '/' || split_part(path, '/', 2)) AS g FROM x)
    SELECT y.location, root, kind, path FROM y JOIN {_common("(SELECT g, path || '/.' AS path FROM y)")} r USING (g)""")
def asset_group_members(spark, d):
    local, shared = t.places(spark, d)
    return locations.group_members(t.assets(spark, d), local, shared)


_PRESENT = f"(SELECT path, CASE WHEN length(path) % 7 = 1 THEN 'directory' ELSE 'file' END AS type FROM {t.ASSETS} WHERE length(path) % 7 <> 0)"


@query(f"""SELECT path, CASE WHEN was = 'missing' THEN 'reference' WHEN was IS NULL THEN kind END AS kind, was FROM (SELECT a.path, a.kind, CASE
    WHEN EXISTS (SELECT 1 FROM {t.SHARED} s WHERE starts_with(a.path, s.place || '/')) THEN 'shared' WHEN a.kind = 'input' AND p.type IS NULL THEN 'missing' WHEN a.kind = 'input' AND p.type = 'directory' THEN 'directory' END AS was
    FROM {t.ASSETS} a LEFT JOIN {_PRESENT} p ON a.path = p.path)""")
def checked_assets(spark, d):
    a, n = t.assets(spark, d), F.length("path") % 7
    present = a.where(n != 0).select("path", F.when(n == 1, "directory").otherwise("file").alias("type"))
    return locations.checked_assets(a, present, t.places(spark, d)[1], strict=False)


@query("SELECT p_type, p_type || '/' || CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) || '/d' ELSE '' END AS root FROM part WHERE p_partkey < 3000 GROUP BY p_type")
def common_path(spark, d):
    path = paths.components(F.concat_ws("/", "p_type", "p_brand", F.lit("d")))
    low = t.read(spark, d, "part").groupBy("p_type").agg(F.min(path).alias("lo"), F.max(path).alias("hi"))
    found = paths.common_directory(F.col("lo"), F.col("hi"))
    return low.select("p_type", F.when(found == F.col("p_type"), F.concat(found, F.lit("/"))).otherwise(found).alias("root"))


_KNOWN = f"(SELECT DISTINCT CASE WHEN length(path) % 3 = 0 THEN path WHEN length(path) % 3 = 1 THEN regexp_replace(path, '/[^/]*$', '') ELSE path || '/more' END AS path FROM {t.ASSETS} WHERE kind = 'input')"


def _known(spark, d):
    p, n = F.col("path"), F.length("path") % 3
    return t.assets(spark, d).where("kind = 'input'").select(F.when(n == 0, p).when(n == 1, paths.parent(p)).otherwise(F.concat(p, F.lit("/more"))).alias("path"))


@query(f"SELECT path FROM {_KNOWN} k WHERE NOT EXISTS (SELECT 1 FROM {_KNOWN} o WHERE starts_with(k.path, o.path || '/'))")
def redundant_paths(spark, d):
    return locations.without_redundant(_known(spark, d))


@query(f"SELECT path, EXISTS (SELECT 1 FROM {_KNOWN} k WHERE a.path = k.path OR starts_with(a.path, k.path || '/')) AS is_known FROM {t.ASSETS} a")
def classify_paths(spark, d):
    return locations.classify_known(t.assets(spark, d).select("path"), _known(spark, d).distinct())


@query("""SELECT n_name AS name, '/' || r_name || '/' || n_name AS source_path, 'Z:/' || n_name AS destination_path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0""")
def mapping_rules(spark, d):
    return locations.mapping_rules(*_profiles(spark, d))


def _profiles(spark, d):
    n, r = t.read(spark, d, "nation"), t.read(spark, d, "region")
    source = n.join(r, n.n_regionkey == r.r_regionkey).where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"), F.concat_ws("/", F.lit(""), "r_name", "n_name").alias("path"))
    return source, n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("name"), F.concat(F.lit("Z:/"), F.col("n_name")).alias("path"))


@query("""SELECT '/' || r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path,
    CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0 THEN 'Z:/' || n_name || '/' || c_mktsegment || '/' || c_name END AS mapped FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def map_paths(spark, d):
    return locations.map_paths(t.assets(spark, d).select("path"), mapping_rules(spark, d))


@query("""SELECT '/' || r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0 OR n_nationkey % 4 = 0""")
def unmapped_paths(spark, d):
    return map_paths(spark, d).where("mapped IS NULL").select("path")


@query("""SELECT '/' || r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path,
    CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0 THEN 'Z:/' || n_name || '/' || c_mktsegment || '/' || c_name END AS mapped FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def map_paths_any_case(spark, d):
    """As map_paths, by rules in other cases and with '\\'."""
    rules = mapping_rules(spark, d).withColumn("source_path", F.replace(F.lower("source_path"), F.lit("/"), F.lit("\\")))
    return locations.map_paths(t.assets(spark, d).select("path"), rules, fold_case=True)


@query(f"SELECT path, CASE WHEN starts_with(path, '/ASIA/') THEN '/mnt' || substr(path, 6) END AS mapped FROM {t.ASSETS}")
def map_by_one_rule(spark, d):
    return t.assets(spark, d).select("path", locations.mapped_one(F.col("path"), "/ASIA/", "/mnt").alias("mapped"))


# Trees and reads -----------------------------------------------------------------------------------------------------

_TREE = f"""(SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name, 'file' AS type, size FROM {t.FILES}
    UNION ALL SELECT DISTINCT source || '/' || lang, source, lang, 'directory', NULL FROM {t.FILES} UNION ALL SELECT DISTINCT source, '', source, 'directory', NULL FROM {t.FILES})"""


@query(f"SELECT * FROM {_TREE}")
def tree_nodes(spark, d):
    return tree.nodes(t.files(spark, d))


@query(f"SELECT parent, count(*) AS n, count(*) FILTER (type = 'file') AS n_files FROM {_TREE} GROUP BY parent")
def list_directories(spark, d):
    return tree_nodes(spark, d).groupBy("parent").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "file").alias("n_files"))


@query(f"""SELECT * FROM {_TREE} WHERE NOT (type = 'file' AND size % 7 = 0) AND NOT (type = 'file' AND size % 7 = 1)
    UNION ALL SELECT path, parent, name, type, size + 5 FROM {_TREE} WHERE type = 'file' AND size % 7 = 1""")
def overlay_listing(spark, d):
    n = tree_nodes(spark, d)
    return tree.listing(n, n.where("type = 'file' AND size % 7 = 0").select("path"), n.where("type = 'file' AND size % 7 = 1").select("path", "type", (F.col("size") + 5).alias("size")))


@query(f"SELECT upper(path) AS wanted, path, parent, name, type, size FROM {_TREE}")
def lookup_any_case(spark, d):
    n = tree_nodes(spark, d)
    return tree.lookup(n, n.select(F.upper("path").alias("wanted")))


@query(f"SELECT min(path) AS path FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN upper(path) ELSE path END AS path, doc_id // 2 AS k FROM {t.FILES}) GROUP BY regexp_replace(path, '/[^/]*$', ''), lower(regexp_extract(path, '[^/]*$'))")
def first_names(spark, d):
    rows = t.files(spark, d).select(F.when(F.col("doc_id") % 2 == 0, F.upper("path")).otherwise(F.col("path")).alias("path"))
    return tree.first_per_name(rows.select("path", paths.parent(F.col("path")).alias("parent"), paths.name(F.col("path")).alias("name"))).select("path")


@query(f"SELECT path FROM {t.FILES} WHERE NOT (source = 'src2' AND lang IN ('en', 'de')) AND NOT (doc_id % 6 = 0)")
def without_removed(spark, d):
    f = t.files(spark, d)
    gone = f.where("doc_id % 6 = 0").select("path").union(spark.createDataFrame([("src2/en",), ("src2/de",)], "path string"))
    return tree.without_below(f.select("path"), gone)


@query(f"""SELECT p AS path, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM (SELECT source AS p, size FROM {t.FILES} UNION ALL SELECT source || '/' || lang, size FROM {t.FILES}) GROUP BY p""")
def directory_sizes(spark, d):
    return tree.directory_sizes(t.files(spark, d))


@query(f"""WITH r AS (SELECT o_orderkey AS read_id, path, o_orderkey * 12345678 % 4000000000 AS o, 700000000 AS n, size FROM {t.LARGE}),
    e AS (SELECT read_id, path, o, greatest(least(n, size - o), 0) AS n FROM r), x AS (SELECT *, unnest(range(o // 268435456, (o + n - 1) // 268435456 + 1)) AS index FROM e WHERE n > 0)
    SELECT read_id, path, index, greatest(o - index * 268435456, 0) AS start, least(o + n, (index + 1) * 268435456) - greatest(o, index * 268435456) AS length FROM x""")
def read_ranges(spark, d):
    f = t.large_files(spark, d)
    reads = f.select(F.col("o_orderkey").alias("read_id"), "path", (F.col("o_orderkey") * 12345678 % 4_000_000_000).alias("offset"), F.lit(700_000_000).cast("long").alias("length"))
    return tree.read_ranges(reads, f)


_BLOCKS = "(SELECT user_id AS block, min(epoch_us(ts) - 1704067200000000) AS first, count(*) AS n FROM events GROUP BY user_id)"


def _blocks(spark, d):
    trace = t.read(spark, d, "events").select(F.col("user_id").alias("block"), (F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000).alias("ts"))
    return tree.access(trace)


@query(f"SELECT block, first, n FROM {_BLOCKS}")
def block_access(spark, d):
    return _blocks(spark, d)


@query(f"SELECT block, round(1 / (1 + first / 1e6), 9) AS priority FROM {_BLOCKS} WHERE first <= 9000000000")
def read_ahead_first(spark, d):
    return tree.ranked_by_first(_blocks(spark, d), 9_000_000_000).select("block", F.round("priority", 9).alias("priority"))


@query(f"SELECT block, n FROM {_BLOCKS} ORDER BY n DESC, first, block LIMIT 20")
def read_ahead_frequent(spark, d):
    return _blocks(spark, d).orderBy(F.desc("n"), "first", "block").limit(20).select("block", "n")


@query(f"SELECT block, round(0.7 * (1 - (first - lo) / (hi - lo)) + 0.3 * n / m, 6) AS priority FROM {_BLOCKS}, (SELECT min(first) AS lo, max(first) AS hi, max(n) AS m FROM {_BLOCKS})")
def read_ahead_weighted(spark, d):
    return tree.ranked_by_weight(_blocks(spark, d)).select("block", F.round("priority", 6).alias("priority"))


@query(f"SELECT block, first FROM {_BLOCKS} ORDER BY first, block LIMIT 12")
def read_ahead_budget(spark, d):
    return tree.within_budget(_blocks(spark, d), 12 * 268435456 + 5, "first", "block").select("block", "first")


@query("SELECT count(*) FILTER (event_id % 3 = 0) AS hits, count(*) FILTER (event_id % 3 <> 0) AS misses, coalesce(count(*) FILTER (event_id % 3 = 0) * 100.0::DOUBLE / count(*), 0) AS hit_rate FROM events")
def cache_hit_rate(spark, d):
    return tree.hit_rate(t.read(spark, d, "events").select((F.col("event_id") % 3 == 0).alias("hit")))


# Changes -------------------------------------------------------------------------------------------------------------

_NET = f"""(WITH e AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('create', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'create', false) AS c FROM {t.CHANGES}),
    f AS (SELECT path, arg_max(op, (ts, event_id)) FILTER (op IN ('create', 'delete')) AS last, arg_max(c, (ts, event_id)) FILTER (op IN ('create', 'delete')) AS was,
    max((ts, event_id)) FILTER (op = 'modify' AND NOT c) AS m, max((ts, event_id)) FILTER (op = 'delete' AND NOT c) AS b FROM e GROUP BY path)
    SELECT path, coalesce(last = 'create', false) AS created, m IS NOT NULL AND (b IS NULL OR b < m) AS modified, coalesce(last = 'delete' AND NOT was, false) AS deleted FROM f)"""


@query(f"SELECT * FROM {_NET} WHERE created OR modified OR deleted")
def net_changes(spark, d):
    return changes.net_changes(t.changes(spark, d), order=["ts", "event_id"])


_STATES = f"""(WITH f AS (SELECT path, arg_max(op, (ts, event_id)) AS op FROM {t.CHANGES} WHERE op <> 'read' GROUP BY path), o AS (SELECT DISTINCT path FROM {t.CHANGES} WHERE event_id % 4 = 0)
    SELECT f.path, CASE WHEN op = 'delete' AND o.path IS NOT NULL THEN 'deleted' WHEN op = 'delete' THEN NULL WHEN o.path IS NOT NULL THEN 'modified' ELSE 'new' END AS state FROM f LEFT JOIN o ON f.path = o.path)"""


def _states(spark, d):
    e = t.changes(spark, d)
    return changes.file_states(e, e.where("event_id % 4 = 0").select("path"), order=["ts", "event_id"])


@query(f"SELECT * FROM {_STATES} WHERE state IS NOT NULL")
def file_states(spark, d):
    return _states(spark, d)


@query(f"SELECT count(*) FILTER (state = 'new') AS n_new, count(*) FILTER (state = 'modified') AS n_modified, count(*) FILTER (state = 'deleted') AS n_deleted, count(*) AS n_total, count(*) > 0 AS has_changes FROM {_STATES} WHERE state IS NOT NULL")
def change_summary(spark, d):
    return changes.summary(_states(spark, d))


@query(f"""WITH r AS (SELECT ts, event_id, path, op, 0 AS part FROM {t.CHANGES} WHERE event_id % 5 <> 0 UNION ALL SELECT ts, event_id, path, 'delete', 0 FROM {t.CHANGES} WHERE event_id % 5 = 0
    UNION ALL SELECT ts, event_id, path || '.new', 'create', 1 FROM {t.CHANGES} WHERE event_id % 5 = 0), f AS (SELECT path, arg_max(op, (ts, event_id, part)) AS op FROM r WHERE op <> 'read' GROUP BY path)
    SELECT path, CASE op WHEN 'delete' THEN NULL ELSE 'new' END AS state FROM f WHERE op <> 'delete'""")
def renamed_states(spark, d):
    """Some changes are renames: a delete and a create at the same moment."""
    e = t.changes(spark, d)
    renamed = F.col("event_id") % 5 == 0
    moved = changes.with_renames(e.select("seq", F.when(renamed, "rename").otherwise(F.col("op")).alias("op"), "path", F.concat("path", F.lit(".new")).alias("new_path")))
    return changes.file_states(moved, e.select("path").limit(0), order=["seq", "part"])


@query(f"SELECT path, mtime FROM {t.FILES} f WHERE doc_id % 7 = 0 OR doc_id % 3 = 1")
def new_outputs(spark, d):
    f = t.files(spark, d)
    recorded = f.where("doc_id % 7 <> 0").select("path", (F.col("mtime") - F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0)).alias("mtime"))
    return changes.outputs_since(f.select("path", "mtime"), recorded)


@query(f"""WITH f AS (SELECT path, arg_max(op, (ts, event_id)) AS op FROM {t.CHANGES} WHERE op IN ('create', 'delete') GROUP BY path), o AS (SELECT DISTINCT path FROM {t.CHANGES} WHERE event_id % 10 = 0),
    s AS (SELECT f.path, CASE WHEN op = 'delete' AND o.path IS NOT NULL THEN 'deleted' WHEN op = 'create' AND o.path IS NULL THEN 'new' END AS state FROM f LEFT JOIN o ON f.path = o.path) SELECT * FROM s WHERE state IS NOT NULL""")
def directory_states(spark, d):
    e = t.changes(spark, d)
    return changes.directory_states(e, e.where("event_id % 10 = 0").select("path"), order=["ts", "event_id"])


# Manifests as JSON ---------------------------------------------------------------------------------------------------

_ENTRY = """'{' || CASE WHEN kind = 2 THEN '"chunkhashes":["' || md5(hash || '0') || '","' || md5(hash || '1') || '"],' ELSE '' END || CASE WHEN kind = 3 THEN '"deleted":true,' ELSE '' END
    || CASE WHEN kind IN (0, 4) THEN '"hash":"' || hash || '",' ELSE '' END || CASE WHEN kind IN (0, 2, 4) THEN '"mtime":' || mtime || ',' ELSE '' END
    || '"path":"' || CASE WHEN kind = 4 THEN lang || '/é\\"' || doc_id ELSE '$' || n || '/' || doc_id || '.txt' END || '"'
    || CASE WHEN kind IN (0, 2, 4) AND doc_id % 3 = 0 THEN ',"runnable":true' ELSE '' END || CASE WHEN kind IN (0, 2, 4) THEN ',"size":' || size ELSE '' END
    || CASE WHEN kind = 1 THEN ',"symlink":{"target":"$' || n || '/' || (doc_id + 1) || '.txt"}' ELSE '' END || '}'"""
_ENCODED = f"""WITH x AS (SELECT source, lang, doc_id, md5(text) AS hash, n_chars AS size, {t.BASE_MTIME} + doc_id * 1000 AS mtime, doc_id // 20 % 5 AS kind FROM documents),
    dirs AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS n FROM (SELECT DISTINCT source, lang FROM x WHERE kind <> 4)), l AS (SELECT x.*, n FROM x LEFT JOIN dirs USING (source, lang)),
    f AS (SELECT source, '[' || string_agg({_ENTRY}, ',' ORDER BY CASE WHEN kind = 4 THEN lang || '/é"' || doc_id ELSE lang || '/' || doc_id || '.txt' END) || ']' AS files, coalesce(sum(size) FILTER (kind IN (0, 2, 4)), 0)::BIGINT AS total FROM l GROUP BY source),
    g AS (SELECT source, '[' || string_agg('{{"path":"' || lang || '"}}', ',' ORDER BY lang) || ']' AS dirs FROM dirs GROUP BY source)
    SELECT source AS manifest_id, '{{"dirs":' || coalesce(dirs, '[]') || ',"files":' || files || ',"hashAlg":"xxh128","parentManifestHash":"p","specificationVersion":"relative-manifest-diff-beta-2025-12","totalSize":' || total || '}}' AS json FROM f LEFT JOIN g USING (source)"""


def _model(spark, d):
    """Manifests of each source's documents: files, links, chunked and deleted ones, some with odd names in folders that are no row."""
    k = F.floor(F.col("doc_id") / 20) % 5
    null = lambda c, *kinds: F.when(k.isin(*kinds), F.col(c))
    plain = F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    rows = t.read(spark, d, "documents").withColumns({"h": F.md5("text"), "m": F.lit(t.BASE_MTIME) + F.col("doc_id") * 1000})
    files = rows.select(
        F.col("source").alias("manifest_id"), F.when(k == 4, F.concat("lang", F.lit('/é"'), F.col("doc_id").cast("string"))).otherwise(plain).alias("path"), null("h", 0, 4).alias("hash"), null("n_chars", 0, 2, 4).alias("size"),
        null("m", 0, 2, 4).alias("mtime"), (k.isin(0, 2, 4) & (F.col("doc_id") % 3 == 0)).alias("runnable"), F.when(k == 2, F.array(F.md5(F.concat("h", F.lit("0"))), F.md5(F.concat("h", F.lit("1"))))).alias("chunkhashes"),
        F.when(k == 1, F.concat_ws("/", "lang", F.concat((F.col("doc_id") + 1).cast("string"), F.lit(".txt")))).alias("symlink_target"), (k == 3).alias("deleted"), "doc_id",
    )
    dirs = rows.where(k != 4).select(F.col("source").alias("manifest_id"), F.col("lang").alias("path"), F.lit(False).alias("deleted")).distinct()
    headers = rows.select(F.col("source").alias("manifest_id"), F.lit(manifests.SPEC_VERSIONS[3]).alias("spec_version"), F.lit("xxh128").alias("hash_alg"), F.lit("p").alias("parent_manifest_hash")).distinct()
    return headers, files, dirs


@query(_ENCODED.replace("lang || '/é\\\"' || doc_id ELSE", "CASE WHEN n IS NULL THEN lang ELSE '$' || n END || '/é\\\"' || doc_id ELSE"))
def encode_v2025(spark, d):
    return encode.encode(*_model(spark, d))


@query("""SELECT source AS manifest_id, '{"hashAlg":"xxh128","manifestVersion":"2023-03-03","paths":[' || string_agg('{"hash":"' || md5(text) || '","mtime":' || doc_id || ',"path":"' || lang || '/' || doc_id || '","size":' || n_chars || '}', ',' ORDER BY lang || '/' || doc_id)
    || '],"totalSize":' || sum(n_chars)::BIGINT || '}' AS json FROM documents GROUP BY source""")
def encode_v2023(spark, d):
    return encode.encode_2023(_older(spark, d))


def _older(spark, d):
    return t.read(spark, d, "documents").select(F.col("source").alias("manifest_id"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("hash"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))


@query(f"""SELECT source AS manifest_id, CASE WHEN k = 4 THEN lang || '/é"' || doc_id ELSE lang || '/' || doc_id || '.txt' END AS path, CASE WHEN k IN (0, 4) THEN md5(text) END AS hash, CASE WHEN k IN (0, 2, 4) THEN n_chars END AS size,
    CASE WHEN k IN (0, 2, 4) THEN {t.BASE_MTIME} + doc_id * 1000 END AS mtime, k IN (0, 2, 4) AND doc_id % 3 = 0 AS runnable, CASE WHEN k = 2 THEN md5(md5(text) || '0') || ',' || md5(md5(text) || '1') END AS chunkhashes,
    CASE WHEN k = 1 THEN lang || '/' || (doc_id + 1) || '.txt' END AS symlink_target, k = 3 AS deleted FROM (SELECT *, doc_id // 20 % 5 AS k FROM documents)""")
def round_trip_json(spark, d):
    """Encoded and read again, checked for a known version."""
    read = manifests.files(manifests.checked(encode.encode(*_model(spark, d))))
    return read.select("manifest_id", "path", "hash", "size", "mtime", "runnable", F.array_join("chunkhashes", ",").alias("chunkhashes"), "symlink_target", "deleted")


@query("SELECT source AS manifest_id, '2023-03-03' AS version, count(*) AS n, sum(n_chars)::BIGINT AS size, max(lang || '/' || doc_id) AS last FROM documents GROUP BY source")
def round_trip_v2023(spark, d):
    text = encode.encode_2023(_older(spark, d))
    files = manifests.older_files(text).groupBy("manifest_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("path").alias("last"))
    return manifests.versions(text).select("manifest_id", "version").join(files, "manifest_id")


@query("SELECT n_nationkey, ['absolute', 'relative'][(n_nationkey % 2 + 1)::INT] AS path_style, ['snapshot', 'diff'][(n_regionkey % 2 + 1)::INT] AS kind, ['absolute', 'relative'][(n_nationkey % 2 + 1)::INT] || '-manifest-' || ['snapshot', 'diff'][(n_regionkey % 2 + 1)::INT] || '-beta-2025-12' AS name FROM nation")
def spec_versions(spark, d):
    pick = lambda c, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(c) % 2 + 1).cast("int"))
    rows = t.read(spark, d, "nation").select("n_nationkey", manifests.spec_name(pick("n_nationkey", "absolute", "relative"), pick("n_regionkey", "snapshot", "diff")).alias("name"))
    return rows.withColumn("v", manifests.spec_version(F.col("name"))).select("n_nationkey", F.col("v.path_style").alias("path_style"), F.col("v.type").alias("kind"), "name")


@query(f"SELECT idx, count(*) AS n_files, sum(size)::BIGINT AS total_size, md5(string_agg(path, '|' ORDER BY path)) AS paths FROM {t.VERSIONS} GROUP BY idx")
def sorted_paths(spark, d):
    return merge.sorted_paths(t.versions(spark, d), "idx").select("idx", "n_files", "total_size", F.md5(F.array_join("paths", "|")).alias("paths"))


# Stores and directories ----------------------------------------------------------------------------------------------


def _stored(spark, d, folder):
    """Documents in a store: (doc_id, path, hash, size, written), by one pass over the texts."""
    rows = t.read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return _once(store.put_rows(rows, folder), f"{folder}.written")


@query("SELECT count(DISTINCT text) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def store_contents(spark, d):
    """Distinct contents, written by their hash and listed."""
    folder = new_folder(spark, "store")
    _stored(spark, d, folder)
    return store.objects(spark, folder).where("endswith(key, '.xxh128')").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT doc_id, md5(encode(text)[doc_id % 50 + 1 : doc_id % 50 + 20]) AS part FROM documents")
def store_ranges(spark, d):
    folder = new_folder(spark, "store")
    rows = _stored(spark, d, folder)
    asked = rows.select("doc_id", "hash", (F.col("doc_id") % 50).alias("offset"), F.lit(20).cast("long").alias("length"))
    return store.retrieve(asked, folder).select("doc_id", F.md5("content").alias("part"))


def _tree(spark, d):
    """Documents stored and downloaded into a folder: the folder, and (path, hash) of what is there."""
    folder, to = new_folder(spark, "store"), new_folder(spark, "tree")
    rows = _stored(spark, d, folder).select(F.col("path").alias("target"), F.lit(0).cast("long").alias("index"), "hash")
    store.download(rows, folder, to).write.parquet(f"{folder}.done")
    return to, rows


def _once(rows, path):
    """Rows written to a folder and read from it: what uses them several times does not make them anew."""
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


@query("SELECT path, octet_length(encode(text)) AS size, true AS same, false AS runnable FROM (SELECT *, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)")
def scan_snapshot(spark, d):
    """A folder's walk, hashed, against the hashes of what was written there."""
    to, rows = _tree(spark, d)
    files, _ = scan.snapshot(_once(directory.walk(spark, to, 2), f"{to}.walk"), to)
    known = rows.select(F.col("target").alias("path"), F.col("hash").alias("_hash"))
    return files.join(known, "path").select("path", "size", (F.col("hash") == F.col("_hash")).alias("same"), "runnable")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'added' WHEN doc_id % 4 = 1 AND octet_length(encode(text)) > 0 THEN 'modified' ELSE 'unchanged' END AS status FROM documents) GROUP BY 1
    UNION ALL SELECT 'deleted', 1""")
def scan_status(spark, d):
    """A folder's walk against a manifest that lacks some files, has others with another content and one that is gone."""
    to, rows = _tree(spark, d)
    entries = _once(directory.walk(spark, to), f"{to}.walk")
    now, dirs = scan.snapshot(entries, to)
    now = _once(now, f"{to}.now")
    k = F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long") % 4
    known = now.where(k != 0).withColumn("hash", F.when((k == 1) & (F.col("size") > 0), "other").otherwise(F.col("hash")))
    gone = now.limit(1).withColumn("path", F.lit("gone"))
    return diff.rollup(scan.directory_status(known.union(gone), dirs, entries, to, hashed=True)[0])


@query("SELECT count(*) AS n, sum(octet_length(encode(json)))::BIGINT AS bytes, count(*) FILTER (doc) AS n_there FROM (SELECT '{\"k\":' || n_nationkey || '}' AS json, true AS doc FROM nation)")
def published_manifests(spark, d):
    """Manifests put under their keys, and looked up in a listing."""
    folder = new_folder(spark, "manifests")
    rows = t.read(spark, d, "nation").select(F.concat(F.lit("farm/queue/Inputs/g/"), F.md5(F.col("n_nationkey").cast("string")), F.lit("_input")).alias("key"), F.concat(F.lit('{"k":'), F.col("n_nationkey").cast("string"), F.lit("}")).alias("json"))
    store.publish(rows, folder).write.parquet(f"{folder}.written")
    listed = store.objects(spark, folder, ("farm/queue",))
    asked = store.contains(spark.read.parquet(f"{folder}.written").select("key", "size"), listed)
    return asked.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_if("is_there").alias("n_there"))


@query(f"""SELECT path, CASE state WHEN 'deleted' THEN NULL ELSE n END AS size, state = 'deleted' AS deleted FROM {_STATES} JOIN (SELECT path, count(*) AS n FROM {t.CHANGES} GROUP BY path) USING (path) WHERE state IS NOT NULL""")
def difference_of_changes(spark, d):
    """The difference manifest that a stream of changes makes."""
    files = t.changes(spark, d).groupBy("path").agg(F.count("*").alias("size"))
    return changes.difference_rows(_states(spark, d), files).select("path", "size", "deleted")


@query("""SELECT source AS manifest_id, CASE WHEN k = 0 THEN 'SnapshotWithDeletions' WHEN k = 2 THEN 'DiffWithoutParent' END AS problem FROM (SELECT DISTINCT source, length(source) % 3 AS k FROM documents)
    WHERE true""")
def header_problems(spark, d):
    k = F.length("manifest_id") % 3
    rows = t.read(spark, d, "documents").select(F.col("source").alias("manifest_id"))
    headers = rows.distinct().select("manifest_id", F.when(k == 2, manifests.SPEC_VERSIONS[3]).otherwise(manifests.SPEC_VERSIONS[2]).alias("spec_version"), F.lit(None).cast("string").alias("parent_manifest_hash"))
    gone = rows.select("manifest_id", (k == 0).alias("deleted"))
    return manifests.header_problem(gone, gone.limit(0), headers)


# Streams -------------------------------------------------------------------------------------------------------------


def _streamed(spark, d, make, name):
    """A stream of events, run to its end; what it has written."""
    folder = new_folder(spark, name)
    stream = spark.readStream.schema(t.read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    query_ = make(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}.state").trigger(availableNow=True).start(folder)
    query_.awaitTermination()
    return spark.read.parquet(folder)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    return _streamed(spark, d, lambda s: access.first_seen(s.select("ts", "user_id", "event_type"), ["user_id", "event_type"], delay="3650 days"), "seen").select("user_id", "event_type")


_ENDED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query(f"SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= {_ENDED}")
def stream_access_counts(spark, d):
    """Counts of the days that had ended when the stream did."""
    found = _streamed(spark, d, lambda s: access.access_counts(s.select("ts", "event_type"), ["event_type"]), "counts")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(f"""SELECT strftime(day, '%Y-%m-%d') AS day, path, CASE WHEN op = 'delete' THEN 'deleted' ELSE 'there' END AS state FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, path, arg_max(op, (ts, event_id)) AS op FROM {t.CHANGES} WHERE op <> 'read' GROUP BY ALL)
    WHERE day + INTERVAL 1 DAY <= {_ENDED}""")
def stream_net_changes(spark, d):
    found = _streamed(spark, d, lambda s: incremental.net_changes(t.as_changes(s), width="1 day"), "changes")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "path", "state")


@query("SELECT user_id % 20 AS root, user_id AS path, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def stream_merged_outputs(spark, d):
    """A stream merged batch by batch: of each root and path the last."""
    folder = new_folder(spark, "merged")
    stream = spark.readStream.schema(t.read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.select((F.col("user_id") % 20).alias("root"), F.col("user_id").alias("path"), F.col("ts").alias("last_modified"), F.col("event_id").alias("manifest_id"), "value")
    incremental.merge_outputs(rows, folder, f"{folder}.state").awaitTermination()
    return incremental.merged(spark, folder).select("root", "path", "value")
