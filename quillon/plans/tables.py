"""The model's relations, made from the test tables; each with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MTIME = 1_700_000_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Files of documents: path, hash, size, mtime, runnable, chunkhashes, symlink_target, deleted, doc_id."""
    return read(spark, d, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.md5("text").alias("hash"), F.col("n_chars").alias("size"),
        (F.lit(BASE_MTIME) + F.col("doc_id") * 1000).alias("mtime"), (F.col("doc_id") % 3 == 0).alias("runnable"),
        F.lit(None).cast("array<string>").alias("chunkhashes"), F.lit(None).cast("string").alias("symlink_target"), F.lit(False).alias("deleted"), "doc_id",
    )


FILES = f"(SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, md5(text) AS hash, n_chars AS size, {BASE_MTIME} + doc_id * 1000 AS mtime, doc_id % 3 = 0 AS runnable, doc_id, source, lang FROM documents)"


def parent(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where("doc_id % 7 <> 0")


def current(spark: SparkSession, d: str) -> DataFrame:
    touched = F.col("doc_id") % 5 == 0
    return files(spark, d).where("doc_id % 11 <> 0").withColumns({
        "hash": F.when(touched, F.md5(F.concat("hash", F.lit("x")))).otherwise(F.col("hash")),
        "size": F.when(F.col("doc_id") % 10 == 0, F.col("size") + 1).otherwise(F.col("size")),
        "mtime": F.when(touched, F.col("mtime") + 10).when(F.col("doc_id") % 4 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")),
        "runnable": F.when(F.col("doc_id") % 13 == 0, ~F.col("runnable")).otherwise(F.col("runnable")),
    })


PARENT = f"(SELECT * FROM {FILES} WHERE doc_id % 7 <> 0)"
CURRENT = f"""(SELECT path, CASE WHEN doc_id % 5 = 0 THEN md5(hash || 'x') ELSE hash END AS hash, CASE WHEN doc_id % 10 = 0 THEN size + 1 ELSE size END AS size,
    CASE WHEN doc_id % 5 = 0 THEN mtime + 10 WHEN doc_id % 4 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN doc_id % 13 = 0 THEN NOT runnable ELSE runnable END AS runnable, doc_id
    FROM {FILES} WHERE doc_id % 11 <> 0)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """A sequence of manifests from lineitem: idx, ts, seq, path, size, deleted."""
    return read(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("idx"), F.unix_timestamp("l_shipdate").alias("ts"), F.col("l_orderkey").alias("seq"),
        F.concat_ws("/", (F.col("l_partkey") % 97).cast("string"), F.col("l_suppkey").cast("string"), (F.col("l_partkey") % 11).cast("string")).alias("path"),
        F.col("l_quantity").cast("long").alias("size"), (F.col("l_returnflag") == "R").alias("deleted"),
    )


VERSIONS = """(SELECT l_linenumber::BIGINT AS idx, epoch(l_shipdate)::BIGINT AS ts, l_orderkey AS seq, (l_partkey % 97) || '/' || l_suppkey || '/' || (l_partkey % 11) AS path,
    l_quantity::BIGINT AS size, l_returnflag = 'R' AS deleted FROM lineitem)"""


def version_dirs(spark: SparkSession, d: str) -> DataFrame:
    """Directory rows of the same manifests, from orders: some deleted."""
    return read(spark, d, "orders").select(
        (F.col("o_orderkey") % 7 + 1).alias("idx"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") % 97).cast("string")).otherwise(F.concat_ws("/", (F.col("o_custkey") % 97).cast("string"), (F.col("o_orderkey") % 50).cast("string"))).alias("path"),
        (F.col("o_orderkey") % 5 == 0).alias("deleted"),
    )


VERSION_DIRS = """(SELECT o_orderkey % 7 + 1 AS idx, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 97)::VARCHAR ELSE (o_custkey % 97) || '/' || (o_orderkey % 50) END AS path,
    o_orderkey % 5 = 0 AS deleted FROM orders)"""


def objects(spark: SparkSession, d: str) -> DataFrame:
    """A listing of output manifests from events."""
    e = read(spark, d, "events")
    task = F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("task-"), F.col("user_id").cast("string"), F.lit("/")))
    folder = F.concat((F.col("event_id") % 40).cast("string"), F.lit("_sessionaction-"), (F.col("event_id") % 200).cast("string"))
    ending = F.when(F.col("event_id") % 5 == 0, "_output.json").when(F.col("event_id") % 5 == 1, "_input").otherwise("_output")
    key = F.concat(F.lit("Manifests/f/q/j/step-"), (F.col("user_id") % 6).cast("string"), F.lit("/"), task, folder, F.lit("/"), F.md5((F.col("event_id") % 8).cast("string")), ending)
    return e.select(key.alias("key"), F.lit(1).cast("long").alias("size"), F.when(F.col("event_id") % 13 != 0, F.unix_timestamp("ts")).alias("last_modified"), F.col("event_id").alias("event_id"))


OBJECTS = """(SELECT 'Manifests/f/q/j/step-' || (user_id % 6) || '/' || CASE WHEN event_id % 9 = 0 THEN '' ELSE 'task-' || user_id || '/' END
    || (event_id % 40) || '_sessionaction-' || (event_id % 200) || '/' || md5((event_id % 8)::VARCHAR) || CASE WHEN event_id % 5 = 0 THEN '_output.json' WHEN event_id % 5 = 1 THEN '_input' ELSE '_output' END AS key,
    CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) // 1000000 END AS last_modified, event_id FROM events)"""
PARSED = f"""(SELECT key, coalesce(last_modified, 0)::BIGINT AS last_modified, nullif(regexp_extract(key, 'step-[^/]+/(task-[^/]+)/', 1), '') AS task_id,
    regexp_extract(key, '/([^/]+_sessionaction-[^/]+)/', 1) AS session_folder, regexp_extract(key, '(sessionaction-[^/]+)', 1) AS session_action_id
    FROM {OBJECTS} WHERE key LIKE '%\\_output' ESCAPE '\\' OR key LIKE '%\\_output.json' ESCAPE '\\')"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes to files from events: seq, path, op."""
    return as_changes(read(spark, d, "events"))


def as_changes(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "modify").when(F.col("event_type") == "error", "delete").otherwise("read")
    return events.select(F.struct("ts", "event_id").alias("seq"), "ts", "event_id", F.concat(F.lit("f/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 3).cast("string")).alias("path"), op.alias("op"))


CHANGES = """(SELECT ts, event_id, 'f/' || user_id || '/' || (event_id % 3) AS path,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'modify' WHEN 'error' THEN 'delete' ELSE 'read' END AS op FROM events)"""


def large_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of hundreds of MB from orders; those over a chunk have chunk hashes."""
    size = F.round(F.col("o_totalprice") * 10000).cast("long")
    n = F.ceil(size / F.lit(268435456)).cast("int")
    path = F.concat_ws("/", "o_orderpriority", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.md5(F.concat_ws(":", (F.col("o_orderkey") % 100).cast("string"), i.cast("string"))))
    return read(spark, d, "orders").select(
        path.alias("path"), F.when(size <= 268435456, F.md5((F.col("o_orderkey") % 100).cast("string"))).alias("hash"), size.alias("size"), F.col("o_orderkey").alias("mtime"), F.lit(False).alias("runnable"),
        F.when(size > 268435456, chunks).alias("chunkhashes"), F.lit(None).cast("string").alias("symlink_target"), (F.col("o_orderstatus") == "P").alias("deleted"), "o_orderkey",
    )


LARGE = """(SELECT o_orderpriority || '/' || o_custkey || '/' || o_orderkey AS path, round(o_totalprice * 10000)::BIGINT AS size, o_orderkey, o_orderkey % 100 AS h, o_orderstatus = 'P' AS deleted FROM orders)"""
PARTS = f"""(SELECT path, i AS index, i * 268435456 AS "offset", CASE WHEN size <= 268435456 THEN size ELSE least(268435456, size - i * 268435456) END AS length,
    CASE WHEN size <= 268435456 THEN md5(h::VARCHAR) ELSE md5(h || ':' || i) END AS hash
    FROM (SELECT path, size, h, unnest(range(greatest(1, (size + 268435455) // 268435456))) AS i FROM {LARGE} WHERE NOT deleted))"""


def places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Local and shared locations from region and nation: (place, location)."""
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    both = r.select(F.concat(F.lit("/"), F.col("r_name")).alias("place"), F.col("r_name").alias("location"), F.col("r_regionkey").alias("k"))
    nested = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", F.lit(""), "r_name", "n_name").alias("place"), F.col("n_name").alias("location"), F.col("n_nationkey").alias("k"))
    return both.where("k <> 1").union(nested.where("k % 3 <> 0")).select("place", "location"), nested.where("k % 3 = 0").select("place", "location")


def assets(spark: SparkSession, d: str) -> DataFrame:
    """Asset paths below region and nation: path, kind."""
    r, n, c = read(spark, d, "region"), read(spark, d, "nation"), read(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "input").when(F.col("c_custkey") % 3 == 1, "output").otherwise("reference")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", F.lit(""), "r_name", "n_name", "c_mktsegment", "c_name").alias("path"), kind.alias("kind"))


LOCAL = """(SELECT '/' || r_name AS place, r_name AS location FROM region WHERE r_regionkey <> 1 UNION ALL
    SELECT '/' || r_name || '/' || n_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0)"""
SHARED = "(SELECT '/' || r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0)"
ASSETS = """(SELECT '/' || r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path, CASE c_custkey % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'output' ELSE 'reference' END AS kind
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _mixed(spark: SparkSession, d: str, gone: int, changed: int) -> DataFrame:
    k = F.col("doc_id")
    kind = k % 8
    link, many, deleted = kind == 5, kind == 6, k % gone == 0
    content = F.when(k % changed == 0, F.md5(F.concat("hash", F.lit("y")))).otherwise(F.col("hash"))
    live = lambda c, when: F.when(~deleted & when, c)
    return files(spark, d).select(
        "path", live(content, ~link & ~many).alias("hash"), live(F.when(many, F.col("size") + 300_000_000).otherwise(F.col("size")), ~link).alias("size"),
        live(F.col("mtime") + F.when(k % 12 == 0, gone).otherwise(0), ~link & (k % 10 != 3)).alias("mtime"), (~deleted & ~link & F.col("runnable")).alias("runnable"),
        live(F.array(content, F.md5(content)), many).alias("chunkhashes"), live(F.concat(F.lit("to/"), F.substring(content, 1, 2)), link).alias("symlink_target"), deleted.alias("deleted"), "doc_id",
    )


def mixed_parent(spark: SparkSession, d: str) -> DataFrame:
    """A manifest with links, chunked files, deleted rows, and files without a time."""
    return _mixed(spark, d, 9, 1_000_003).where("doc_id % 7 <> 0")


def mixed_current(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, 11, 5).where("doc_id % 13 <> 0")


def _mixed_sql(gone: int, changed: int, where: str) -> str:
    return f"""(SELECT path, CASE WHEN NOT deleted AND kind NOT IN (5, 6) THEN c END AS hash, CASE WHEN NOT deleted AND kind <> 5 THEN CASE WHEN kind = 6 THEN size + 300000000 ELSE size END END AS size,
    CASE WHEN NOT deleted AND kind <> 5 AND doc_id % 10 <> 3 THEN mtime + CASE WHEN doc_id % 12 = 0 THEN {gone} ELSE 0 END END AS mtime, NOT deleted AND kind <> 5 AND runnable AS runnable,
    CASE WHEN NOT deleted AND kind = 6 THEN [c, md5(c)] END AS chunkhashes, CASE WHEN NOT deleted AND kind = 5 THEN 'to/' || substr(c, 1, 2) END AS symlink_target, deleted, doc_id
    FROM (SELECT *, doc_id % 8 AS kind, doc_id % {gone} = 0 AS deleted, CASE WHEN doc_id % {changed} = 0 THEN md5(hash || 'y') ELSE hash END AS c FROM {FILES}) WHERE {where})"""


MIXED_PARENT = _mixed_sql(9, 1_000_003, "doc_id % 7 <> 0")
MIXED_CURRENT = _mixed_sql(11, 5, "doc_id % 13 <> 0")
