"""Mixing sources to target weights: tokens a source, repetition rates, then whole copies and one hash-seeded Bernoulli copy.

One aggregation gives each source's size; only three sums a round reach the driver while targets are filled up to their
caps. A document is then emitted floor(rate) times, and once more if a hash of its id, as a number in [0, 1), lies under the
rate's fraction: reruns and retried tasks agree, and no row depends on another. A source that holds most rows is no
bottleneck: sizes are summed before the shuffle and the documents themselves are not shuffled.

Cases: null sources are one source of their own, ranked last; a null text has size 0; sources of size 0 have target and rate 0;
repeated rows share their id's draw, each being emitted as often as the other; null ids share one draw; an empty table
gives an empty result. Columns besides the ones named stay and may have any names not starting with _mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.common import join_groups, materialise, table, words

#: Source tables of at most so many rows and bytes of names are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 100_000, 8_000_000


def source_key(source: Column) -> Column:
    """A non-null key in the order of code points, null last."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def ranked(groups: DataFrame, key: str) -> DataFrame:
    """Adds _mix_rank, the place from 0 of each row by its unique key: counts of sorted ranges are summed, no range is read alone."""
    ranges = materialise(groups.repartitionByRange(F.col(key)).withColumn("_mix_part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in ranges.groupBy("_mix_part").count().orderBy("_mix_part").collect():  # a row for each range
        offsets.append((r["_mix_part"], before))
        before += r["count"]
    at = F.row_number().over(Window.partitionBy("_mix_part").orderBy(key))
    spark = groups.sparkSession
    offset = spark.createDataFrame(offsets, "_mix_part int, _mix_before long")
    return ranges.withColumn("_mix_at", at).join(F.broadcast(offset), "_mix_part").withColumn("_mix_rank", F.col("_mix_before") + F.col("_mix_at") - 1).drop("_mix_part", "_mix_at", "_mix_before")


def targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], cap: int) -> DataFrame:
    """Of (_mix_src, _mix_source_size, _mix_rows): adds _mix_target. share is a ratio of the whole; a target stops at cap times its source's size."""
    by_rank = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_mix_rank") % len(weights) + 1).cast("int"))
    sources = materialise(ranked(sizes, "_mix_src").withColumn("_mix_weight", by_rank.cast("long")).drop("_mix_rank"), "sources")
    big = lambda c: c.cast(T.DecimalType(38, 0))
    whole = sources.agg(F.sum("_mix_source_size"), F.sum("_mix_weight")).first()
    total, weight, capped = int(whole[0] or 0), int(whole[1] or 0), 0
    num, den = share
    while True:
        # above its cap: (share * total - capped) * w / weight > cap * size, in whole numbers
        above = big(F.lit(num * total - den * capped)) * F.col("_mix_weight") > big(F.col("_mix_source_size")) * F.lit(cap * den * weight)
        row = sources.agg(F.sum(F.when(above, F.col("_mix_source_size") * cap)), F.sum(F.when(~above, F.col("_mix_weight")))).first()
        now = (int(row[0] or 0), int(row[1] or 0))
        if now == (capped, weight) or not now[1]:
            break
        capped, weight = now
    open_target = (F.lit(num / den * total) - F.lit(float(capped))) * F.col("_mix_weight").cast("double") / F.lit(float(max(weight, 1)))
    return sources.withColumn("_mix_target", F.when(above, (F.col("_mix_source_size") * cap).cast("double")).otherwise(open_target))


def plan(
    docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2), cap: int = 2, seed: int = 17, keep_text: bool = True,
) -> DataFrame:
    """Each document with size, source_size, target, rate and copies (how often the mix emits it) as a struct column `_mix`.

    With keep_text, the whole rows come back (the text is then read twice and never shuffled); else the text is left out.
    """
    rows = docs.withColumns({"_mix_src": source_key(F.col(source)), "_mix_size": F.size(words(F.col(text))).cast("long")})
    if not keep_text:
        rows = materialise(rows.drop(text), "sizes")
    sizes = rows.groupBy("_mix_src").agg(F.sum("_mix_size").alias("_mix_source_size"), F.count("*").alias("_mix_rows"))
    goals = materialise(targets(sizes, weights, share, cap), "targets")
    n, length, total = goals.agg(F.count("*"), F.sum(F.octet_length("_mix_src")), F.sum("_mix_rows")).first()
    if n <= BROADCAST_SOURCES and (length or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(goals), "_mix_src")
    else:
        joined = join_groups(rows, goals, ["_mix_src"], "_mix_rows", total, F.col(doc_id))
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + (draw(F.col(doc_id), seed) < rate - whole).cast("long")).cast("long")
    made = F.struct(F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), rate.alias("rate"), copies.alias("copies"))
    return joined.withColumn("_mix", made).select(*[c for c in docs.columns if keep_text or c != text], "_mix")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document's row as often as the plan says, with the columns of docs."""
    planned = plan(docs, **options)
    return planned.where("_mix.copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix.copies").cast("int")))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = F.col("_mix")
    return plan(docs, keep_text=False).select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"))


ORACLE_SQL = {
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS capped, sum(weight) OVER after AS open, (SELECT sum(source_size) FROM s) AS total
      FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    after AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT capped::DOUBLE AS capped, open::DOUBLE AS open, total::DOUBLE AS total, source_size * 2.0 / weight AS lam
          FROM o WHERE (1.5::DOUBLE * total - capped) * weight / open <= 2 * source_size ORDER BY lam LIMIT 1),
t AS (SELECT w.source, source_size, CASE WHEN source_size * 2.0 / weight < level.lam THEN 2.0::DOUBLE * source_size
             ELSE (1.5::DOUBLE * total - capped) * weight::DOUBLE / open END AS target FROM w, level)
SELECT doc_id, size, source_size, target,
       (size * CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)
        + (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 < target / source_size - floor(target / source_size))::INT END)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
}
