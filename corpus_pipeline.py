"""A training corpus from raw documents: quality rules, near-duplicates, repeated passages, mixing to weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between stages the
documents are written as Parquet and read again, so that a stage is computed once and a lost executor costs one stage at most; a stage's own
intermediate tables are then deleted.

Cases, for every stage: an empty table gives an empty one; columns besides those of documents stay, whatever their names (mixing: but for those that
begin with _mix); each stage states its own cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import mixing, near_dedup, packing, quality, suffix_dedup
from quillon.llm.common import intermediates, new_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go from the texts; documents that fail as a whole or lose too much text go.

    Null and empty texts fail; long texts are judged whole; repeated rows are judged alike; null ids do not matter.
    """
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words a shingle, similarity 0.8 or more.

    The smallest id of a group stays, once if its row is repeated; texts without words, and rows without an id, all stay; long texts count whole.
    """
    return near_dedup.deduplicate(docs, k=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 100 bytes stays only where it starts first.

    All rows stay, with what is left of their text; a null text stays null; rows without an id are documents of their own after all ids;
    repeated rows are one document, cut alike; a text may be left empty.
    """
    return suffix_dedup.deduplicate(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out towards their source's target.

    A null source is one of its own, ranked last; a source without words is left out; repeated rows share their id's draw, as do null ids.
    """
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence of 2048 tokens.

    Null and empty texts are one piece of the end mark alone; long texts are cut into pieces; each repeated row is packed.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("packed_sequences", packed_sequences),
]

#: Minima of hashes and byte-pair merges are no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with intermediates(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
