"""Sharding by a permutation-filled lookup table.

Each shard's name gives it an order of preference over the slots of a table of prime size; shards take turns claiming their
next free slot until none is left. A row's key hashes to a slot and so finds its shard in constant time by a broadcast of the
table, whose size is the parameter `slots` alone. Shards' shares of the slots differ by one slot at most, and a shard that
comes or goes moves little besides its own share. Rows are placed where they are read: nothing is shuffled.

Cases: null keys share one slot; repeated rows and equal keys go together; a key is hashed whole, whatever its length; an
empty table gives an empty result. Columns besides the key stay untouched; `slot` and `shard` are added (other names can be given).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

#: Production parameters of op1: shards and slots. The slots are prime and over a hundred for each shard.
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the index of its shard."""
    if not is_prime(slots) or not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("slots must be prime, and shards distinct and no more than the slots")
    number = lambda name, salt: int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")
    at = [number(s, "offset") % slots for s in shards]
    step = [number(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def place(df: DataFrame, key: Column, shards: Sequence[str] = SHARDS, slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """Adds the slot (long) and the shard's name of each row's key."""
    owners = [(i, shards[o]) for i, o in enumerate(lookup_table(shards, slots))]
    owned = df.sparkSession.createDataFrame(owners, f"`{slot_name}` long, `{shard_name}` string")
    return df.withColumn(slot_name, F.pmod(F.xxhash64(key), F.lit(slots)).cast("long")).join(F.broadcast(owned), slot_name, "left")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1, shard_name: str = "shard", slot_name: str = "slot") -> None:
    """One folder a shard. Slots are dealt over a shard's files, so that a large shard is no single task."""
    dealt = placed.withColumn("_file", F.col(slot_name) % files_per_shard)
    dealt.repartition(F.col(shard_name), F.col("_file")).drop("_file").write.partitionBy(shard_name).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return place(docs, F.col("doc_id")).select("doc_id", "n_bytes", "slot", "shard")
