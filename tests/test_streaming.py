"""Streams give what the same query over the whole table gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.streaming import access

EVENTS = "/root/testdata/sf0.001/events.parquet"


def run(spark, make, folder):
    spark.read.parquet(EVENTS).select("event_id", "ts", "user_id", "event_type").repartition(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    name = f"t{uuid.uuid4().hex}"
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    return spark.table(name)


def test_first_seen(spark, tmp_path):
    found = run(spark, lambda s: access.first_seen(s, ["user_id", "event_type"], delay="60 days"), str(tmp_path))
    wanted = spark.read.parquet(EVENTS).select("user_id", "event_type").distinct()
    assert sorted(map(tuple, found.select("user_id", "event_type").collect())) == sorted(map(tuple, wanted.collect()))


def test_access_counts(spark, tmp_path):
    found = run(spark, lambda s: access.access_counts(s, ["event_type"]), str(tmp_path))
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    ended = F.col("start") + F.expr("INTERVAL 1 DAY") <= F.lit(events.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 HOUR")
    wanted = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n")).where(ended)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.select("start", "event_type", "n").collect()))


def test_outputs_are_merged_by_root(spark, tmp_path):
    from quillon.streaming import incremental

    folder, checkpoint, source = str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "in")
    schema = "root string, path string, last_modified long, manifest_id string, size long"
    batches = [[("r", "a", 1, "m1", 1), ("r", "b", 1, "m1", 1)], [("r", "a", 5, "m2", 2), ("s", "a", 1, "m2", 9)], [("r", "a", 3, "m3", 7), ("r", "c", 4, "m3", 3)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        assert incremental.merge_outputs(stream, folder, checkpoint).awaitTermination(90)
    wanted = incremental.latest_by(spark.createDataFrame(sum(batches, []), schema), ["root", "path"], ["last_modified", "manifest_id"])
    assert sorted(map(tuple, incremental.merged(spark, folder).select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    incremental.merge_into(folder, ["root", "path"], ["last_modified", "manifest_id"])(spark.createDataFrame(batches[2], schema), 2)  # a batch again
    assert incremental.merged(spark, folder).count() == 4


def test_net_changes_by_window(spark, tmp_path):
    from quillon.streaming import incremental

    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("modify")
    shaped = lambda s: s.select("ts", "event_id", F.col("user_id").cast("string").alias("path"), op.alias("op"))
    found = run(spark, lambda s: incremental.net_changes(shaped(s), width="1 day"), str(tmp_path))
    events = shaped(spark.read.parquet(EVENTS)).withColumn("ts", F.col("ts").cast("timestamp"))
    ended = F.col("start") + F.expr("INTERVAL 1 DAY") <= F.lit(events.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 HOUR")
    last = events.groupBy(F.window("ts", "1 day").start.alias("start"), "path").agg(F.max_by("op", F.struct("ts", "event_id")).alias("op")).where(ended)
    wanted = last.select("start", "path", F.when(F.col("op") == "delete", "deleted").otherwise("there").alias("state"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
