"""Dispatch: how records are laid out and when they run under each ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.config import Ordering
from ledgerflow.functions.keys import shard_index
from ledgerflow.operators.running import running_sum


def with_shard(records: DataFrame, shards: int) -> DataFrame:
    return records.withColumn("shard", shard_index(F.col("key"), shards))


def layout(records: DataFrame, ordering: Ordering, shards: int = 64, partitions: int | None = None) -> DataFrame:
    """Rows of a lane in one task in offset order; unordered records stay where they are."""
    if ordering == Ordering.UNORDERED:
        return records
    keys = ["topic", "partition"] + (["shard"] if ordering == Ordering.KEY else [])
    rows = with_shard(records, shards) if ordering == Ordering.KEY else records
    dealt = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "offset")


def schedule(records: DataFrame, ordering: Ordering, shards: int = 64) -> DataFrame:
    """Adds start_ms and end_ms: a lane runs its records one after the other, lanes run at once."""
    if ordering == Ordering.UNORDERED:
        return records.withColumn("start_ms", F.lit(0).cast("bigint")).withColumn("end_ms", F.col("duration_ms"))
    rows = with_shard(records, shards) if ordering == Ordering.KEY else records
    keys = ["topic", "partition"] + (["shard"] if ordering == Ordering.KEY else [])
    return running_sum(rows, keys, "offset", "duration_ms").withColumnRenamed("running", "end_ms").withColumn("start_ms", F.col("end_ms") - F.col("duration_ms"))


def shard_count(shards: Column, concurrency: Column) -> Column:
    """Key lanes: as set, else four for each worker."""
    return F.coalesce(shards, concurrency * 4)


def completions(records: DataFrame, ownership: DataFrame, throws: Column) -> DataFrame:
    """Adds ``completes`` for classic unordered delivery: a record that isn't owned any more, or whose handler throws, never completes."""
    newest = ownership.groupBy("topic", "partition").agg(F.max("epoch").alias("_epoch"))
    rows = records.join(newest, ["topic", "partition"], "left")
    return rows.withColumn("completes", F.coalesce(F.col("epoch") == F.col("_epoch"), F.lit(False)) & ~F.coalesce(throws, F.lit(False))).drop("_epoch")


def makespans(records: DataFrame, concurrency: int = 16, shards: int = 64) -> DataFrame:
    """(mode, makespan_ms) by sums and maxima alone: serial, share batches, key lanes, partition lanes."""
    total = records.agg(F.sum("duration_ms").alias("makespan_ms")).select(F.lit("serial").alias("mode"), "makespan_ms")
    batch = records.groupBy("topic", F.expr(f"offset div {concurrency}").alias("batch")).agg(F.max("duration_ms").alias("d")).agg(F.sum("d").alias("makespan_ms")).select(F.lit("share").alias("mode"), "makespan_ms")
    lanes = lambda df, name, *keys: df.groupBy(*keys).agg(F.sum("duration_ms").alias("d")).agg(F.max("d").alias("makespan_ms")).select(F.lit(name).alias("mode"), "makespan_ms")
    return total.unionByName(batch).unionByName(lanes(with_shard(records, shards), "key", "topic", "partition", "shard")).unionByName(lanes(records, "partition", "topic", "partition"))


def purge_on_revoke(scheduled: DataFrame, ownership: DataFrame) -> DataFrame:
    """Adds ``purged``: a record whose lane hadn't started it when its partition was revoked."""
    cut = ownership.where("revoked_ms is not null").groupBy("topic", "partition").agg(F.min("revoked_ms").alias("cut_ms"))
    return scheduled.join(cut, ["topic", "partition"], "left").withColumn("purged", F.coalesce(F.col("start_ms") >= F.col("cut_ms"), F.lit(False))).drop("cut_ms")
