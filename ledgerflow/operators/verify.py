"""Checks: ordering, conservation, budgets, concurrency, affinity, skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.running import previous


def order_violations(rows: DataFrame, keys: Sequence[str], seq: str, observed: str) -> DataFrame:
    """(keys, n, violations): a sequence number below the one observed before it."""
    lines = previous(rows, keys, [observed, seq], seq)
    return lines.withColumn("bad", F.coalesce(F.col(seq) < F.col("before"), F.lit(False))).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("bad").alias("violations"))


def over_limit(in_flight: DataFrame, limit: int) -> DataFrame:
    """Moments at which more records were in flight than there are permits."""
    return in_flight.where(F.col("n") > limit)


def conservation(produced: DataFrame, processed: DataFrame, dead: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct produced, processed, dead, missing, unknown and both processed and dead."""
    tag = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(1))
    all_ = tag(produced, "a").join(tag(processed, "b"), list(keys), "full").join(tag(dead, "c"), list(keys), "full")
    a, b, c = F.col("a").isNotNull(), F.col("b").isNotNull(), F.col("c").isNotNull()
    return all_.agg(F.count_if(a).alias("produced"), F.count_if(b).alias("processed"), F.count_if(c).alias("dead"), F.count_if(a & ~b & ~c).alias("missing"), F.count_if(~a).alias("unknown"), F.count_if(b & c).alias("both"))


def attempt_budget(attempts: DataFrame, dead: DataFrame, max_attempts: int, keys: Sequence[str]) -> DataFrame:
    """Dead letters with fewer tries than the budget allows."""
    tries = attempts.groupBy(*keys).agg(F.count("*").alias("tries"))
    return dead.select(*keys).join(tries, list(keys), "left").where(F.coalesce("tries", F.lit(0)) < max_attempts + 1)


def key_affinity(records: DataFrame) -> DataFrame:
    """Keys on more than one partition."""
    return records.groupBy("topic", "key").agg(F.count_distinct("partition").alias("partitions")).where("partitions > 1")


def commits_past_unfinished(positions: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Positions above an incomplete offset."""
    hole = deliveries.where(~F.col("done")).groupBy("topic", "partition").agg(F.min("offset").alias("hole"))
    return positions.join(hole, ["topic", "partition"]).where("position > hole")


def shard_skew(sharded: DataFrame) -> DataFrame:
    return sharded.groupBy("topic", "partition", "shard").agg(F.count_distinct("key").alias("keys"), F.count("*").alias("records"))


def collisions(sharded: DataFrame) -> DataFrame:
    """One row: keys, and those that share a shard of their partition with another key."""
    per = sharded.where("key is not null").select("topic", "partition", "shard", "key").distinct().groupBy("topic", "partition", "shard").agg(F.count("*").alias("k"))
    return per.agg(F.sum("k").alias("keys"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("sharing"), F.count("*").alias("shards"), F.max("k").alias("most"))


def redeliveries(invocations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: invocations, distinct coordinates and their difference."""
    per = invocations.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("invocations"), F.count("*").alias("distinct_records"), (F.sum("n") - F.count("*")).alias("duplicates"))
