"""Commit positions under out-of-order completion, by plain aggregates.

The position is one behind the last offset of the longest completed prefix of *delivered* offsets, so gaps in the
offsets never stall it. The prefix ends before the smallest incomplete offset; that is a minimum with a
partial aggregate, so a partition of any size is never sorted or collected in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.operators.running import running_max

TP = ("topic", "partition")


def commit_positions(deliveries: DataFrame, keys: Sequence[str] = TP) -> DataFrame:
    """(keys, position, parked) from rows (keys, offset, done): parked completions lie behind the first hole."""
    hole = deliveries.groupBy(*keys).agg(F.min(F.when(~F.col("done"), F.col("offset"))).alias("hole"), F.min("offset").alias("floor"))
    joined = deliveries.join(hole, list(keys))
    before = F.col("hole").isNull() | (F.col("offset") < F.col("hole"))
    return joined.groupBy(*keys).agg(F.coalesce(F.max(F.when(before, F.col("offset"))) + 1, F.min("floor")).alias("position"), F.count_if(F.col("done") & ~before).alias("parked"))


def position_history(deliveries: DataFrame, drains: DataFrame, keys: Sequence[str] = TP) -> DataFrame:
    """The position at each drain (keys, drain_seq) given done_seq per delivery (null: never), and whether it moved.

    An offset is a hole at drain d while its done_seq is null or above d. In offset order the running maximum of
    done_seq says from which drain on a whole prefix is complete; each delivery then bids its offset from that drain on.
    """
    never = F.lit((1 << 62)).cast("bigint")
    ready = running_max(deliveries.withColumn("done_seq", F.coalesce(F.col("done_seq"), never)), keys, "offset", "done_seq").withColumnRenamed("running", "ready")
    bids = ready.groupBy(*keys, "ready").agg((F.max("offset") + 1).alias("bid"))
    floor = deliveries.groupBy(*keys).agg(F.min("offset").alias("floor"))
    events = bids.select(*keys, F.col("ready").alias("drain_seq"), "bid", F.lit(False).alias("drain")).unionByName(drains.select(*keys, "drain_seq", F.lit(None).cast("bigint").alias("bid"), F.lit(True).alias("drain")))
    upto = Window.partitionBy(*keys).orderBy("drain_seq", "drain").rowsBetween(Window.unboundedPreceding, 0)
    at = events.withColumn("bid", F.max("bid").over(upto)).where("drain").join(floor, list(keys)).withColumn("position", F.coalesce("bid", "floor"))
    by_drain = Window.partitionBy(*keys).orderBy("drain_seq")
    return at.withColumn("moved", ~F.col("position").eqNullSafe(F.lag("position").over(by_drain))).select(*keys, "drain_seq", "position", "moved")


def high_water(commits: DataFrame) -> DataFrame:
    """(topic, partition, committed, buffered) from commit events (seq, position, ok).

    Committed is the largest success; a failed candidate stays buffered while it is above that.
    """
    both = commits.groupBy(*TP).agg(F.max(F.when(F.col("ok"), F.col("position"))).alias("committed"), F.max(F.when(~F.col("ok"), F.col("position"))).alias("failed"))
    return both.select(*TP, "committed", F.when(F.col("failed") > F.coalesce("committed", F.lit(-1)), F.col("failed")).alias("buffered"))


def high_water_history(commits: DataFrame) -> DataFrame:
    """(topic, partition, seq, committed, buffered) after each commit event (seq, position, ok) of a partition."""
    rows = commits.withColumns({"_ok": F.when(F.col("ok"), F.col("position")), "_bad": F.when(~F.col("ok"), F.col("position"))})
    good = running_max(rows, TP, "seq", "_ok").withColumnRenamed("running", "committed")
    both = running_max(good, TP, "seq", "_bad").withColumnRenamed("running", "failed")
    return both.select(*TP, "seq", "committed", F.when(F.col("failed") > F.coalesce("committed", F.lit(-1)), F.col("failed")).alias("buffered"))


def drop_stale(candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """Candidate positions above the committed one."""
    return candidates.join(marks.select(*TP, "committed"), list(TP), "left").where("committed is null or position > committed").drop("committed")


def still_owned(rows: DataFrame, ownership: DataFrame) -> DataFrame:
    """Rows whose epoch is the newest of their partition."""
    newest = ownership.groupBy(*TP).agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, [*TP, "epoch"], "left_semi")


def in_epochs(completions: DataFrame, ownership: DataFrame) -> DataFrame:
    """Completions inside their epoch's interval; a stale one, finished after its partition went, is dropped."""
    return completions.join(ownership.select(*TP, "epoch", "revoked_ms", "how"), [*TP, "epoch"]).where("revoked_ms is null or done_ms < revoked_ms")


def epoch_positions(deliveries: DataFrame, ownership: DataFrame) -> DataFrame:
    """Final position of every epoch (offset intervals first_offset to last_offset); a lost epoch never commits."""
    held = ownership.where("how is null or how <> 'lost'")
    rows = deliveries.join(held, list(TP)).where("offset between first_offset and last_offset")
    return commit_positions(rows, (*TP, "epoch"))
