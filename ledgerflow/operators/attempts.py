"""Attempts: a record's invocations under a retry policy, as rows instead of sleeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.config import RetryPolicy
from ledgerflow.functions import retry


def expand_attempts(records: DataFrame, policy: RetryPolicy, failures: Column, error_class: Column | None = None) -> DataFrame:
    """One row per invocation: attempt, failed, error_class, decision (null on success), delay_ms before the next one.

    ``failures`` is how many of a record's invocations fail (null: all). A rejected or exhausted record has no further one.
    A record has at most max_attempts + 1 rows, so the expansion is narrow and bounded.
    """
    error = F.coalesce(error_class, F.lit("java.lang.IllegalStateException")) if error_class is not None else F.lit("java.lang.IllegalStateException")
    rows = records.withColumn("_fails", F.coalesce(failures.cast("bigint"), F.lit(policy.max_attempts + 1)))
    rows = rows.withColumn("_error", error).withColumn("_retriable", retry.is_retriable(policy, F.col("_error")))
    last = F.when(~F.col("_retriable"), F.lit(0)).otherwise(F.least(F.col("_fails"), F.lit(policy.max_attempts)).cast("int"))
    rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("failed", F.col("attempt") < F.col("_fails"))
    decided = retry.decision(policy, F.col("attempt"), F.col("_retriable"))
    rows = rows.withColumn("decision", F.when(F.col("failed"), decided))
    rows = rows.withColumn("delay_ms", F.when(F.col("decision").isin("inline", "delayed"), retry.backoff_ms(policy, F.col("attempt"))).otherwise(F.lit(0).cast("bigint")))
    return rows.withColumn("error_class", F.when(F.col("failed"), F.col("_error"))).drop("_fails", "_error", "_retriable")


def terminal_outcomes(attempts: DataFrame, dead_letters: bool) -> DataFrame:
    """The last invocation of each record with outcome and cause; an exhausted one that was routed counts as accepted."""
    done = attempts.where("decision is null or decision in ('reject', 'exhausted')")
    outcome = F.when(F.col("decision").isNull(), "accept").when(F.col("decision") == "reject", "reject").otherwise("accept" if dead_letters else "reject")
    cause = F.when(F.col("decision").isNull(), "handler").when(F.col("decision") == "reject", "retry").otherwise("dlq" if dead_letters else "retry")
    return done.withColumn("outcome", outcome).withColumn("cause", cause)


def next_deliveries(attempts: DataFrame) -> DataFrame:
    """The share engine's answer to a delayed retry: the record is released at once and comes back with a higher delivery count.

    The delay isn't waited for and the attempt starts at 0 again; the broker's count is what remembers.
    """
    back = attempts.where("decision = 'delayed'")
    return back.withColumn("delivery_count", F.coalesce("delivery_count", F.lit(1)) + 1).withColumn("attempt", F.lit(0)).withColumn("outcome", F.lit("release"))


def with_timeout(attempts: DataFrame, limit_ms: int) -> DataFrame:
    """``timed_out`` counts only if the handler threw; the timeout then replaces its error."""
    late = (F.col("duration_ms") > limit_ms) & F.col("failed")
    return attempts.withColumn("timed_out", late).withColumn("error_class", F.when(late, "HandlerTimeout").otherwise(F.col("error_class")))


def blocked_ms(attempts: DataFrame) -> DataFrame:
    """Time each record keeps its lane: handler time of every invocation and the waits between them."""
    return attempts.groupBy("topic", "partition", "offset").agg(F.sum(F.col("duration_ms") + F.col("delay_ms")).alias("blocked_ms"))
