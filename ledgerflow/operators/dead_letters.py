"""Dead-letter envelopes and failed publishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.config import DeadLetterConfig
from ledgerflow.functions.decode import dead_letter_topic, truncate_utf8
from ledgerflow.functions.retry import effective_attempt, publish_backoff_ms

#: Names of the added headers, behind the prefix.
ADDED = ("original-topic", "original-partition", "original-offset", "failure-class", "failure-message", "attempt-count", "routed-at")


def envelope(exhausted: DataFrame, config: DeadLetterConfig, routed_at: Column, naming=None) -> DataFrame:
    """dead_letters rows with their coordinate: original key, value and headers, then the added headers as UTF-8 text.

    Needs attempt, delivery_count, slowness, error_class, error_message (null: the text ``null``) and, if configured, stack_trace.
    """
    count = effective_attempt(F.col("attempt"), F.col("delivery_count"), F.coalesce(F.col("slowness"), F.lit(0)))
    texts = [F.col("topic"), F.col("partition"), F.col("offset"), F.col("error_class"), F.coalesce(F.col("error_message"), F.lit("null")), count, routed_at]
    pairs = [F.struct(F.lit(config.prefix + n).alias("key"), v.cast("string").cast("binary").alias("value")) for n, v in zip(ADDED, texts, strict=True)]
    if config.stack_trace:
        pairs.append(F.struct(F.lit(f"{config.prefix}stack-trace").alias("key"), truncate_utf8(F.col("stack_trace"), config.stack_trace_bytes).cast("binary").alias("value")))
    target = naming(F.col("topic")) if naming else dead_letter_topic(F.col("topic"), config.suffix)
    return exhausted.select("topic", "partition", "offset", target.alias("dlq_topic"), "key", "value", F.concat(F.col("headers"), F.array(*pairs)).alias("headers"))


def publish_outcome(published: Column, share: bool) -> Column:
    """Share: a failed publish releases the original. Classic: it stays incomplete and its partition is held."""
    return F.when(published, "accept").otherwise("release" if share else "held")


def publish_retries(failed: DataFrame, tries: Column) -> DataFrame:
    """One row per failed try with its wait and the time since the first failure."""
    rows = failed.withColumn("try", F.explode(F.sequence(F.lit(0), tries.cast("int") - 1))).withColumn("wait_ms", publish_backoff_ms(F.col("try")))
    #: Closed form of the sum of 1, 2, 4, 8, 16 s and then 30 s each.
    before = F.when(F.col("try") <= 5, (F.pow(F.lit(2.0), F.col("try")) - 1).cast("bigint") * 1000).otherwise(F.lit(31_000) + (F.col("try") - 5) * 30_000)
    return rows.withColumn("held_ms", before.cast("bigint") + F.col("wait_ms"))
