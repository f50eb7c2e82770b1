"""Acknowledgements: first wins, automatic release, precedence over failures, duplicates in flight, slowness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COORD = ["topic", "partition", "offset"]
#: Commit errors that end a drain; any other is contained to its record.
FATAL = ("AuthenticationException", "AuthorizationException", "InterruptException")


def first_wins(acks: DataFrame) -> DataFrame:
    """The first terminal acknowledgement of each coordinate, and how many later ones were dropped."""
    return acks.groupBy(*COORD).agg(F.min_by(F.struct("outcome", "cause"), "seq").alias("a"), (F.count("*") - 1).alias("dropped")).select(*COORD, "a.outcome", "a.cause", "dropped")


def auto_release(records: DataFrame, acks: DataFrame) -> DataFrame:
    """A handler that returns without an acknowledgement releases its record."""
    return records.select(*COORD).join(first_wins(acks).select(*COORD, "outcome"), COORD, "left").withColumn("outcome", F.coalesce("outcome", F.lit("release")))


def current_delivery_only(acks: DataFrame) -> DataFrame:
    """Drop acknowledgements of an older delivery than the newest that exists when they arrive; both carry delivery_seq."""
    newest = acks.groupBy(*COORD).agg(F.max("delivery_seq").alias("newest"))
    return acks.join(newest, COORD).where("delivery_seq = newest").drop("newest")


def not_yet_acked(attempts: DataFrame, acks: DataFrame) -> DataFrame:
    """Attempts that still run: no terminal acknowledgement came before them."""
    first = acks.groupBy(*COORD).agg(F.min("at_ms").alias("acked_ms"))
    return attempts.join(first, COORD, "left").where("acked_ms is null or started_ms <= acked_ms").drop("acked_ms")


def mark_duplicates(deliveries: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``duplicate``: the coordinate was still in flight. A duplicate isn't processed and so keeps nothing in flight.

    Whether one counts depends on those accepted before it, so a coordinate's deliveries are folded in order: sorted (with
    spilling) and passed through as Arrow batches with one end time carried along. Nothing is gathered, whatever the length.
    """
    rows = deliveries.withColumn("_hash", F.xxhash64(*keys))
    dealt = rows.select(*keys, "_hash", "started_ms", "delivery_seq", "duration_ms").repartition("_hash").sortWithinPartitions("_hash", *keys, "started_ms", "delivery_seq")
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, end = None, None
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            started, lasts = batch.column("started_ms").to_pylist(), batch.column("duration_ms").to_pylist()
            out = np.zeros(batch.num_rows, bool)
            for i, (name, s, d) in enumerate(zip(names, started, lasts, strict=True)):
                if name != lane:
                    lane, end = name, None
                if end is not None and s < end:
                    out[i] = True
                else:
                    end = s + d
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("started_ms"), batch.column("delivery_seq"), pa.array(out)], names=[*keys, "started_ms", "delivery_seq", "duplicate"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "started_ms", "delivery_seq"))
    return dealt.mapInArrow(run, f"{schema}, duplicate boolean")


def commit_acks(queued: DataFrame, keys: Sequence[str] = ("drain",)) -> DataFrame:
    """Adds ``state`` to acknowledgements (keys, seq, error_class of their commit or null) drained in order of seq.

    applied without an error, contained with one that concerns its record alone, fatal with one of FATAL (by simple name);
    those behind a drain's first fatal error are unsent.
    """
    fatal = F.coalesce(F.element_at(F.split("error_class", r"\."), -1).isin(*FATAL), F.lit(False))
    first = queued.groupBy(*keys).agg(F.min(F.when(fatal, F.col("seq"))).alias("_stop"))
    state = F.when(F.col("seq") > F.col("_stop"), "unsent").when(fatal, "fatal").when(F.col("error_class").isNotNull(), "contained").otherwise("applied")
    return queued.join(first, list(keys)).withColumn("state", state).drop("_stop")


def commit_results(acks: DataFrame, commits: DataFrame) -> DataFrame:
    """Acknowledgements with ``ok``: whether the commit that carried them (topic, partition, commit, ok) succeeded; null while none has reported."""
    return acks.join(commits.select("topic", "partition", "commit", "ok"), ["topic", "partition", "commit"], "left")


def slowness(acks: DataFrame) -> DataFrame:
    """Forced releases per coordinate since its last accept or reject that was committed.

    Rows may carry ``ok`` (see commit_results): a failed or unreported commit clears nothing. Without it all count as committed.
    """
    kept = F.col("outcome").isin("accept", "reject")
    if "ok" in acks.columns:
        kept = kept & F.coalesce(F.col("ok"), F.lit(False))
    cleared = acks.groupBy(*COORD).agg(F.max(F.when(kept, F.col("seq"))).alias("cleared"))
    return acks.join(cleared, COORD).groupBy(*COORD).agg(F.count_if((F.col("cause") == "slowness") & (F.col("seq") > F.coalesce("cleared", F.lit(-1)))).alias("slowness"))
