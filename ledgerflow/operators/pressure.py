"""In-flight counts, pause and resume with hysteresis, pause holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.running import previous, running_last, running_max, running_sum

#: Milliseconds of a block of the in-flight sum, about 17 minutes.
TIME_BLOCK = 1 << 20


def in_flight(spans: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """(keys, t_ms, n): records in flight after all changes at t_ms; ends count before starts.

    Changes are summed per time stamp first, so the running sum sees one row for each; its blocks are spans of time.
    A span without an end stays open; one without a start never was.
    """
    spans = spans.where(F.col(start).isNotNull())
    ups = spans.select(*keys, F.col(start).alias("t_ms"), F.lit(1).alias("d"))
    downs = spans.where(F.col(end).isNotNull()).select(*keys, F.col(end).alias("t_ms"), F.lit(-1).alias("d"))
    step = ups.unionByName(downs).groupBy(*keys, "t_ms").agg(F.sum("d").alias("d"))
    return running_sum(step, keys, "t_ms", "d", TIME_BLOCK).withColumnRenamed("running", "n").drop("d")


def peak(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    return in_flight(spans, keys).groupBy(*keys).agg(F.max("n").alias("peak"))


def hysteresis(samples: DataFrame, keys: Sequence[str], limit: int, order: str = "tick") -> DataFrame:
    """Adds paused and event (paused, resumed or null) for samples ``n`` in poll order (integers): pause at limit, resume at half of it."""
    signal = F.when(F.col("n") >= limit, True).when(F.col("n") <= limit // 2, False)
    rows = running_last(samples.withColumn("_signal", signal), keys, order, "_signal").drop("_signal")
    rows = rows.withColumn("paused", F.coalesce("running", F.lit(False))).withColumn("_was", F.coalesce("before", F.lit(False))).drop("running", "before")
    return rows.withColumn("event", F.when(F.col("paused") & ~F.col("_was"), "paused").when(~F.col("paused") & F.col("_was"), "resumed")).drop("_was")


def pause_spans(holds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans in which at least one hold is open, from holds (start_ms, end_ms); touching spans are one.

    Holds are folded per start first, so starts differ. A span begins where no earlier hold reaches; the last such start names it.
    """
    held = holds.groupBy(*keys, "start_ms").agg(F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))
    reach = running_max(held, keys, "start_ms", "end_ms", TIME_BLOCK).withColumnRenamed("running", "_reach")
    marked = previous(reach, keys, ["start_ms"], "_reach", TIME_BLOCK).withColumn("_new", F.when(F.col("before").isNull() | (F.col("start_ms") > F.col("before")), F.col("start_ms")))
    named = running_max(marked.drop("before", "_reach"), keys, "start_ms", "_new", TIME_BLOCK)
    return named.groupBy(*keys, F.col("running").alias("span")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n").alias("holds")).drop("span")


def paused_by_both(samples: DataFrame, spans: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``held`` and ``stopped``: a partition polls only if neither backpressure pauses it nor a failed publish of this epoch holds it.

    ``spans`` (keys, start_ms, end_ms) are those of pause_spans by partition and epoch; a resume by backpressure never lifts a hold.
    A sample is held if the last span that begins by then is still open, so samples and spans are merged in order, not joined by range.
    """
    ticks = samples.withColumn("_end", F.lit(None).cast("bigint")).withColumn("_at", 2 * F.col(order) + 1)
    starts = spans.select(*keys, F.col("end_ms").alias("_end"), (2 * F.col("start_ms")).alias("_at"))
    both = running_last(ticks.unionByName(starts, allowMissingColumns=True), keys, "_at", "_end", 2 * TIME_BLOCK).where(F.col(order).isNotNull())
    held = both.withColumn("held", F.coalesce(F.col(order) < F.col("running"), F.lit(False))).drop("_end", "_at", "running", "before")
    return held.withColumn("stopped", F.col("held") | F.col("paused"))
