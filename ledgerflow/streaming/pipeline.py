"""The ledger as a stream: each micro-batch is one poll cycle, its batch functions are the same as for tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerflow.config import DeadLetterConfig, RetryPolicy
from ledgerflow.operators.attempts import expand_attempts, terminal_outcomes
from ledgerflow.operators.dead_letters import envelope
from ledgerflow.operators.metrics import Meters
from ledgerflow.sources.records import records_from_events, stream_events
from ledgerflow.streaming.frontier import stream_positions

#: The ledger's completion log: offsets delivered and offsets finished.
COMPLETIONS = "topic string, partition int, offset bigint, kind string"


class Lifecycle(StreamingQueryListener):
    """new, running, then closed or failed; the fatal callback runs once, after the state is set."""

    def __init__(self, on_fatal: Callable[[str], None] | None = None, meters: Meters | None = None) -> None:
        self.state, self._on_fatal, self.progress, self.meters = "new", on_fatal, [], meters or Meters()

    def onQueryStarted(self, event) -> None:
        if self.state == "new":
            self.state = "running"

    def onQueryProgress(self, event) -> None:
        self.progress.append((event.progress.batchId, event.progress.numInputRows))
        self.meters.timer("poll.duration", event.progress.durationMs.get("triggerExecution", 0))
        self.meters.counter("records.polled", event.progress.numInputRows)
        self.meters.gauge("records.in_flight", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.state in ("closed", "failed"):
            return
        self.state = "failed" if event.exception else "closed"
        self.meters.close()
        if event.exception and self._on_fatal:
            self._on_fatal(event.exception)


def run_ledger(spark: SparkSession, source: str, target: str, policy: RetryPolicy, failures: F.Column, dead_letters: bool = True, files_per_trigger: int = 1, letters: DeadLetterConfig | None = None, finished: F.Column | None = None) -> None:
    """Replay all files of ``source``: attempts, acks, dead_letters and completions (the completion log) as tables below ``target``.

    ``finished`` (default: all) says which records with a terminal outcome count as completed.

    Each micro-batch goes to a folder of its own number, written over if the batch is run again, so a restart from the checkpoint
    repeats no row.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        attempts = expand_attempts(records_from_events(batch), policy, failures)
        kept = attempts.select("topic", "partition", "offset", "attempt", "failed", "decision", "delay_ms", "duration_ms", "error_class")
        kept.write.mode("overwrite").parquet(f"{target}/attempts/batch={number}")
        last = terminal_outcomes(attempts, dead_letters)
        ended = last.select("topic", "partition", "offset", "attempt", "outcome", "cause")
        ended.write.mode("overwrite").parquet(f"{target}/acks/batch={number}")
        if dead_letters:
            gone = last.where("cause = 'dlq'").withColumn("slowness", F.lit(0)).withColumn("error_message", F.lit(None).cast("string"))
            envelope(gone, letters or DeadLetterConfig(), F.lit(str(number))).write.mode("overwrite").parquet(f"{target}/dead_letters/batch={number}")
        place = F.col("topic"), F.col("partition"), F.col("offset")
        done = ended.where(finished) if finished is not None else ended
        log = records_from_events(batch).select(*place, F.lit("observe").alias("kind")).unionByName(done.select(*place, F.lit("done").alias("kind")))
        log.write.mode("overwrite").parquet(f"{target}/completions/batch={number}")

    query = stream_events(spark, source, files_per_trigger).writeStream.foreachBatch(cycle).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def run_positions(spark: SparkSession, target: str, files_per_trigger: int = 1000) -> None:
    """Commit positions of a ledger as the table ``positions`` below ``target``, kept in state from its completion log.

    A restart goes on from the state in the checkpoint; a position once written is never written again or lowered.
    """
    log = spark.readStream.schema(COMPLETIONS).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(f"{target}/completions")
    run_to_table(stream_positions(log), f"{target}/positions")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and summed value per window and type; in a stream, late rows within ``late`` still count."""
    timed = events.withColumn("time", F.to_timestamp_ltz(F.col("ts").cast("string"))) if dict(events.dtypes)["ts"] == "timestamp_ntz" else events.withColumn("time", F.col("ts"))
    if events.isStreaming:
        timed = timed.withWatermark("time", late)
    window = F.window("time", size, slide) if slide else F.window("time", size)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
