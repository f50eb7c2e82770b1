"""The metric surface as aggregates over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METER = "ledger.consumer."


class Meters:
    """Where live meters go. Every method does nothing here; a sink overrides what it takes."""

    def counter(self, name: str, value: float, **tags: str) -> None: ...

    def gauge(self, name: str, value: float, **tags: str) -> None: ...

    def timer(self, name: str, ms: float, **tags: str) -> None: ...

    def close(self) -> None:
        """The query has ended: gauges go, counters and timers stay."""


class RecordingMeters(Meters):
    """A sink in memory: one meter per name and tags. Shared by several queries, it closes when the last of them has."""

    def __init__(self, users: int = 1) -> None:
        self.counters: dict[tuple, float] = {}
        self.gauges: dict[tuple, float] = {}
        self.timers: dict[tuple, list[float]] = {}
        self._users = users

    @staticmethod
    def _key(name: str, tags: dict[str, str]) -> tuple:
        return (METER + name, *sorted(tags.items()))

    def counter(self, name: str, value: float, **tags: str) -> None:
        key = self._key(name, tags)
        self.counters[key] = self.counters.get(key, 0) + value

    def gauge(self, name: str, value: float, **tags: str) -> None:
        self.gauges[self._key(name, tags)] = value

    def timer(self, name: str, ms: float, **tags: str) -> None:
        self.timers.setdefault(self._key(name, tags), []).append(ms)

    def close(self) -> None:
        self._users -= 1
        if self._users <= 0:
            self.gauges.clear()


def counter(rows: DataFrame, name: str, **tags) -> DataFrame:
    """(name, kind, tags, value): rows per tag set, tags as k=v joined by commas in the order given."""
    text = F.concat_ws(",", *(F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in tags.items()))
    return rows.groupBy(text.alias("tags")).agg(F.count("*").cast("bigint").alias("value")).select(F.lit(METER + name).alias("name"), F.lit("counter").alias("kind"), "tags", "value")


def ledger_counters(records: DataFrame, attempts: DataFrame, terminal: DataFrame, poison: DataFrame) -> DataFrame:
    """The counters that a ledger of records, attempts and terminal outcomes determines."""
    topic = F.col("topic")
    routed = terminal.where("cause = 'dlq'")
    parts = [
        counter(records, "records.polled", topic=topic),
        counter(terminal, "records.processed", topic=topic, result=F.lower("outcome")),
        counter(attempts.where("failed"), "records.failed", topic=topic, exception_class=F.col("error_class")),
        counter(poison, "records.poison_pill", topic=topic, cause=F.col("cause")),
        counter(attempts.where("decision in ('inline', 'delayed')"), "retry.attempts", topic=topic, attempt=F.col("attempt") + 1),
        counter(routed, "dlt.routed", topic=topic, dlt_topic=F.concat(topic, F.lit(".DLT"))),
        counter(terminal, "ack.queued", type=F.lower("outcome")),
        counter(terminal, "ack.committed", topic=topic, type=F.lower("outcome")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failure_counters(publishes: DataFrame, commits: DataFrame) -> DataFrame:
    """Failed publishes and commits by the simple name of their error."""
    simple = F.element_at(F.split("error_class", r"\."), -1)
    return counter(publishes.where("not ok"), "dlt.failures", topic=F.col("topic"), cause=simple).unionByName(counter(commits.where("not ok"), "ack.commit_failed", topic=F.col("topic"), exception_class=simple))


def backpressure_events(transitions: DataFrame) -> DataFrame:
    """Pauses and resumes per topic, from rows (topic, event); rows without an event don't count."""
    return counter(transitions.where("event is not null"), "backpressure.events", topic=F.col("topic"), event=F.col("event"))


def barrier_gauges(barriers: DataFrame, key: str) -> DataFrame:
    """The barrier in force per key, from rows (key, barrier_ms)."""
    return barriers.select(F.lit(METER + "barrier.timeout").alias("name"), F.lit("gauge").alias("kind"), F.concat(F.lit(f"{key}="), F.col(key)).alias("tags"), F.col("barrier_ms").cast("double").alias("value"))


def timers(attempts: DataFrame) -> DataFrame:
    """process.duration over successes and failures: count, sum, max and nearest-rank percentiles."""
    return attempts.groupBy("topic").agg(
        F.count("*").alias("n"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms)").cast("bigint").alias("p50"),
        F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY duration_ms)").cast("bigint").alias("p99"),
    )


def histogram(attempts: DataFrame, bounds: list[int]) -> DataFrame:
    """Cumulative counts per upper bound."""
    row = attempts.groupBy("topic").agg(*(F.count_if(F.col("duration_ms") <= b).alias(str(b)) for b in bounds))
    return row.unpivot(["topic"], [str(b) for b in bounds], "le_ms", "n").withColumn("le_ms", F.col("le_ms").cast("bigint"))
