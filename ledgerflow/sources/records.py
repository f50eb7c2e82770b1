"""Sources: batch tables, a file stream, an optional broker, records in memory; start positions and fetch sizes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.schema import EVENTS, RECORDS


def epoch_ms(column: str) -> F.Column:
    """Milliseconds since 1970 of a timestamp without zone, in any session zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def records_from_events(events: DataFrame, partitions: int = 4) -> DataFrame:
    """Records of topic ``events``: a user's events share a partition, offsets are sparse, header ``type`` comes twice.

    Besides the columns of a record: user_id, event_type, duration_ms and kind (0 ok, 1 fails once, 2 always fails, 3 slow).
    """
    text = lambda c: c.cast("string").cast("binary")
    header = lambda k, v: F.struct(F.lit(k).alias("key"), text(v).alias("value"))
    return events.select(
        F.lit("events").alias("topic"),
        F.pmod("user_id", F.lit(partitions)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        epoch_ms("ts").alias("ts_ms"),
        text(F.col("user_id")).alias("key"),
        text(F.col("props")).alias("value"),
        F.array(header("type", F.col("event_type")), header("src", F.lit("events")), header("type", F.concat(F.col("event_type"), F.lit("-2")))).alias("headers"),
        (F.lit(1) + F.pmod("event_id", F.lit(3))).cast("int").alias("delivery_count"),
        "user_id",
        "event_type",
        F.round(F.col("value") * 10).cast("bigint").alias("duration_ms"),
        F.pmod("event_id", F.lit(4)).cast("int").alias("kind"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of events; the fetch size is counted in files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def broker_options(topic: str, servers: str, reset: str = "latest", max_offsets: int | None = None, properties: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of a ``kafka`` stream. The connector isn't part of PySpark; this builds its options and nothing more."""
    if reset not in ("earliest", "latest"):
        raise ValueError("a stream starts at earliest or latest")
    out = {"subscribe": topic, "kafka.bootstrap.servers": servers, "startingOffsets": reset, "includeHeaders": "true", "failOnDataLoss": "true"}
    if max_offsets:
        out["maxOffsetsPerTrigger"] = str(max_offsets)
    return out | {f"kafka.{k}": v for k, v in (properties or {}).items()}


def from_position(records: DataFrame, positions: DataFrame) -> DataFrame:
    """Replay: records at or behind the committed position of their partition; partitions without one from their start."""
    p = positions.select("topic", "partition", "position")
    return records.join(p, ["topic", "partition"], "left").where("position is null or offset >= position").drop("position")


def records_in_memory(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Records for tests; what a row leaves out has a plain default."""
    names = ("topic", "partition", "offset", "ts", "ts_ms", "key", "value", "headers", "delivery_count", "epoch")
    plain = {"topic": "test-topic", "partition": 0, "offset": 0, "ts": None, "ts_ms": 0, "key": None, "value": None, "headers": [], "delivery_count": 1, "epoch": 0}
    made = []
    for row in rows:
        full = plain | dict(row)
        if full["partition"] < 0 or full["offset"] < 0 or full["topic"] is None:
            raise ValueError("a coordinate needs a topic, and a partition and an offset that aren't negative")
        made.append(tuple(full[n] for n in names))
    return spark.createDataFrame(made, RECORDS)
