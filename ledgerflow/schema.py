"""Fixed schemas of the relations. Nothing is inferred."""

from __future__ import annotations

HEADERS = "array<struct<key:string,value:binary>>"
RECORDS = (f"topic string, partition int, offset bigint, ts timestamp, ts_ms bigint, key binary, value binary, headers {HEADERS}, delivery_count int, epoch bigint")
ATTEMPTS = "topic string, partition int, offset bigint, attempt int, delivery_count int, started_ms bigint, duration_ms bigint, failed boolean, error_class string, error_message string, timed_out boolean, decision string, delay_ms bigint"
ACKS = "topic string, partition int, offset bigint, seq bigint, outcome string, cause string"
OWNERSHIP = "topic string, partition int, epoch bigint, assigned_ms bigint, revoked_ms bigint, how string"
COMMIT_POSITIONS = "topic string, partition int, epoch bigint, position bigint, parked int, moved boolean"
DEAD_LETTERS = f"dlq_topic string, key binary, value binary, headers {HEADERS}"
METRICS = "name string, kind string, tags string, value double"
#: What the driver's event table looks like; needed to read it as a stream.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
COORDINATE = ("topic", "partition", "offset")
