"""The queries over the driver's tables, each with SQL for another engine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.config import BarrierConfig, DeadLetterConfig, Ordering, RetryPolicy
from ledgerflow.functions import decode, keys, retry
from ledgerflow.operators import acks, attempts, barrier, dead_letters, dispatch, frontier, handlers, metrics, pressure, sessions, verify
from ledgerflow.sources.records import epoch_ms, from_position, read_events, records_from_events
from ledgerflow.streaming.pipeline import run_ledger, run_positions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

POLICY = RetryPolicy(max_attempts=2, initial_ms=20, multiplier=1.5, jitter=0.0)
TP = ("topic", "partition")


def _fails() -> F.Column:
    """How many invocations of a record fail; null: all."""
    return F.when(F.col("kind") == 1, 1).when(F.col("kind") == 2, F.lit(None)).otherwise(0)


#: The records relation, by the same rules as records_from_events.
REC = """rec AS (SELECT 'events' AS topic, CAST(((user_id % 4) + 4) % 4 AS INT) AS "partition", event_id AS "offset", epoch_us(ts) // 1000 AS ts_ms,
  CAST(user_id AS VARCHAR) AS key, props AS value, event_type, user_id, CAST(1 + event_id % 3 AS INT) AS delivery_count,
  CAST(round(value * 10) AS BIGINT) AS duration_ms, CAST(event_id % 4 AS INT) AS kind, event_id % 997 <> 996 AS done FROM events)"""
#: Attempts of POLICY over the records: kind 1 fails once, kind 2 always.
ATT = (
    REC
    + """, att AS (SELECT r.*, CAST(a.i AS INT) AS attempt, kind = 2 OR (kind = 1 AND a.i = 0) AS failed,
  CASE WHEN kind = 2 AND a.i = 2 THEN 'exhausted' WHEN kind = 2 OR (kind = 1 AND a.i = 0) THEN 'inline' END AS decision,
  CAST(CASE WHEN (kind = 2 AND a.i < 2) OR (kind = 1 AND a.i = 0) THEN trunc(20 * pow(1.5, a.i)) ELSE 0 END AS BIGINT) AS delay_ms
  FROM rec r, (SELECT unnest([0, 1, 2]) AS i) a WHERE a.i <= CASE kind WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END)"""
)
HASH = """hashed AS (SELECT *, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS key_hash FROM (SELECT *, list_reduce(list_prepend(1::BIGINT,
  list_transform(range(CAST(length(hex(encode(key))) // 2 AS BIGINT)), lambda i: ('0x' || substr(hex(encode(key)), 2 * i + 1, 2))::BIGINT)),
  lambda a, b: (a * 31 + CASE WHEN b > 127 THEN b - 256 ELSE b END) & 4294967295) AS h FROM rec))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rec(spark: SparkSession, sf: str) -> DataFrame:
    return records_from_events(read_events(spark, sf))


def _done(spark: SparkSession, sf: str) -> DataFrame:
    return _rec(spark, sf).withColumn("done", F.pmod("offset", F.lit(997)) != 996)


def _att(spark: SparkSession, sf: str) -> DataFrame:
    return attempts.expand_attempts(_rec(spark, sf), POLICY, _fails())


def _text(c: str) -> F.Column:
    return F.col(c).cast("string").alias(c)


# Sources and scalar functions


@query(f'WITH {REC} SELECT topic, "partition", "offset", ts_ms, hex(encode(key)) AS key_hex, delivery_count, duration_ms FROM rec')
def records_scan(spark, sf):
    return _rec(spark, sf).select("topic", "partition", "offset", "ts_ms", F.hex("key").alias("key_hex"), "delivery_count", "duration_ms")


@query(f"""WITH {REC}, p AS (SELECT topic, "offset", "offset" % 50 = 0 AS bad, regexp_extract(value, '^.."k": ([0-9]+).$', 1) AS k FROM rec)
  SELECT topic, CASE WHEN bad THEN 'reject' ELSE 'decoded' END AS outcome, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(CASE WHEN bad THEN 0 ELSE CAST(nullif(k, '') AS BIGINT) END), 0) AS BIGINT) AS k_sum FROM p GROUP BY ALL""".replace('^.."k"', '^.\\"k\\"').replace('\\"', '"'))
def poison_split(spark, sf):
    rows = _rec(spark, sf).withColumn("value", F.when(F.pmod("offset", F.lit(50)) == 0, F.encode(F.lit('{"k'), "UTF-8")).otherwise(F.col("value")))
    good, bad = decode.split_poison(rows, decode.json_payload(decode.utf8(F.col("value")), "k bigint"))
    one = good.groupBy("topic").agg(F.count("*").alias("n"), F.coalesce(F.sum("payload.k"), F.lit(0)).alias("k_sum")).withColumn("outcome", F.lit("decoded"))
    return one.unionByName(bad.groupBy("topic", "outcome").agg(F.count("*").alias("n")).withColumn("k_sum", F.lit(0).cast("bigint")))


@query("""SELECT doc_id, doc_id % 3 = 0 AS malformed, CAST(len(text) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_chars, md5(text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END) AS text_md5 FROM documents""")
def utf8_decode(spark, sf):
    """Every third text ends in the first two bytes of a character of three, which decode to one U+FFFD."""
    raw = F.concat(F.col("text").cast("binary"), F.when(F.pmod("doc_id", F.lit(3)) == 0, F.unhex(F.lit("E282"))).otherwise(F.unhex(F.lit(""))))
    text = decode.utf8(F.col("raw"))
    return spark.read.parquet(f"{sf}/documents.parquet").withColumn("raw", raw).select("doc_id", decode.is_malformed(F.col("raw")).alias("malformed"), F.length(text).cast("bigint").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


@query("""SELECT doc_id, CAST(len(list_filter(range(0, CAST(least(4096, len(hx) // 2) AS BIGINT)), lambda i: substr(hx, 2 * i + 1, 1) NOT IN ('8', '9', 'A', 'B')))
  - CASE WHEN substr(hx, 8193, 1) IN ('8', '9', 'A', 'B') THEN 1 ELSE 0 END AS BIGINT) AS n_chars FROM (SELECT doc_id, hex(encode(text)) AS hx FROM documents)""")
def truncated_trace(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length(decode.truncate_utf8(F.col("text"))).cast("bigint").alias("n_chars"))


@query(f"""WITH {REC} SELECT "offset", event_type || '|' || event_type || '-2' AS vals, event_type || '-2' AS last, CAST(NULL AS VARCHAR) AS absent, 'type|src' AS names FROM rec""")
def header_lookup(spark, sf):
    h = F.col("headers")
    join = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), "|")
    return _rec(spark, sf).select("offset", join(decode.header_values(h, "type")).alias("vals"), decode.header_last(h, "type").cast("string").alias("last"), decode.header_last(h, "none").cast("string").alias("absent"), join(decode.header_names(h)).alias("names"))


@query(f'WITH {REC} SELECT "offset", CAST(coalesce(nullif(delivery_count, 3), 1) AS INT) AS share_count, CAST(kind + 1 AS INT) AS classic_count, topic || \'.DLT\' AS dlq_topic FROM rec')
def delivery_counts(spark, sf):
    return _rec(spark, sf).select("offset", decode.delivery_count(F.nullif("delivery_count", F.lit(3))).cast("int").alias("share_count"), (F.col("kind") + 1).alias("classic_count"), decode.dead_letter_topic(F.col("topic")).alias("dlq_topic"))


@query(f'WITH {REC}, p AS (SELECT "partition", min("offset") + 500 AS position FROM rec WHERE "partition" < 3 GROUP BY 1) SELECT r."partition", CAST(count(*) AS BIGINT) AS n, min("offset") AS first FROM rec r LEFT JOIN p USING ("partition") WHERE position IS NULL OR "offset" >= position GROUP BY 1')
def replay_from_position(spark, sf):
    rows = _rec(spark, sf)
    at = rows.where("partition < 3").groupBy("topic", "partition").agg((F.min("offset") + 500).alias("position"))
    return from_position(rows, at).groupBy("partition").agg(F.count("*").alias("n"), F.min("offset").alias("first"))


# Keys and dispatch


@query(f'WITH {REC}, {HASH} SELECT "offset", CAST(key_hash AS BIGINT) AS key_hash, CAST(((key_hash % 64) + 64) % 64 AS INT) AS shard FROM hashed')
def key_shard_assignment(spark, sf):
    return _rec(spark, sf).select("offset", keys.key_hash(F.col("key")).alias("key_hash"), keys.shard_index(F.col("key"), 64).alias("shard"))


@query(f'WITH {REC}, {HASH} SELECT "partition", CAST(((key_hash % 64) + 64) % 64 AS INT) AS shard, CAST(count(DISTINCT key) AS BIGINT) AS keys, CAST(count(*) AS BIGINT) AS records FROM hashed GROUP BY 1, 2')
def shard_skew(spark, sf):
    return verify.shard_skew(dispatch.with_shard(_rec(spark, sf), 64)).select("partition", "shard", "keys", "records")


@query(f"""WITH {REC}, {HASH}, s AS (SELECT "partition", ((key_hash % 64) + 64) % 64 AS shard, count(DISTINCT key) AS k FROM hashed GROUP BY 1, 2)
  SELECT CAST(sum(k) AS BIGINT) AS keys, CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS sharing, CAST(count(*) AS BIGINT) AS shards, CAST(max(k) AS BIGINT) AS most FROM s""")
def shard_collision_rate(spark, sf):
    return verify.collisions(dispatch.with_shard(_rec(spark, sf), 64))


@query(f"""WITH {REC}, {HASH} SELECT "partition", CAST(CASE WHEN "offset" % 50 = 0 THEN 0 ELSE ((key_hash % 16) + 16) % 16 END AS INT) AS shard, CAST(count(*) AS BIGINT) AS records FROM hashed GROUP BY 1, 2""")
def null_key_shard(spark, sf):
    rows = _rec(spark, sf).withColumn("key", F.when(F.pmod("offset", F.lit(50)) != 0, F.col("key")))
    return dispatch.with_shard(rows, 16).groupBy("partition", "shard").agg(F.count("*").alias("records"))


@query(f'WITH {REC} SELECT "offset", CAST(sum(duration_ms) OVER w AS BIGINT) - duration_ms AS start_ms, CAST(sum(duration_ms) OVER w AS BIGINT) AS end_ms FROM rec WINDOW w AS (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING)')
def dispatch_partition_serial(spark, sf):
    return dispatch.schedule(_rec(spark, sf), Ordering.PARTITION).select("offset", "start_ms", "end_ms")


@query(f"""WITH {REC}, {HASH}, s AS (SELECT *, ((key_hash % 64) + 64) % 64 AS shard FROM hashed)
  SELECT "offset", CAST(shard AS INT) AS shard, CAST(sum(duration_ms) OVER w AS BIGINT) - duration_ms AS start_ms, CAST(sum(duration_ms) OVER w AS BIGINT) AS end_ms FROM s WINDOW w AS (PARTITION BY "partition", shard ORDER BY "offset" ROWS UNBOUNDED PRECEDING)""")
def dispatch_key_shard(spark, sf):
    return dispatch.schedule(_rec(spark, sf), Ordering.KEY).select("offset", "shard", "start_ms", "end_ms")


@query(f'WITH {REC} SELECT "offset", CAST(0 AS BIGINT) AS start_ms, duration_ms AS end_ms FROM rec')
def dispatch_unordered(spark, sf):
    return dispatch.schedule(_rec(spark, sf), Ordering.UNORDERED).select("offset", "start_ms", "end_ms")


@query(f"""WITH {REC}, s AS (SELECT *, sum(duration_ms) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING) - duration_ms AS start_ms FROM rec)
  SELECT "partition", CAST(count(*) FILTER ("partition" < 2 AND start_ms >= 100000) AS BIGINT) AS purged, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1""")
def purge_on_revoke(spark, sf):
    own = spark.range(4).select(F.lit("events").alias("topic"), F.col("id").cast("int").alias("partition"), F.when(F.col("id") < 2, 100_000).cast("bigint").alias("revoked_ms"))
    done = dispatch.purge_on_revoke(dispatch.schedule(_rec(spark, sf), Ordering.PARTITION), own)
    return done.groupBy("partition").agg(F.count_if("purged").alias("purged"), F.count("*").alias("n"))


@query(f"""WITH {REC}, {HASH} SELECT 'serial' AS mode, CAST(sum(duration_ms) AS BIGINT) AS makespan_ms FROM rec
  UNION ALL SELECT 'share', CAST(sum(d) AS BIGINT) FROM (SELECT max(duration_ms) AS d FROM rec GROUP BY "offset" // 16)
  UNION ALL SELECT 'key', CAST(max(d) AS BIGINT) FROM (SELECT sum(duration_ms) AS d FROM hashed GROUP BY "partition", ((key_hash % 64) + 64) % 64)
  UNION ALL SELECT 'partition', CAST(max(d) AS BIGINT) FROM (SELECT sum(duration_ms) AS d FROM rec GROUP BY "partition")""")
def makespan_by_mode(spark, sf):
    return dispatch.makespans(_rec(spark, sf))


@query(f"""WITH {REC} SELECT CAST(sum(duration_ms) // 1000 AS BIGINT) AS serial_s, CAST(sum(duration_ms) * 100 // (SELECT sum(d) FROM (SELECT max(duration_ms) AS d FROM rec GROUP BY "offset" // 16)) AS BIGINT) AS speedup_pct FROM rec""")
def share_speedup(spark, sf):
    m = dispatch.makespans(_rec(spark, sf)).groupBy().pivot("mode", ["serial", "share"]).agg(F.first("makespan_ms"))
    return m.select(F.expr("serial div 1000").alias("serial_s"), F.expr("serial * 100 div share").alias("speedup_pct"))


# Retry


@query("""SELECT name, CAST(i AS INT) AS attempt, CAST(greatest(1, trunc(init * pow(mult, i))) AS BIGINT) AS delay_ms
  FROM (VALUES ('a', 100, 2.0::DOUBLE), ('b', 20, 1.5::DOUBLE), ('c', 2000, 1.0::DOUBLE), ('d', 1, 1.0::DOUBLE)) p(name, init, mult), (SELECT unnest(range(8)) AS i)""")
def retry_delays(spark, sf):
    out = None
    for name, ms, m in (("a", 100, 2.0), ("b", 20, 1.5), ("c", 2000, 1.0), ("d", 1, 1.0)):
        rows = spark.range(8).select(F.lit(name).alias("name"), F.col("id").cast("int").alias("attempt"), retry.backoff_ms(RetryPolicy(8, ms, m, 0.0), F.col("id")).alias("delay_ms"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {REC}, e AS (SELECT *, CAST(greatest("offset" % 5, greatest(0, delivery_count - 1 - ("offset" % 2))) AS INT) AS eff FROM rec)
  SELECT "offset", eff AS attempt, CASE WHEN kind = 3 THEN 'reject' WHEN eff >= 4 THEN 'exhausted' WHEN greatest(1, trunc(500 * pow(2.0, eff))) <= 1000 THEN 'inline' ELSE 'delayed' END AS decision FROM e""")
def retry_decisions(spark, sf):
    policy = RetryPolicy(4, 500, 2.0, 0.0)
    eff = retry.effective_attempt(F.pmod("offset", F.lit(5)), F.col("delivery_count"), F.pmod("offset", F.lit(2))).cast("int")
    rows = _rec(spark, sf).withColumn("attempt", eff)
    return rows.select("offset", "attempt", retry.decision(policy, F.col("attempt"), F.col("kind") != 3).alias("decision"))


@query(f'WITH {REC} SELECT "offset", CASE WHEN kind IN (0, 1) THEN \'inline\' ELSE \'reject\' END AS decision FROM rec')
def retriable_classes(spark, sf):
    policy = RetryPolicy(3, 100, 2.0, 0.0, retriable=("IOError",), parents={"TimeoutError": "IOError", "SocketTimeout": "TimeoutError", "ValueError": "Exception"})
    error = F.element_at(F.array(*map(F.lit, ("SocketTimeout", "IOError", "ValueError", "KeyError"))), F.col("kind") + 1)
    return _rec(spark, sf).select("offset", retry.decision(policy, F.lit(0), retry.is_retriable(policy, error)).alias("decision"))


@query(f"""WITH {REC} SELECT "offset", CAST(greatest(0, delivery_count - 1 - s) AS INT) AS effective, CASE WHEN greatest(0, delivery_count - 1 - s) >= 1 THEN 'exhausted' ELSE 'inline' END AS decision
  FROM (SELECT *, CASE WHEN duration_ms > 2500 THEN 1 ELSE 0 END AS s FROM rec)""")
def slowness_adjusted_budget(spark, sf):
    rows = _rec(spark, sf)
    forced = rows.where("duration_ms > 2500").select("topic", "partition", "offset", F.lit(1).cast("bigint").alias("seq"), F.lit("release").alias("outcome"), F.lit("slowness").alias("cause"))
    slow = acks.slowness(forced)
    both = rows.join(slow, ["topic", "partition", "offset"], "left").withColumn("effective", retry.effective_attempt(F.lit(0), F.col("delivery_count"), F.coalesce("slowness", F.lit(0))).cast("int"))
    return both.select("offset", "effective", retry.decision(RetryPolicy(1, 100, 2.0, 0.0), F.col("effective"), F.lit(True)).alias("decision"))


@query(f'WITH {ATT} SELECT "offset", attempt, failed, decision, delay_ms FROM att')
def attempt_ledger(spark, sf):
    return _att(spark, sf).select("offset", "attempt", "failed", "decision", "delay_ms")


@query(f"""WITH {ATT} SELECT CASE WHEN kind = 2 THEN 'dlq' ELSE 'handler' END AS cause, 'accept' AS outcome, CAST(count(*) AS BIGINT) AS n, CAST(sum(attempt) AS BIGINT) AS retries
  FROM att WHERE decision IS NULL OR decision = 'exhausted' GROUP BY 1""")
def terminal_outcomes(spark, sf):
    return attempts.terminal_outcomes(_att(spark, sf), True).groupBy("cause", "outcome").agg(F.count("*").alias("n"), F.sum("attempt").alias("retries"))


@query(f'WITH {ATT} SELECT "offset", attempt, duration_ms > 3000 AND failed AS timed_out, CASE WHEN duration_ms > 3000 AND failed THEN \'HandlerTimeout\' WHEN failed THEN \'java.lang.IllegalStateException\' END AS error_class FROM att')
def handler_timeout(spark, sf):
    return attempts.with_timeout(_att(spark, sf), 3000).select("offset", "attempt", "timed_out", "error_class")


@query(f'WITH {ATT} SELECT "offset", CAST(sum(duration_ms + delay_ms) AS BIGINT) AS blocked_ms FROM att GROUP BY 1')
def chain_blocking(spark, sf):
    return attempts.blocked_ms(_att(spark, sf)).select("offset", "blocked_ms")


# Acknowledgements


def _acks(rows: DataFrame) -> DataFrame:
    """Three acknowledgements for each record; the slow ones are released by force first."""
    one = lambda seq, outcome, cause: rows.select("topic", "partition", "offset", F.lit(seq).cast("bigint").alias("seq"), outcome.alias("outcome"), cause.alias("cause"), F.pmod("offset", F.lit(5)).alias("m"))
    slow = F.col("duration_ms") > 2500
    return one(1, F.when(slow, "release").otherwise("accept"), F.when(slow, "slowness").otherwise("handler")).where("m <> 1").unionByName(one(2, F.lit("reject"), F.lit("retry"))).where("m <> 2").unionByName(one(3, F.lit("accept"), F.lit("handler"))).where("m <> 3").drop("m")


ACK = (
    REC
    + """, ack AS (SELECT topic, "partition", "offset", seq, CASE seq WHEN 1 THEN CASE WHEN duration_ms > 2500 THEN 'release' ELSE 'accept' END WHEN 2 THEN 'reject' ELSE 'accept' END AS outcome,
  CASE seq WHEN 1 THEN CASE WHEN duration_ms > 2500 THEN 'slowness' ELSE 'handler' END WHEN 2 THEN 'retry' ELSE 'handler' END AS cause
  FROM rec, (SELECT unnest([1, 2, 3]) AS seq) WHERE "offset" % 5 <> 3 AND NOT ("offset" % 5 = 2 AND seq < 3) AND NOT ("offset" % 5 = 1 AND seq = 1))"""
)


@query(f'WITH {ACK} SELECT "offset", arg_min(outcome, seq) AS outcome, arg_min(cause, seq) AS cause, CAST(count(*) - 1 AS BIGINT) AS dropped FROM ack GROUP BY 1')
def ack_first_wins(spark, sf):
    return acks.first_wins(_acks(_rec(spark, sf))).select("offset", "outcome", "cause", "dropped")


@query(f"""WITH {ACK} SELECT r."offset", coalesce(a.outcome, 'release') AS outcome FROM rec r LEFT JOIN (SELECT "offset", arg_min(outcome, seq) AS outcome FROM ack GROUP BY 1) a USING ("offset")""")
def ack_auto_release(spark, sf):
    rows = _rec(spark, sf)
    return acks.auto_release(rows, _acks(rows)).select("offset", "outcome")


@query(f"""WITH {REC} SELECT CASE WHEN "offset" % 3 = 0 THEN 'ack' WHEN kind IN (1, 2) THEN 'failure' ELSE 'return' END AS decided_by, CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY 1""")
def ack_then_throw(spark, sf):
    rows = _rec(spark, sf)
    acked = rows.where("pmod(offset, 3) = 0").select("topic", "partition", "offset", F.lit(1).alias("seq"), F.lit("accept").alias("outcome"), F.lit("handler").alias("cause"))
    joined = rows.join(acks.first_wins(acked).select("topic", "partition", "offset", "outcome"), ["topic", "partition", "offset"], "left")
    decided = handlers.manual_outcome(F.col("outcome"), F.when(F.col("kind").isin(1, 2), F.lit("thrown")))
    return joined.groupBy(F.when(decided == "retry", "failure").when(decided == "release", "return").otherwise("ack").alias("decided_by")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {REC}, o AS (SELECT user_id, ts_ms, "offset", duration_ms * 2000 AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, "offset") AS n FROM rec),
  f AS (SELECT user_id, n, "offset", false AS duplicate, ts_ms + d AS until FROM o WHERE n = 1
    UNION ALL SELECT o.user_id, o.n, o."offset", o.ts_ms < f.until, CASE WHEN o.ts_ms < f.until THEN f.until ELSE o.ts_ms + o.d END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
  SELECT "offset", duplicate FROM f""")
def duplicate_inflight(spark, sf):
    rows = _rec(spark, sf).select("user_id", F.col("ts_ms").alias("started_ms"), F.col("offset").alias("delivery_seq"), (F.col("duration_ms") * 2000).alias("duration_ms"))
    return acks.mark_duplicates(rows, ["user_id"]).select(F.col("delivery_seq").alias("offset"), "duplicate")


@query(f'WITH {REC} SELECT "offset", CASE WHEN "offset" % 2 = 0 THEN \'accept\' ELSE \'reject\' END AS outcome FROM rec')
def stale_ack_drop(spark, sf):
    rows = _rec(spark, sf).select("topic", "partition", "offset")
    old = rows.where("pmod(offset, 2) = 0").withColumn("delivery_seq", F.lit(1)).withColumn("outcome", F.lit("accept"))
    older = rows.where("pmod(offset, 2) = 1").withColumn("delivery_seq", F.lit(1)).withColumn("outcome", F.lit("accept"))
    new = rows.where("pmod(offset, 2) = 1").withColumn("delivery_seq", F.lit(2)).withColumn("outcome", F.lit("reject"))
    return acks.current_delivery_only(old.unionByName(older).unionByName(new)).select("offset", "outcome")


# Commit positions


@query(f"""WITH {REC}, p AS (SELECT *, min(done::INT) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING) = 1 AS prefix FROM rec)
  SELECT "partition", coalesce(max(CASE WHEN prefix THEN "offset" + 1 END), min("offset")) AS position, CAST(count(*) FILTER (done AND NOT prefix) AS BIGINT) AS parked FROM p GROUP BY 1""")
def commit_frontier(spark, sf):
    return frontier.commit_positions(_done(spark, sf)).select("partition", "position", "parked")


@query(f"""WITH {REC}, d AS (SELECT "partition", "offset", CASE WHEN done THEN ("offset" // 100) % 10 + "offset" // 1000 END AS done_seq FROM rec),
  s AS (SELECT unnest(range(0, (SELECT max(done_seq) + 1 FROM d))) AS drain_seq), p AS (SELECT d."partition", s.drain_seq, "offset", coalesce(done_seq <= s.drain_seq, false) AS ok FROM d, s),
  w AS (SELECT *, min(ok::INT) OVER (PARTITION BY "partition", drain_seq ORDER BY "offset" ROWS UNBOUNDED PRECEDING) = 1 AS prefix FROM p),
  a AS (SELECT "partition", drain_seq, coalesce(max(CASE WHEN prefix THEN "offset" + 1 END), min("offset")) AS position FROM w GROUP BY 1, 2)
  SELECT "partition", drain_seq, position, position IS DISTINCT FROM lag(position) OVER (PARTITION BY "partition" ORDER BY drain_seq) AS moved FROM a""")
def commit_frontier_history(spark, sf):
    rows = _done(spark, sf).withColumn("done_seq", F.when(F.col("done"), F.expr("(offset div 100) % 10 + offset div 1000")))
    last = rows.groupBy().agg(F.max("done_seq").alias("last"))
    drains = rows.select("topic", "partition").distinct().crossJoin(F.broadcast(last)).select("topic", "partition", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("drain_seq"))
    return frontier.position_history(rows, drains).select("partition", "drain_seq", "position", "moved")


COMMITS = REC + """, c AS (SELECT "partition", "offset" AS position, ("offset" // 7) % 3 <> 1 AND "offset" % 1000 < 990 AS ok FROM rec)"""


@query(f"""WITH {COMMITS}, m AS (SELECT "partition", max(position) FILTER (ok) AS committed, max(position) FILTER (NOT ok) AS failed FROM c GROUP BY 1)
  SELECT "partition", committed, CASE WHEN failed > coalesce(committed, -1) THEN failed END AS buffered FROM m""")
def commit_high_water(spark, sf):
    return frontier.high_water(_commits(spark, sf)).select("partition", "committed", "buffered")


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    return _rec(spark, sf).select("topic", "partition", F.col("offset").alias("position"), F.expr("(offset div 7) % 3 <> 1 AND offset % 1000 < 990").alias("ok"))


@query(f"""WITH {COMMITS}, m AS (SELECT "partition", max(position) FILTER (ok AND position < 500) AS committed FROM c GROUP BY 1)
  SELECT "partition", CAST(count(*) AS BIGINT) AS kept, min(position) AS first FROM c LEFT JOIN m USING ("partition") WHERE committed IS NULL OR position > committed GROUP BY 1""")
def stale_commit_filter(spark, sf):
    rows = _commits(spark, sf)
    return frontier.drop_stale(rows, frontier.high_water(rows.where("position < 500"))).groupBy("partition").agg(F.count("*").alias("kept"), F.min("position").alias("first"))


OWN = REC + """, b AS (SELECT "partition", min("offset") AS lo, max("offset") AS hi FROM rec GROUP BY 1),
  own AS (SELECT "partition", e AS epoch, lo + (hi - lo + 1) * (e - 1) // 3 AS f, lo + (hi - lo + 1) * e // 3 - 1 AS l, CASE e WHEN 1 THEN 'revoked' WHEN 2 THEN 'lost' END AS how FROM b, (SELECT unnest([1, 2, 3]) AS e))"""


def _own(rows: DataFrame) -> DataFrame:
    """Each partition in three epochs by offset: revoked, lost, current."""
    b = rows.groupBy("topic", "partition").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi")).withColumn("epoch", F.explode(F.array(*(F.lit(e).cast("bigint") for e in (1, 2, 3)))))
    return b.select("topic", "partition", "epoch", F.expr("lo + (hi - lo + 1) * (epoch - 1) div 3").alias("first_offset"), F.expr("lo + (hi - lo + 1) * epoch div 3 - 1").alias("last_offset"), F.expr("case epoch when 1 then 'revoked' when 2 then 'lost' end").alias("how"))


@query(f"""WITH {OWN}, r AS (SELECT rec.*, epoch FROM rec JOIN own ON rec."partition" = own."partition" AND "offset" BETWEEN f AND l WHERE how IS DISTINCT FROM 'lost'),
  p AS (SELECT *, min(done::INT) OVER (PARTITION BY "partition", epoch ORDER BY "offset" ROWS UNBOUNDED PRECEDING) = 1 AS prefix FROM r)
  SELECT "partition", CAST(epoch AS BIGINT) AS epoch, coalesce(max(CASE WHEN prefix THEN "offset" + 1 END), min("offset")) AS position, CAST(count(*) FILTER (done AND NOT prefix) AS BIGINT) AS parked FROM p GROUP BY 1, 2""")
def epoch_filtered_frontier(spark, sf):
    rows = _done(spark, sf)
    return frontier.epoch_positions(rows, _own(rows)).select("partition", "epoch", "position", "parked")


@query(f"""WITH {OWN} SELECT own."partition", CAST(epoch AS BIGINT) AS epoch, coalesce(how, 'current') AS how, CAST(count(*) AS BIGINT) AS completions,
  CAST(count(*) FILTER (how IS NULL OR duration_ms < 2000) AS BIGINT) AS counted FROM rec JOIN own ON rec."partition" = own."partition" AND "offset" BETWEEN f AND l GROUP BY ALL""")
def revoke_vs_lost(spark, sf):
    rows = _rec(spark, sf)
    own = _own(rows).withColumn("revoked_ms", F.when(F.col("how").isNotNull(), F.lit(2000).cast("bigint")))
    ended = rows.join(own.select("topic", "partition", "epoch", "first_offset", "last_offset"), ["topic", "partition"]).where("offset between first_offset and last_offset").withColumn("done_ms", F.col("duration_ms"))
    ok = frontier.in_epochs(ended, own).groupBy("partition", "epoch").agg(F.count("*").alias("counted"))
    all_ = ended.join(own.select("topic", "partition", "epoch", "how"), ["topic", "partition", "epoch"]).groupBy("partition", "epoch", F.coalesce("how", F.lit("current")).alias("how")).agg(F.count("*").alias("completions"))
    return all_.join(ok, ["partition", "epoch"], "left").withColumn("counted", F.coalesce("counted", F.lit(0)))


@query(f'WITH {OWN} SELECT rec."partition", CAST(count(*) AS BIGINT) AS n FROM rec JOIN own ON rec."partition" = own."partition" AND "offset" BETWEEN f AND l WHERE epoch = 3 GROUP BY 1')
def still_owned(spark, sf):
    rows = _rec(spark, sf)
    own = _own(rows)
    tagged = rows.join(own.select("topic", "partition", "epoch", "first_offset", "last_offset"), ["topic", "partition"]).where("offset between first_offset and last_offset")
    return frontier.still_owned(tagged, own).groupBy("partition").agg(F.count("*").alias("n"))


@query(f"""WITH {REC}, p AS (SELECT *, min(done::INT) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING) = 1 AS prefix FROM rec),
  pos AS (SELECT "partition", coalesce(max(CASE WHEN prefix THEN "offset" + 1 END), min("offset")) AS position FROM p GROUP BY 1),
  hole AS (SELECT "partition", min("offset") AS hole FROM rec WHERE NOT done GROUP BY 1)
  SELECT CAST(count(*) AS BIGINT) AS violations FROM pos JOIN hole USING ("partition") WHERE position > hole""")
def no_commit_past_unfinished(spark, sf):
    rows = _done(spark, sf)
    return verify.commits_past_unfinished(frontier.commit_positions(rows), rows).agg(F.count("*").alias("violations"))


# Barrier and pressure

ADAPTIVE = BarrierConfig(enabled=True, percentile=0.5, multiplier=3.0)


@query(f"""WITH {REC}, l AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY "offset" DESC) AS n FROM rec WHERE kind <> 2)
  SELECT "partition", CAST(count(*) AS BIGINT) AS samples, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99 FROM l WHERE n <= 1024 GROUP BY 1""")
def latency_percentiles(spark, sf):
    ok = barrier.latest(_rec(spark, sf).where("kind <> 2"), TP)
    return barrier.percentiles(ok, ["partition"], (0.5, 0.95, 0.99))


@query(f"""WITH {REC}, l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY "offset" DESC) AS n FROM rec WHERE kind <> 2)
  SELECT event_type, CAST(count(*) AS BIGINT) AS samples, CAST(CASE WHEN count(*) < 100 THEN 24000 ELSE least(24000, greatest(1000, ceil(quantile_disc(duration_ms, 0.5) * 3.0))) END AS BIGINT) AS barrier_ms FROM l WHERE n <= 1024 GROUP BY 1""")
def adaptive_barrier(spark, sf):
    return barrier.adaptive_barrier(_rec(spark, sf).where("kind <> 2"), ["event_type"], ADAPTIVE)


@query(f"""WITH {REC}, c AS (SELECT "offset", duration_ms * 10 + "offset" % 7 AS broker_ms, CASE WHEN kind = 0 THEN NULL ELSE duration_ms * 9 + kind * 1000 END AS lock_ms FROM rec)
  SELECT "offset", CAST(coalesce(lock_ms, broker_ms * 80 // 100) AS BIGINT) AS ceiling_ms, coalesce(lock_ms >= broker_ms, false) AS unsafe FROM c""")
def lock_alignment(spark, sf):
    """Every record as a setting of its own: the broker's lock, and one set by hand or not."""
    rows = _rec(spark, sf).select("offset", F.expr("duration_ms * 10 + offset % 7").alias("broker_ms"), F.expr("case when kind > 0 then duration_ms * 9 + kind * 1000 end").alias("lock_ms"))
    return rows.select("offset", *barrier.lock_alignment(F.col("lock_ms"), F.col("broker_ms")))


@query(f"""WITH {REC} SELECT CAST("offset" // 16 AS BIGINT) AS batch, CAST(max(least(duration_ms, 3000)) AS BIGINT) AS cost_ms, CAST(count(*) FILTER (duration_ms > 3000) AS BIGINT) AS released FROM rec GROUP BY 1""")
def drain_barrier_cost(spark, sf):
    return barrier.drain(_rec(spark, sf).withColumn("batch", F.expr("offset div 16")), "batch", 3000).select("batch", "cost_ms", "released")


SPANS = REC + """, ch AS (SELECT "partition", t_ms, sum(d) AS d FROM (SELECT "partition", ts_ms AS t_ms, 1 AS d FROM rec UNION ALL SELECT "partition", ts_ms + duration_ms * 400, -1 FROM rec) GROUP BY 1, 2),
  fl AS (SELECT "partition", t_ms, sum(d) OVER (PARTITION BY "partition" ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS n FROM ch)"""


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return _rec(spark, sf).withColumn("start_ms", F.col("ts_ms")).withColumn("end_ms", F.col("ts_ms") + F.col("duration_ms") * 400)


@query(f'WITH {SPANS} SELECT "partition", t_ms, CAST(n AS BIGINT) AS n FROM fl')
def in_flight_timeline(spark, sf):
    return pressure.in_flight(_spans(spark, sf), ["partition"])


@query(f'WITH {SPANS} SELECT "partition", CAST(max(n) AS BIGINT) AS peak FROM fl GROUP BY 1')
def peak_concurrency(spark, sf):
    return pressure.peak(_spans(spark, sf), ["partition"])


@query(f"""WITH {REC}, s AS (SELECT "partition", "offset", duration_ms // 400 AS n FROM rec), g AS (SELECT *, CASE WHEN n >= 8 THEN true WHEN n <= 4 THEN false END AS sig FROM s),
  p AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING), false) AS paused FROM g),
  e AS (SELECT *, coalesce(lag(paused) OVER (PARTITION BY "partition" ORDER BY "offset"), false) AS was FROM p)
  SELECT "partition", "offset", CASE WHEN paused THEN 'paused' ELSE 'resumed' END AS event FROM e WHERE paused <> was""")
def backpressure_transitions(spark, sf):
    ticks = _rec(spark, sf).withColumn("n", F.expr("duration_ms div 400"))
    return pressure.hysteresis(ticks, ["partition"], 8, "offset").where("event is not null").select("partition", "offset", "event")


@query(f"""WITH {REC}, h AS (SELECT "partition", ts_ms AS s, ts_ms + 1500000 AS e FROM rec WHERE kind = 2),
  m AS (SELECT *, max(e) OVER (PARTITION BY "partition" ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM h),
  k AS (SELECT *, sum(CASE WHEN u IS NULL OR s > u THEN 1 ELSE 0 END) OVER (PARTITION BY "partition" ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS span FROM m)
  SELECT "partition", min(s) AS start_ms, max(e) AS end_ms, CAST(count(*) AS BIGINT) AS holds FROM k GROUP BY "partition", span""")
def dlq_pause_spans(spark, sf):
    holds = _rec(spark, sf).where("kind = 2").select("partition", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 1_500_000).alias("end_ms"))
    return pressure.pause_spans(holds, ["partition"])


# Dead letters

LETTERS = DeadLetterConfig()


def _dead(spark: SparkSession, sf: str) -> DataFrame:
    out = attempts.terminal_outcomes(_att(spark, sf), True).where("cause = 'dlq'")
    out = out.withColumn("slowness", F.pmod("offset", F.lit(2)).cast("int")).withColumn("error_message", F.when(F.col("offset") % 3 > 0, F.concat(F.lit("failed at "), F.col("offset"))))
    return dead_letters.envelope(out, LETTERS, F.lit("-"))


@query(f"""WITH {REC} SELECT "offset", topic || '.DLT' AS dlq_topic, hex(encode(key)) AS key_hex, hex(encode(value)) AS value_hex, CAST(10 AS INT) AS n_headers,
  'type,src,type,ledger-dlt-original-topic,ledger-dlt-original-partition,ledger-dlt-original-offset,ledger-dlt-failure-class,ledger-dlt-failure-message,ledger-dlt-attempt-count,ledger-dlt-routed-at' AS names FROM rec WHERE kind = 2""")
def dead_letter_envelope(spark, sf):
    return _dead(spark, sf).select("offset", "dlq_topic", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), F.size("headers").alias("n_headers"), F.array_join(F.transform("headers", lambda h: h["key"]), ",").alias("names"))


@query(f"""WITH {REC} SELECT "offset", CAST("partition" AS VARCHAR) AS part, CAST("offset" AS VARCHAR) AS off, 'java.lang.IllegalStateException' AS cls, CASE WHEN "offset" % 3 > 0 THEN 'failed at ' || "offset" ELSE 'null' END AS msg,
  CAST(greatest(2, delivery_count - 1 - "offset" % 2) AS VARCHAR) AS attempts FROM rec WHERE kind = 2""")
def dead_letter_headers(spark, sf):
    h = lambda n: decode.header_last(F.col("headers"), LETTERS.prefix + n).cast("string")
    return _dead(spark, sf).select("offset", h("original-partition").alias("part"), h("original-offset").alias("off"), h("failure-class").alias("cls"), h("failure-message").alias("msg"), h("attempt-count").alias("attempts"))


@query(f"""WITH {REC} SELECT "offset", CAST(t AS INT) AS try, CAST(least(30000, 1000 * pow(2, t)) AS BIGINT) AS wait_ms,
  CAST(sum(least(30000, 1000 * pow(2, t))) OVER (PARTITION BY "offset" ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS held_ms FROM rec, (SELECT unnest(range(0, 9)) AS t) WHERE kind = 2 AND t < 1 + "offset" % 9""")
def dlq_failure_backoff(spark, sf):
    failed = _rec(spark, sf).where("kind = 2")
    return dead_letters.publish_retries(failed, 1 + F.pmod("offset", F.lit(9))).select("offset", "try", "wait_ms", "held_ms")


@query(f"""WITH {REC} SELECT CASE WHEN "offset" % 5 = 0 THEN 'release' ELSE 'accept' END AS share, CASE WHEN "offset" % 5 = 0 THEN 'held' ELSE 'accept' END AS classic, CAST(count(*) AS BIGINT) AS n FROM rec WHERE kind = 2 GROUP BY ALL""")
def dlq_publish_failure(spark, sf):
    ok = F.col("offset") % 5 != 0
    return _rec(spark, sf).where("kind = 2").groupBy(dead_letters.publish_outcome(ok, True).alias("share"), dead_letters.publish_outcome(ok, False).alias("classic")).agg(F.count("*").alias("n"))


# Metrics


@query(f"""WITH {ATT}, t AS (SELECT * FROM att WHERE decision IS NULL OR decision = 'exhausted'), m AS (
  SELECT 'records.polled' AS name, 'topic=events' AS tags, count(*) AS value FROM rec
  UNION ALL SELECT 'records.processed', 'topic=events,result=accept', count(*) FROM t
  UNION ALL SELECT 'records.failed', 'topic=events,exception_class=java.lang.IllegalStateException', count(*) FROM att WHERE failed
  UNION ALL SELECT 'records.poison_pill', 'topic=events,cause=deserialization', count(*) FROM rec WHERE "offset" % 50 = 0
  UNION ALL SELECT 'retry.attempts', 'topic=events,attempt=' || (attempt + 1), count(*) FROM att WHERE decision = 'inline' GROUP BY attempt
  UNION ALL SELECT 'dlt.routed', 'topic=events,dlt_topic=events.DLT', count(*) FROM t WHERE kind = 2
  UNION ALL SELECT 'ack.queued', 'type=accept', count(*) FROM t
  UNION ALL SELECT 'ack.committed', 'topic=events,type=accept', count(*) FROM t)
  SELECT 'ledger.consumer.' || name AS name, 'counter' AS kind, tags, CAST(value AS BIGINT) AS value FROM m""")
def metric_counters(spark, sf):
    rows, att = _rec(spark, sf), _att(spark, sf)
    poison = rows.where("offset % 50 = 0").withColumn("cause", F.lit("deserialization"))
    return metrics.ledger_counters(rows, att, attempts.terminal_outcomes(att, True), poison)


@query(f"""WITH {REC} SELECT 'ledger.consumer.dlt.failures' AS name, 'counter' AS kind, 'topic=events,cause=TimeoutException' AS tags, CAST(count(*) AS BIGINT) AS value FROM rec WHERE kind = 2 AND "offset" % 5 = 0
  UNION ALL SELECT 'ledger.consumer.ack.commit_failed', 'counter', 'topic=events,exception_class=DisconnectException', CAST(count(*) AS BIGINT) FROM rec WHERE "offset" % 70 = 0""")
def metric_failures(spark, sf):
    rows = _rec(spark, sf)
    publishes = rows.where("kind = 2").select("topic", F.expr("offset % 5 <> 0").alias("ok"), F.lit("java.util.concurrent.TimeoutException").alias("error_class"))
    commits = rows.select("topic", F.expr("offset % 70 <> 0").alias("ok"), F.lit("org.example.errors.DisconnectException").alias("error_class"))
    return metrics.failure_counters(publishes, commits)


@query(f"""WITH {ATT} SELECT topic, CAST(count(*) AS BIGINT) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS max_ms, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.99) AS p99 FROM att GROUP BY 1""")
def metric_timers(spark, sf):
    return metrics.timers(_att(spark, sf))


@query(f"""WITH {ATT} SELECT topic, b AS le_ms, CAST(count(*) FILTER (duration_ms <= b) AS BIGINT) AS n FROM att, (SELECT unnest([100, 500, 1000, 5000]::BIGINT[]) AS b) GROUP BY ALL""")
def metric_histogram(spark, sf):
    return metrics.histogram(_att(spark, sf), [100, 500, 1000, 5000])


@query(f"""WITH {SPANS} SELECT 'ledger.consumer.records.in_flight' AS name, "partition", CAST(arg_max(n, t_ms) AS BIGINT) AS last, CAST(max(n) AS BIGINT) AS most FROM fl GROUP BY 2""")
def metric_gauges(spark, sf):
    return pressure.in_flight(_spans(spark, sf), ["partition"]).groupBy("partition").agg(F.max_by("n", "t_ms").alias("last"), F.max("n").alias("most")).withColumn("name", F.lit("ledger.consumer.records.in_flight"))


@query(f"""WITH {ATT} SELECT topic, event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (failed) AS BIGINT) AS failed FROM att GROUP BY ROLLUP (topic, event_type)""")
def metric_rollup(spark, sf):
    return _att(spark, sf).rollup("topic", "event_type").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))


# Checks


@query("""WITH o AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY (turn * 7) % 5, turn) AS p FROM conversations)
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (turn < p) AS BIGINT) AS violations FROM o GROUP BY 1""")
def fifo_violations_by_key(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("observed", F.expr("(turn * 7) % 5"))
    return verify.order_violations(rows, ["conv_id"], "turn", "observed")


@query(f"""WITH {REC}, s AS (SELECT "partition", "offset", sum(duration_ms) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS end_ms FROM rec),
  l AS (SELECT *, "offset" < lag("offset") OVER (PARTITION BY "partition" ORDER BY end_ms, "offset") AS bad FROM s)
  SELECT "partition", CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (bad) AS BIGINT) AS violations FROM l GROUP BY 1""")
def fifo_violations_by_partition(spark, sf):
    return verify.order_violations(dispatch.schedule(_rec(spark, sf), Ordering.PARTITION), ["partition"], "offset", "end_ms")


@query(f"""WITH {ATT}, b AS (SELECT DISTINCT "offset" AS o FROM att WHERE decision IS NULL), c AS (SELECT DISTINCT "offset" AS o FROM att WHERE decision = 'exhausted'),
  j AS (SELECT r."offset" AS a, b.o AS b, c.o AS c FROM rec r FULL JOIN b ON r."offset" = b.o FULL JOIN c ON coalesce(r."offset", b.o) = c.o)
  SELECT CAST(count(a) AS BIGINT) AS produced, CAST(count(b) AS BIGINT) AS processed, CAST(count(c) AS BIGINT) AS dead,
    CAST(count(*) FILTER (a IS NOT NULL AND b IS NULL AND c IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (a IS NULL) AS BIGINT) AS unknown,
    CAST(count(*) FILTER (b IS NOT NULL AND c IS NOT NULL) AS BIGINT) AS "both" FROM j""")
def conservation_check(spark, sf):
    end = attempts.terminal_outcomes(_att(spark, sf), True)
    return verify.conservation(_rec(spark, sf), end.where("cause = 'handler'"), end.where("cause = 'dlq'"), ["topic", "partition", "offset"])


@query(f'WITH {REC} SELECT "offset" FROM rec WHERE kind = 2')
def dlq_exact_set(spark, sf):
    return attempts.terminal_outcomes(_att(spark, sf), True).where("cause = 'dlq'").select("offset")


@query(f"""WITH {ATT}, t AS (SELECT "offset", count(*) AS tries FROM att GROUP BY 1)
  SELECT CAST(count(*) AS BIGINT) AS short FROM att LEFT JOIN t USING ("offset") WHERE decision = 'exhausted' AND coalesce(tries, 0) < 3""")
def attempt_budget(spark, sf):
    att = _att(spark, sf)
    return verify.attempt_budget(att, attempts.terminal_outcomes(att, True).where("cause = 'dlq'"), 2, ["topic", "partition", "offset"]).agg(F.count("*").alias("short"))


@query(f'WITH {REC} SELECT CAST(count(*) AS BIGINT) AS split_keys FROM (SELECT topic, key FROM rec GROUP BY 1, 2 HAVING count(DISTINCT "partition") > 1)')
def key_partition_affinity(spark, sf):
    return verify.key_affinity(_rec(spark, sf)).agg(F.count("*").alias("split_keys"))


@query(f'WITH {ATT} SELECT CAST(count(*) AS BIGINT) AS invocations, CAST(count(DISTINCT "offset") AS BIGINT) AS distinct_records, CAST(count(*) - count(DISTINCT "offset") AS BIGINT) AS duplicates FROM att')
def redelivery_duplicates(spark, sf):
    return verify.redeliveries(_att(spark, sf), ["topic", "partition", "offset"])


# Extensions


@query("""SELECT epoch_us(ts) // 3600000000 * 3600000 AS window_ms, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def throughput_tumbling(spark, sf):
    return read_events(spark, sf).groupBy((F.floor(epoch_ms("ts") / 3_600_000) * 3_600_000).alias("window_ms"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT (epoch_us(ts) // 900000000 - k) * 900000 AS window_ms, CAST(count(*) AS BIGINT) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL""")
def throughput_sliding(spark, sf):
    w = F.window("ts", "1 hour", "15 minutes")["start"]
    return read_events(spark, sf).groupBy(w.alias("s")).agg(F.count("*").alias("n")).select(epoch_ms("s").alias("window_ms"), "n")


@query("""WITH o AS (SELECT user_id, epoch_us(ts) // 1000 AS t, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_id FROM events),
  g AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM o)
  SELECT user_id, min(t) AS start_ms, max(t) + 7200000 AS end_ms, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, s""")
def throughput_session(spark, sf):
    return sessions.sessions(read_events(spark, sf).withColumn("ts_ms", epoch_ms("ts")), ["user_id"], 7_200_000)


@query(f'WITH {REC} SELECT "offset", duration_ms FROM rec ORDER BY duration_ms DESC, "offset" LIMIT 20')
def slowest_records(spark, sf):
    return _rec(spark, sf).select("offset", "duration_ms").orderBy(F.desc("duration_ms"), "offset").limit(20)


@query(f"""WITH {REC} SELECT "offset", CASE WHEN duration_ms > 3000 THEN NULL WHEN kind = 2 THEN 'reject' ELSE 'accept' END AS outcome, CASE WHEN duration_ms > 3000 THEN 'ValueError: too slow' END AS error FROM rec""")
def pandas_handler(spark, sf):
    def handler(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["duration_ms"] > 3000).any():
            raise ValueError("too slow")
        return pd.DataFrame({"outcome": pdf["kind"].map(lambda k: "reject" if k == 2 else "accept"), "error": None})

    return handlers.apply_batches(_rec(spark, sf).select("offset", "duration_ms", "kind"), handler).select("offset", "outcome", "error")


@query(f"""WITH {REC} SELECT "offset", CASE WHEN kind = 2 THEN 'reject' ELSE 'accept' END AS outcome, CASE WHEN kind = 2 THEN 'always fails' END AS error FROM rec""")
def column_handler(spark, sf):
    bad = F.col("kind") == 2
    return handlers.apply_columns(_rec(spark, sf), F.when(bad, "reject").otherwise("accept"), F.when(bad, "always fails")).select("offset", "outcome", "error")


# Streams: the same ledger from a file stream


def _stream_folder(spark: SparkSession) -> str:
    """A folder of its own for a stream's tables, state and checkpoint."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="ledger-stream-") if not base else f"{base}/ledger-stream-{uuid.uuid4().hex[:12]}"


def _streamed(spark: SparkSession, sf: str, finished: F.Column | None = None) -> str:
    target = _stream_folder(spark)
    run_ledger(spark, f"{sf}/events.parquet*", target, POLICY, _fails(), finished=finished)
    return target


@query(ORACLE_SQL["attempt_ledger"])
def stream_ledger(spark, sf):
    return spark.read.parquet(f"{_streamed(spark, sf)}/attempts").select("offset", "attempt", "failed", "decision", "delay_ms")


@query(f"""WITH {REC}, p AS (SELECT *, min(done::INT) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING) = 1 AS prefix FROM rec)
  SELECT "partition", coalesce(max(CASE WHEN prefix THEN "offset" + 1 END), min("offset")) AS position, CAST(count(*) FILTER (done AND NOT prefix) AS INT) AS parked FROM p GROUP BY 1""")
def stream_frontier(spark, sf):
    """Positions kept in state from the ledger's completion log; each partition's last row is where it stands."""
    target = _streamed(spark, sf, finished=F.pmod("offset", F.lit(997)) != 996)
    run_positions(spark, target)
    return spark.read.parquet(f"{target}/positions").groupBy("partition").agg(F.max("position").alias("position"), F.max_by("parked", "position").alias("parked"))


#: Records in five runs of offsets; run s is delivered at step s, finished (where done) at step s + 1, and its multiples of 5 are delivered again at step s + 2.
STEPS = REC + """, b AS (SELECT min("offset") AS lo, max("offset") - min("offset") + 1 AS n FROM rec), st AS (SELECT rec.*, ("offset" - lo) * 5 // n AS run FROM rec, b)"""


@query(f"""WITH {STEPS}, s AS (SELECT unnest(range(0, 7)) AS step), p AS (SELECT "partition", step, "offset", done AND run < step AS ok FROM st, s WHERE run <= step),
  w AS (SELECT *, min(ok::INT) OVER (PARTITION BY "partition", step ORDER BY "offset" ROWS UNBOUNDED PRECEDING) = 1 AS prefix FROM p),
  a AS (SELECT "partition", step, coalesce(max(CASE WHEN prefix THEN "offset" + 1 END), min("offset")) AS position, CAST(count(*) FILTER (ok AND NOT prefix) AS INT) AS parked FROM w GROUP BY 1, 2),
  m AS (SELECT *, lag(position) OVER (PARTITION BY "partition" ORDER BY step) AS was FROM a)
  SELECT "partition", position, parked FROM m WHERE position IS DISTINCT FROM was""")
def stream_positions(spark, sf):
    """Every move of a position over seven files, read one a batch in two runs: the second goes on from the first one's state."""
    target = _stream_folder(spark)
    rows = _done(spark, sf).select("topic", "partition", "offset", "done")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.min("offset").alias("lo"), (F.max("offset") - F.min("offset") + 1).alias("n")))).withColumn("run", F.expr("(offset - lo) * 5 div n"))
    place = ("topic", "partition", "offset")
    for step in range(7):
        part = rows.where(F.col("run") == step).select(*place, F.lit("observe").alias("kind"))
        part = part.unionByName(rows.where((F.col("run") == step - 1) & F.col("done")).select(*place, F.lit("done").alias("kind")))
        part = part.unionByName(rows.where((F.col("run") == step - 2) & (F.col("offset") % 5 == 0)).select(*place, F.lit("observe").alias("kind")))
        part.coalesce(1).write.mode("append").parquet(f"{target}/completions")
        if step in (2, 6):
            run_positions(spark, target, 1)
    return spark.read.parquet(f"{target}/positions").select("partition", "position", "parked")


@query(f"""WITH {REC} SELECT "offset", topic || '.DLT' AS dlq_topic, hex(encode(value)) AS value_hex, CAST("partition" AS VARCHAR) AS part, CAST(greatest(2, delivery_count - 1) AS VARCHAR) AS attempts FROM rec WHERE kind = 2""")
def stream_dead_letters(spark, sf):
    h = lambda n: decode.header_last(F.col("headers"), LETTERS.prefix + n).cast("string")
    return spark.read.parquet(f"{_streamed(spark, sf)}/dead_letters").select("offset", "dlq_topic", F.hex("value").alias("value_hex"), h("original-partition").alias("part"), h("attempt-count").alias("attempts"))


@query(ORACLE_SQL["terminal_outcomes"])
def stream_metrics(spark, sf):
    return spark.read.parquet(f"{_streamed(spark, sf)}/acks").groupBy("cause", "outcome").agg(F.count("*").alias("n"), F.sum("attempt").alias("retries"))


def check_names() -> None:
    """Every query's SQL belongs to a query."""
    assert ORACLE_SQL.keys() <= QUERIES.keys()
