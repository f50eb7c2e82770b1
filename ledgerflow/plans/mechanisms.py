"""More queries over the driver's tables: commit results, manual acknowledgements, delayed retries, meters, settings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ledgerflow.config import RetryPolicy
from ledgerflow.functions import decode, retry
from ledgerflow.operators import acks, attempts, barrier, dispatch, frontier, handlers, metrics, pressure, verify
from ledgerflow.plans.catalog import ADAPTIVE, ATT, REC, SPANS, TP, _att, _rec, _spans, query

PLACE = ("topic", "partition", "offset")


# Decoding


@query(f"""WITH {REC}, p AS (SELECT "offset" % 50 AS m, CAST(nullif(regexp_extract(value, ': ([0-9]+)', 1), '') AS BIGINT) AS k FROM rec)
  SELECT CASE WHEN m = 0 THEN 'reject' ELSE 'decoded' END AS outcome, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (m > 2 AND k IS NOT NULL) AS BIGINT) AS with_k FROM p GROUP BY 1""")
def poison_null_payload(spark, sf):
    """Malformed values are poison; a legal null field and a null value aren't."""
    m = F.pmod("offset", F.lit(50))
    value = F.when(m == 0, F.lit('{"k": 1').cast("binary")).when(m == 1, F.lit('{"k": null}').cast("binary")).when(m == 2, F.lit(None).cast("binary")).otherwise(F.col("value"))
    good, bad = decode.split_poison(_rec(spark, sf).withColumn("value", value), decode.json_payload(decode.utf8(F.col("value")), "k bigint"))
    one = good.agg(F.count("*").alias("n"), F.count("payload.k").alias("with_k")).withColumn("outcome", F.lit("decoded"))
    return one.unionByName(bad.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("with_k", F.lit(0).cast("bigint")))


@query(f"""WITH {REC}, b AS (SELECT "offset" // 16 AS batch, max(CASE WHEN "offset" % 100 = 3 THEN 1 ELSE 0 END) AS bad, count(*) AS n FROM rec GROUP BY 1)
  SELECT CAST(count(*) FILTER (bad = 1) AS BIGINT) AS corrupt_batches, CAST(sum(CASE WHEN bad = 0 THEN n ELSE 0 END) AS BIGINT) AS records FROM b""")
def corrupt_batches(spark, sf):
    rows = _rec(spark, sf).withColumn("batch", F.expr("offset div 16"))
    good, bad = decode.split_corrupt_batches(rows, ["batch"], F.col("offset") % 100 == 3)
    return bad.where("cause = 'corrupt_batch'").agg(F.count("*").alias("corrupt_batches")).crossJoin(good.agg(F.count("*").alias("records")))


@query(f"""WITH {REC}, a AS (SELECT rec.*, i FROM rec, (SELECT unnest([0, 1, 2]) AS i) WHERE i = 0 OR "offset" % 20 = 7)
  SELECT "offset", CAST(i AS INT) AS attempt, CASE WHEN "offset" % 20 = 7 THEN 'DecodeError' END AS error_class, CASE WHEN "offset" % 20 <> 7 THEN NULL WHEN i = 2 THEN 'exhausted' ELSE 'inline' END AS decision FROM a""")
def decode_error_retry(spark, sf):
    """A decoder chosen by topic; what it can't read goes to retry and at last to the dead letters, not to the poison path."""
    rows = _rec(spark, sf).withColumn("value", F.when(F.col("offset") % 20 == 7, F.lit("{").cast("binary")).otherwise(F.col("value")))
    decoded = decode.decode_by_topic(rows, {"events": lambda v: decode.json_payload(decode.utf8(v), "k bigint"), "other": lambda v: F.struct(F.lit(False).alias("ok"), F.lit(None).cast("struct<k:bigint>").alias("payload"))})
    tried = attempts.expand_attempts(decoded, RetryPolicy(2, 20, 1.5, 0.0), F.when(F.col("error_class").isNull(), 0), F.col("error_class"))
    return tried.select("offset", "attempt", "error_class", "decision")


# Acknowledgements and commits


@query(f"""WITH {REC}, q AS (SELECT "offset" // 64 AS drain, "offset" AS seq, CASE WHEN "offset" % 200 = 130 THEN 'org.example.AuthorizationException' WHEN "offset" % 9 = 4 THEN 'org.example.DisconnectException' END AS e FROM rec),
  s AS (SELECT *, min(CASE WHEN e LIKE '%Authorization%' THEN seq END) OVER (PARTITION BY drain) AS stop FROM q)
  SELECT seq, CASE WHEN seq > stop THEN 'unsent' WHEN seq = stop THEN 'fatal' WHEN e IS NOT NULL THEN 'contained' ELSE 'applied' END AS state FROM s""")
def ack_commit_states(spark, sf):
    error = F.when(F.col("offset") % 200 == 130, "org.example.AuthorizationException").when(F.col("offset") % 9 == 4, "org.example.DisconnectException")
    queued = _rec(spark, sf).select(F.expr("offset div 64").alias("drain"), F.col("offset").alias("seq"), error.alias("error_class"))
    return acks.commit_acks(queued).select("seq", "state")


#: Each record: a forced release, an accept whose commit (of 100 offsets) may fail, and a forced release of the slow ones.
_COMMITTED = REC + """, ok AS (SELECT DISTINCT "partition", "offset" // 100 AS c, ("offset" // 100) % 3 <> 1 AS ok FROM rec)"""


@query(f"""WITH {_COMMITTED} SELECT r."offset", CAST(CASE WHEN o.ok THEN 0 ELSE 1 END + CASE WHEN kind = 3 THEN 1 ELSE 0 END AS BIGINT) AS slowness,
  CAST(greatest(0, delivery_count - 1 - (CASE WHEN o.ok THEN 0 ELSE 1 END + CASE WHEN kind = 3 THEN 1 ELSE 0 END)) AS INT) AS effective FROM rec r JOIN ok o ON r."partition" = o."partition" AND r."offset" // 100 = o.c""")
def slowness_after_failed_commit(spark, sf):
    """Marks go with a successful commit only; while it failed, forced releases still don't count against the budget."""
    rows = _rec(spark, sf)
    one = lambda seq, outcome, cause: rows.select(*PLACE, "kind", F.expr("offset div 100").alias("commit"), F.lit(seq).cast("bigint").alias("seq"), F.lit(outcome).alias("outcome"), F.lit(cause).alias("cause"))
    all_ = one(1, "release", "slowness").unionByName(one(2, "accept", "handler")).unionByName(one(3, "release", "slowness").where("kind = 3")).drop("kind")
    commits = rows.select("topic", "partition", F.expr("offset div 100").alias("commit")).distinct().withColumn("ok", F.col("commit") % 3 != 1)
    slow = acks.slowness(acks.commit_results(all_, commits))
    both = rows.join(slow, list(PLACE), "left")
    return both.select("offset", "slowness", retry.effective_attempt(F.lit(0), F.col("delivery_count"), F.col("slowness")).cast("int").alias("effective"))


@query(f"""WITH {_COMMITTED} SELECT 'ledger.consumer.ack.commit_failed' AS name, 'counter' AS kind, 'topic=events,exception_class=TimeoutException' AS tags, CAST(count(*) AS BIGINT) AS value FROM ok WHERE NOT ok""")
def commit_callback_failures(spark, sf):
    """One failure metric per partition and failed commit."""
    commits = _rec(spark, sf).select("topic", "partition", F.expr("offset div 100").alias("commit")).distinct().withColumn("ok", F.col("commit") % 3 != 1).withColumn("error_class", F.lit("org.example.TimeoutException"))
    return metrics.failure_counters(commits.limit(0), commits)


@query(f"""WITH {ATT}, s AS (SELECT *, ts_ms + attempt * duration_ms + CASE attempt WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE 50 END AS started FROM att)
  SELECT "offset", attempt FROM s WHERE "offset" % 3 <> 0 OR started <= ts_ms + duration_ms + 10""")
def skip_if_acked(spark, sf):
    """No further try once a terminal acknowledgement has come during the back-off."""
    waits = F.when(F.col("attempt") == 0, 0).when(F.col("attempt") == 1, 20).otherwise(50)
    tried = _att(spark, sf).withColumn("started_ms", F.col("ts_ms") + F.col("attempt") * F.col("duration_ms") + waits)
    acked = _rec(spark, sf).where("offset % 3 = 0").select(*PLACE, (F.col("ts_ms") + F.col("duration_ms") + 10).alias("at_ms"))
    return acks.not_yet_acked(tried, acked).select("offset", "attempt")


@query(f"""WITH {REC} SELECT "offset", CASE kind WHEN 0 THEN 'accept' WHEN 1 THEN 'retry' WHEN 2 THEN 'reject' ELSE 'release' END AS outcome, CASE kind WHEN 1 THEN 'ValueError: no' END AS error FROM rec""")
def manual_ack_columns(spark, sf):
    """kind 0 accepts, 1 throws, 2 rejects and then throws, 3 returns without a word."""
    kind = F.col("kind")
    out = handlers.apply_manual_columns(_rec(spark, sf), F.when(kind == 0, "ACCEPT").when(kind == 2, "REJECT"), F.when(kind.isin(1, 2), "ValueError: no"))
    return out.select("offset", "outcome", "error")


@query(f"""WITH {REC} SELECT "offset", CASE WHEN duration_ms > 4000 THEN 'retry' WHEN kind = 2 THEN 'reject' WHEN kind = 3 THEN 'release' ELSE 'accept' END AS outcome FROM rec""")
def manual_ack_batches(spark, sf):
    def handler(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["duration_ms"] > 4000).any():
            raise ValueError("too slow")
        return pd.DataFrame({"outcome": pdf["kind"].map({0: "ACCEPT", 1: "accept", 2: "Reject", 3: None}), "error": None})

    return handlers.apply_manual_batches(_rec(spark, sf).select("offset", "duration_ms", "kind"), handler).select("offset", "outcome")


@query(f"""WITH {REC}, c AS (SELECT "partition", "offset" // 50 AS seq, max("offset") AS position, ("offset" // 50) % 3 <> 1 AS ok FROM rec GROUP BY "partition", "offset" // 50)
  SELECT "partition", seq, max(CASE WHEN ok THEN position END) OVER w AS committed,
    CASE WHEN max(CASE WHEN NOT ok THEN position END) OVER w > coalesce(max(CASE WHEN ok THEN position END) OVER w, -1) THEN max(CASE WHEN NOT ok THEN position END) OVER w END AS buffered
  FROM c WINDOW w AS (PARTITION BY "partition" ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def commit_snapshots(spark, sf):
    """What is committed and what waits to be retried after each commit."""
    commits = _rec(spark, sf).groupBy("topic", "partition", F.expr("offset div 50").alias("seq")).agg(F.max("offset").alias("position")).withColumn("ok", F.col("seq") % 3 != 1)
    return frontier.high_water_history(commits).select("partition", "seq", "committed", "buffered")


# Retry


@query(f"""WITH {REC} SELECT "offset", CAST(delivery_count + 1 AS INT) AS delivery_count, CAST(0 AS INT) AS attempt, 'release' AS outcome FROM rec WHERE kind IN (1, 2)
  UNION ALL SELECT "offset", CAST(delivery_count + 1 AS INT), 0, 'release' FROM rec WHERE kind = 2""")
def delayed_share_redelivery(spark, sf):
    """Delays above the inline limit: each delayed try is a release and a next delivery."""
    tried = attempts.expand_attempts(_rec(spark, sf), RetryPolicy(2, 2000, 1.0, 0.0), F.when(F.col("kind") == 1, 1).when(F.col("kind") == 2, F.lit(None)).otherwise(0))
    return attempts.next_deliveries(tried).select("offset", "delivery_count", "attempt", "outcome")


@query(f"""WITH {REC} SELECT CASE WHEN kind IN (1, 2) THEN 'reject' ELSE 'accept' END AS outcome, CASE WHEN kind IN (1, 2) THEN 'retry' ELSE 'handler' END AS cause, CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY ALL""")
def reject_without_retry(spark, sf):
    tried = attempts.expand_attempts(_rec(spark, sf), RetryPolicy.none(), F.when(F.col("kind").isin(1, 2), F.lit(None)).otherwise(0))
    return attempts.terminal_outcomes(tried, True).groupBy("outcome", "cause").agg(F.count("*").alias("n"))


@query(f"""WITH {REC} SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS outside, true AS spread FROM rec""")
def jitter_bounds(spark, sf):
    """Delays times a factor in [0.5, 1.5): none outside, and not all alike."""
    got = _rec(spark, sf).select((F.col("duration_ms") + 2).alias("d"), retry.jittered_ms(F.col("duration_ms") + 2, 0.5, 3).alias("j"))
    return got.agg(F.count("*").alias("n"), F.count_if((F.col("j") < F.floor(F.col("d") / 2)) | (F.col("j") >= F.col("d") * 1.5)).alias("outside"), (F.count_distinct(F.col("j") - F.col("d")) > 10).alias("spread"))


@query(f"""WITH {REC} SELECT "offset", CASE WHEN event_type LIKE 'p%' OR kind = 2 THEN 'inline' ELSE 'reject' END AS decision FROM rec""")
def classifier_override(spark, sf):
    """A classifier decides by record and error; the class list isn't asked."""
    policy = RetryPolicy(3, 100, 2.0, 0.0, retriable=("NeverSeen",))
    own = F.col("event_type").startswith("p") | (F.col("kind") == 2)
    return _rec(spark, sf).select("offset", retry.decision(policy, F.lit(0), retry.is_retriable(policy, F.lit("IOError"), own)).alias("decision"))


@query(f"""WITH {ATT} SELECT "partition", CAST(sum(duration_ms + delay_ms) AS BIGINT) AS lane_ms FROM att GROUP BY 1""")
def delayed_lane_time(spark, sf):
    """Classic: a partition's lane is busy with every try and every wait of its records."""
    return attempts.blocked_ms(_att(spark, sf)).groupBy("partition").agg(F.sum("blocked_ms").alias("lane_ms"))


# Pressure and meters


@query(f"""WITH {SPANS} SELECT CAST(count(*) FILTER (n > 12) AS BIGINT) AS over FROM fl""")
def concurrency_bound(spark, sf):
    return verify.over_limit(pressure.in_flight(_spans(spark, sf), ["partition"]), 12).agg(F.count("*").alias("over"))


@query(f"""WITH {REC}, ep AS (SELECT *, ts_ms // 86400000 % 2 AS epoch, duration_ms // 400 AS n FROM rec), h AS (SELECT "partition", epoch, ts_ms AS s, ts_ms + 600000 AS e FROM ep WHERE kind = 2),
  k AS (SELECT "partition", epoch, ts_ms, n, max("offset") AS o FROM ep GROUP BY ALL), u AS (SELECT "partition", epoch, ts_ms, max(n) AS n FROM k GROUP BY 1, 2, 3),
  g AS (SELECT *, CASE WHEN n >= 8 THEN true WHEN n <= 4 THEN false END AS sig FROM u),
  p AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY "partition", epoch ORDER BY ts_ms ROWS UNBOUNDED PRECEDING), false) AS paused FROM g),
  x AS (SELECT p."partition", p.epoch, p.ts_ms, p.paused, coalesce(max(h.e) > p.ts_ms, false) AS held FROM p LEFT JOIN h ON h."partition" = p."partition" AND h.epoch = p.epoch AND h.s <= p.ts_ms GROUP BY p."partition", p.epoch, p.ts_ms, p.paused)
  SELECT "partition", epoch, CAST(count(*) FILTER (paused) AS BIGINT) AS paused, CAST(count(*) FILTER (held) AS BIGINT) AS held, CAST(count(*) FILTER (held OR paused) AS BIGINT) AS stopped FROM x GROUP BY 1, 2""")
def pause_with_holds(spark, sf):
    """Ticks per partition and epoch stopped by backpressure, by a failed publish, or by either."""
    rows = _rec(spark, sf).withColumn("epoch", F.expr("ts_ms div 86400000 % 2")).withColumn("n", F.expr("duration_ms div 400"))
    keys = ["partition", "epoch"]
    ticks = pressure.hysteresis(rows.groupBy(*keys, "ts_ms").agg(F.max("n").alias("n")), keys, 8, "ts_ms")
    spans = pressure.pause_spans(rows.where("kind = 2").select(*keys, F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 600_000).alias("end_ms")), keys)
    both = pressure.paused_by_both(ticks, spans, keys, "ts_ms")
    return both.groupBy(*keys).agg(F.count_if("paused").alias("paused"), F.count_if("held").alias("held"), F.count_if("stopped").alias("stopped"))


@query(f"""WITH {REC}, s AS (SELECT "partition", "offset", duration_ms // 400 AS n FROM rec), g AS (SELECT *, CASE WHEN n >= 8 THEN true WHEN n <= 4 THEN false END AS sig FROM s),
  p AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING), false) AS paused FROM g),
  e AS (SELECT *, coalesce(lag(paused) OVER (PARTITION BY "partition" ORDER BY "offset"), false) AS was FROM p)
  SELECT 'ledger.consumer.backpressure.events' AS name, 'counter' AS kind, 'topic=events,event=' || CASE WHEN paused THEN 'paused' ELSE 'resumed' END AS tags, CAST(count(*) AS BIGINT) AS value FROM e WHERE paused <> was GROUP BY 3""")
def metric_backpressure(spark, sf):
    ticks = _rec(spark, sf).withColumn("n", F.expr("duration_ms div 400"))
    return metrics.backpressure_events(pressure.hysteresis(ticks, list(TP), 8, "offset"))


@query(f"""WITH {REC}, l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY "offset" DESC) AS n FROM rec WHERE kind <> 2)
  SELECT 'ledger.consumer.barrier.timeout' AS name, 'gauge' AS kind, 'event_type=' || event_type AS tags, CAST(CASE WHEN count(*) < 100 THEN 24000 ELSE least(24000, greatest(1000, ceil(quantile_disc(duration_ms, 0.5) * 3.0))) END AS DOUBLE) AS value FROM l WHERE n <= 1024 GROUP BY event_type""")
def metric_barrier(spark, sf):
    return metrics.barrier_gauges(barrier.adaptive_barrier(_rec(spark, sf).where("kind <> 2"), ["event_type"], ADAPTIVE), "event_type")


@query(f"""WITH {REC}, c AS (SELECT "partition", "offset" // 100 AS k, ("offset" // 100) % 3 <> 1 AS ok FROM rec GROUP BY ALL)
  SELECT 'ledger.consumer.ack.committed' AS name, 'counter' AS kind, 'topic=events,type=accept' AS tags, CAST(count(*) FILTER (ok) AS BIGINT) AS value FROM c""")
def metric_classic_commits(spark, sf):
    """The classic engine counts one accept per partition and successful commit."""
    commits = _rec(spark, sf).select("topic", "partition", F.expr("offset div 100").alias("commit")).distinct().where("commit % 3 <> 1")
    return metrics.counter(commits, "ack.committed", topic=F.col("topic"), type=F.lit("accept"))


@query(f"""WITH {REC} SELECT "offset", kind <> 2 AND epoch = 1 AS completes FROM (SELECT *, CASE WHEN "offset" % 4 = 3 THEN 0 ELSE 1 END AS epoch FROM rec)""")
def unordered_classic_completions(spark, sf):
    """Classic unordered delivery: a record completes only if its epoch is still owned and its handler didn't throw."""
    rows = _rec(spark, sf).withColumn("epoch", F.when(F.col("offset") % 4 == 3, 0).otherwise(1).cast("bigint"))
    own = rows.select("topic", "partition").distinct().withColumn("epoch", F.lit(1).cast("bigint"))
    return dispatch.completions(rows, own, F.col("kind") == 2).select("offset", "completes")


@query(f"""WITH {REC}, c AS (SELECT "offset", 1 + "offset" % 60 AS concurrency, CASE WHEN kind = 0 THEN NULL ELSE kind * 8 END AS shards FROM rec)
  SELECT "offset", CAST(coalesce(shards, concurrency * 4) AS BIGINT) AS shards FROM c""")
def shard_defaults(spark, sf):
    """Every record as a setting of its own: unset shards are four times the concurrency."""
    rows = _rec(spark, sf).select("offset", (1 + F.col("offset") % 60).alias("concurrency"), F.when(F.col("kind") > 0, F.col("kind") * 8).alias("shards"))
    return rows.select("offset", dispatch.shard_count(F.col("shards"), F.col("concurrency")).cast("bigint").alias("shards"))
