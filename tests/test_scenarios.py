"""Scenarios of delivery, the stateful positions, blocked folds of hot lanes, meters and settings."""

import collections
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerflow.config import DeadLetterConfig, DeliveryConfig, Engine, Ordering, RetryPolicy
from ledgerflow.operators import acks, attempts, dispatch, frontier, handlers, pressure, verify
from ledgerflow.operators.metrics import Meters, RecordingMeters
from ledgerflow.operators.running import previous, running_last
from ledgerflow.sources.records import records_in_memory
from ledgerflow.streaming.frontier import advance
from ledgerflow.streaming.pipeline import Lifecycle, run_ledger, run_positions

POLICY = RetryPolicy(2, 20, 1.5, 0.0)


def drains(*steps):
    """Positions that each (delivered, completed) step emits, and how many completions are parked at the end."""
    position, pending, done, emitted, out = None, [], set(), None, []
    for delivered, completed in steps:
        position, pending, done = advance(position, pending, done, delivered, completed)
        out.append(position if position != emitted else None)
        emitted = position
    return out, len(done)


@pytest.mark.parametrize(
    ("steps", "want", "parked"),
    [
        ([([10, 11, 12], []), ([], []), ([], [10]), ([], [11, 12])], [10, None, 11, 13], 0),
        ([([0, 1, 2], [1, 2]), ([], [0])], [0, 3], 0),
        ([(range(6), [0, 1, 3, 4, 5])], [2], 3),
        ([(range(6), [0, 1, 3, 4, 5]), ([], [2])], [2, 6], 0),
        ([([100, 101], []), ([], [101]), ([], [100]), ([], [])], [100, None, 102, None], 0),
        ([([0, 1], [0, 1]), ([], [0])], [2, None], 0),
        ([([50, 60], []), ([100], [50])], [50, 51], 0),
        ([([], [42])], [43], 0),
        ([([], [42, 43, 45])], [44], 1),
        ([([5, 7], []), ([], [7]), ([], [5])], [5, None, 8], 0),
        ([([10, 12, 15], []), ([], [15, 10]), ([], [12])], [10, 11, 16], 0),
        ([(range(10), range(10)), ([3], []), ([3], [3])], [10, None, None], 0),
        ([(range(4), [0, 1]), ([1, 2], [1]), ([4], [2, 3, 4])], [2, None, 5], 0),
        ([([], [])], [None], 0),
    ],
)
def test_positions_step_by_step(steps, want, parked):
    assert drains(*steps) == (want, parked)


def test_positions_never_fall():
    rng = random.Random(3)
    for _ in range(300):
        position, pending, done, last, live = None, [], set(), -1, []
        nxt = rng.randrange(50)
        for _ in range(20):
            fresh = list(range(nxt, nxt + rng.randrange(5), rng.choice([1, 2])))
            nxt = max([nxt, *(o + 1 for o in fresh)])
            live += fresh
            again = [o for o in range(max(nxt - 9, 0), nxt) if rng.random() < 0.2]
            ended = [o for o in live if rng.random() < 0.4]
            position, pending, done = advance(position, pending, done, fresh + [o for o in again if o in live], ended)
            assert position is None or position >= last
            assert all(o >= position for o in pending) and all(o > position for o in done)
            last = -1 if position is None else position


def test_ledger_stream_keeps_positions_and_dead_letters_over_restarts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    fails = F.when(F.col("kind") == 2, F.lit(None)).when(F.col("kind") == 1, 1).otherwise(0)
    seen = []
    for low, high in ((0, 300), (300, 700), (700, 10**9), (0, 0)):
        part = events.where((F.col("event_id") >= low) & (F.col("event_id") < high))
        if high:
            part.coalesce(1).write.mode("append").parquet(source)
        run_ledger(spark, source, target, POLICY, fails, letters=DeadLetterConfig(suffix=".dead"), finished=F.col("offset") != 450)
        run_positions(spark, target)
        seen.append({r.partition: r.position for r in spark.read.parquet(f"{target}/positions").groupBy("partition").agg(F.max("position").alias("position")).collect()})
    for before, after in zip(seen, seen[1:]):
        assert all(after[p] >= before[p] for p in before)
    assert seen[-1] == seen[-2]
    #: The partition that holds 450 stops there; every other one is past its last record.
    last = {r.partition: r.last for r in events.groupBy(F.pmod("user_id", F.lit(4)).cast("int").alias("partition")).agg(F.max("event_id").alias("last")).collect()}
    stuck = events.where("event_id = 450").select(F.pmod("user_id", F.lit(4))).first()[0]
    assert all(seen[-1][p] == last[p] + 1 for p in last if p != stuck) and seen[-1][stuck] <= 450
    dead = spark.read.parquet(f"{target}/dead_letters")
    assert {r.offset for r in dead.collect()} == {r.event_id for r in events.where("event_id % 4 = 2").collect()} and dead.count() == dead.select("offset").distinct().count()
    assert {r.dlq_topic for r in dead.collect()} == {"events.dead"}


# Scenarios


def test_classic_records_are_conserved(spark):
    rows = records_in_memory(spark, [{"offset": n, "partition": n % 4, "key": f"k{n}".encode(), "value": f"v{n}".encode()} for n in range(200)])
    tried = attempts.expand_attempts(rows, POLICY, F.when(F.col("offset") % 4 == 1, 1).when(F.col("offset") % 4 == 2, F.lit(None)).otherwise(0))
    end = attempts.terminal_outcomes(tried, True)
    dead = end.where("cause = 'dlq'")
    assert {r.offset for r in dead.collect()} == {n for n in range(200) if n % 4 == 2}
    assert verify.attempt_budget(tried, dead, 2, ["topic", "partition", "offset"]).count() == 0
    assert tuple(verify.conservation(rows, end.where("cause = 'handler'"), dead, ["topic", "partition", "offset"]).first()) == (200, 150, 50, 0, 0, 0)


def test_share_records_are_conserved(spark):
    rows = records_in_memory(spark, [{"offset": n} for n in range(100)])
    end = attempts.terminal_outcomes(attempts.expand_attempts(rows, POLICY, F.when(F.col("offset") % 3 == 1, 1).when(F.col("offset") % 3 == 2, F.lit(None)).otherwise(0)), True)
    assert {r.offset for r in end.where("cause = 'dlq'").collect()} == {n for n in range(100) if n % 3 == 2} and end.count() == 100


def test_retry_storm(spark):
    rows = records_in_memory(spark, [{"offset": k * 100 + s, "key": f"k{k}".encode(), "value": str(s).encode()} for k in range(50) for s in range(100)])
    seq = F.col("offset") % 100
    fails = sum((F.when(seq % n == 0, 1).otherwise(0) for n in (3, 7, 11)), F.lit(0))
    tried = attempts.expand_attempts(rows, RetryPolicy(5, 20, 1.5, 0.0), fails)
    assert tried.where("failed").count() == 2950 and attempts.terminal_outcomes(tried, True).where("cause = 'handler'").count() == 5000


def test_hot_key_runs_in_order_on_one_lane(spark):
    keys = ["HOT"] * 200 + [f"k{i}" for i in range(30) for _ in range(5)]
    random.Random(1).shuffle(keys)
    rows = records_in_memory(spark, [{"offset": i, "key": k.encode()} for i, k in enumerate(keys)]).withColumn("duration_ms", F.lit(100).cast("bigint"))
    lanes = dispatch.schedule(rows, Ordering.KEY)
    assert verify.order_violations(lanes.withColumn("k", F.col("key").cast("string")), ["k"], "offset", "end_ms").where("violations > 0").count() == 0
    assert lanes.where("cast(key as string) = 'HOT'").select("shard").distinct().count() == 1
    #: Lanes run at once, so the whole takes as long as the fullest lane, and the hot key's 200 records are in one.
    assert lanes.agg(F.max("end_ms")).first()[0] >= 20_000


def test_a_blocked_offset_holds_its_partition(spark):
    rows = records_in_memory(spark, [{"offset": o, "key": f"k{o}".encode()} for o in range(32)]).withColumn("done", F.col("offset") > 0)
    assert tuple(frontier.commit_positions(rows).select("position", "parked").first()) == (0, 31)
    assert drains((range(32), range(1, 32))) == ([0], 31)


def test_slowness_doesnt_use_up_the_budget(spark):
    acked = spark.createDataFrame([("t", 0, 1, 1, "release", "slowness", None), ("t", 0, 2, 1, "release", "slowness", None), ("t", 0, 2, 2, "accept", "handler", False), ("t", 0, 3, 1, "release", "slowness", None), ("t", 0, 3, 2, "accept", "handler", True)], "topic string, partition int, offset long, seq long, outcome string, cause string, ok boolean")
    assert {r.offset: r.slowness for r in acks.slowness(acked).collect()} == {1: 1, 2: 1, 3: 0}


def test_handlers_halve_a_failing_batch(spark):
    calls = spark.sparkContext.accumulator(0)

    def handler(pdf: pd.DataFrame) -> pd.DataFrame:
        calls.add(1)
        if (pdf["x"] == 700).any():
            raise ValueError("no")
        return pd.DataFrame({"outcome": ["accept"] * len(pdf), "error": None})

    got = handlers.apply_batches(spark.range(1000).select(F.col("id").alias("x")).coalesce(1), handler).collect()
    assert collections.Counter(r.error for r in got) == {None: 999, "ValueError: no": 1} and calls.value <= 25


# Folds


def test_blocked_last_and_previous_equal_one_window(spark):
    rng = random.Random(9)
    rows = [(k, o, rng.choice([None, True, False]), o * 7 % 13) for k in "ab" for o in rng.sample(range(-30, 200), 80)]
    df = spark.createDataFrame(rows, "k string, o long, v boolean, w long")
    for block in (1, 8, 1 << 17):
        got = {(r.k, r.o): (r.running, r.before) for r in running_last(df, ["k"], "o", "v", block).collect()}
        prev = {(r.k, r.o): r.before for r in previous(df, ["k"], ["o"], "w", block).collect()}
        for k in "ab":
            last, before = None, None
            for _, o, v, w in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
                was, last = last, last if v is None else v
                assert got[k, o] == (last, was) and prev[k, o] == before
                before = w


def test_pause_spans_and_holds(spark):
    holds = spark.createDataFrame([("a", 0, 10), ("a", 0, 4), ("a", 5, 12), ("a", 12, 15), ("a", 20, 21), ("a", 21, 22), ("b", 3, 3)], "k string, start_ms long, end_ms long")
    spans = pressure.pause_spans(holds, ["k"])
    assert sorted((r.k, r.start_ms, r.end_ms, r.holds) for r in spans.collect()) == [("a", 0, 15, 4), ("a", 20, 22, 2), ("b", 3, 3, 1)]
    ticks = spark.createDataFrame([("a", t, t == 16) for t in (-1, 0, 14, 15, 16, 20, 23)] + [("c", 1, False)], "k string, t long, paused boolean")
    got = {(r.k, r.t): (r.held, r.stopped) for r in pressure.paused_by_both(ticks, spans, ["k"], "t").collect()}
    assert [got["a", t] for t in (-1, 0, 14, 15, 16, 20, 23)] == [(False, False), (True, True), (True, True), (False, False), (False, True), (True, True), (False, False)]
    assert got["c", 1] == (False, False)


def test_a_hot_lane_of_a_million_rows(spark):
    rows = spark.range(1_000_000).select(F.lit("k").alias("k"), F.col("id").alias("started_ms"), F.col("id").alias("delivery_seq"), F.lit(3).cast("long").alias("duration_ms"))
    assert acks.mark_duplicates(rows, ["k"]).where("not duplicate").count() == 333_334
    ticks = spark.range(1_000_000).select(F.lit("k").alias("k"), F.col("id").alias("tick"), (F.col("id") % 12).alias("n"))
    events = pressure.hysteresis(ticks, ["k"], 10).where("event is not null").groupBy("event").count()
    assert {r.event: r["count"] for r in events.collect()} == {"paused": 83_333, "resumed": 83_333}


# Meters and settings


def test_meters_of_a_query():
    class Progress:
        batchId, numInputRows, durationMs = 3, 40, {"triggerExecution": 12}

    class Event:
        progress, exception = Progress, None

    sink = RecordingMeters(users=2)
    one, two = Lifecycle(meters=sink), Lifecycle(meters=sink)
    for life in (one, two):
        life.onQueryStarted(Event())
        life.onQueryProgress(Event())
    assert sink.timers == {("ledger.consumer.poll.duration",): [12, 12]} and sink.counters == {("ledger.consumer.records.polled",): 80}
    one.onQueryTerminated(Event())
    assert sink.gauges == {("ledger.consumer.records.in_flight",): 40}
    two.onQueryTerminated(Event())
    two.onQueryTerminated(Event())
    assert sink.gauges == {} and sink.counters
    Meters().timer("nothing", 1)


def test_settings_from_text():
    c = DeliveryConfig.from_settings({"ledger.topic": "t", "ledger.engine": "CLASSIC", "ledger.ordering": "key", "ledger.concurrency": "7", "ledger.retry.max-attempts": "5", "ledger.retry.retriable": "A, B", "ledger.properties.group.id": "g", "ledger.properties.bootstrap.servers": "h:1", "other.x": "y"})
    assert (c.engine, c.ordering, c.shard_count, c.retry.max_attempts, c.retry.retriable) == (Engine.CLASSIC, Ordering.KEY, 28, 5, ("A", "B"))
    assert c.for_broker() is c
    b = DeliveryConfig.from_settings({"ledger.topic": "t", "ledger.barrier.enabled": "true", "ledger.barrier.multiplier": "2.5"})
    assert b.barrier.enabled and b.barrier.multiplier == 2.5


@pytest.mark.parametrize("settings", [{}, {"ledger.topic": "t", "ledger.speed": "1"}, {"ledger.topic": "t", "ledger.concurrency": "many"}, {"ledger.topic": "t", "ledger.engine": "fast"}, {"ledger.topic": "t", "ledger.retry.colour": "1"}, {"ledger.topic": "t", "ledger.barrier.enabled": "perhaps"}])
def test_settings_that_are_refused(settings):
    with pytest.raises(ValueError):
        DeliveryConfig.from_settings(settings)


def test_what_a_broker_needs():
    with pytest.raises(TypeError):
        DeliveryConfig()
    with pytest.raises(ValueError):
        DeliveryConfig("t", properties={"group.id": "g"}).for_broker()
