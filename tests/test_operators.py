"""Golden vectors, configuration rules, streams and restarts."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerflow.config import BarrierConfig, DeadLetterConfig, DeliveryConfig, Engine, Guarantee, Ordering, RetryPolicy
from ledgerflow.functions import decode, keys, retry
from ledgerflow.operators import acks, attempts, barrier, dispatch, frontier, handlers, pressure
from ledgerflow.sources.records import broker_options, records_in_memory
from ledgerflow.streaming.frontier import stream_positions
from ledgerflow.streaming.pipeline import Lifecycle, run_ledger, run_to_table, windowed_counts


@pytest.mark.parametrize(
    ("delivered", "done", "position", "parked"),
    [
        ([10, 11, 12], [], 10, 0),
        ([10, 11, 12], [10], 11, 0),
        ([10, 11, 12], [10, 11, 12], 13, 0),
        ([0, 1, 2], [1, 2], 0, 2),
        ([0, 1, 2, 3, 4, 5], [0, 1, 3, 4, 5], 2, 3),
        ([100, 101], [101], 100, 1),
        ([5, 7], [7], 5, 1),
        ([5, 7], [5, 7], 8, 0),
        ([10, 12, 15], [10, 15], 11, 1),
        ([10, 12, 15], [10, 12, 15], 16, 0),
        ([50, 60, 100], [50], 51, 0),
    ],
)
def test_commit_position(spark, delivered, done, position, parked):
    rows = spark.createDataFrame([("t", 0, o, o in done) for o in delivered], "topic string, partition int, offset long, done boolean")
    assert [tuple(r) for r in frontier.commit_positions(rows).select("position", "parked").collect()] == [(position, parked)]


def test_key_hash(spark):
    want = {"key0": 4212018, "": 1, "é": -1017, "hello-world-1234567": 353868701, "k0": 4326, "k10": 134185, "HOT": 101516, None: 0}
    rows = spark.createDataFrame([(k,) for k in want], "k string").select("k", keys.key_hash(F.col("k").cast("binary")).alias("h"))
    assert {r.k: r.h for r in rows.collect()} == want
    shards = spark.createDataFrame([(f"k{i}",) for i in range(12)], "k string").select(keys.shard_index(F.col("k").cast("binary"), 64).alias("s"))
    assert [r.s for r in shards.collect()] == [38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 41, 42]


@pytest.mark.parametrize(
    ("policy", "attempt", "delivery", "slow", "want"),
    [
        (RetryPolicy(5, 50, 2.0, 0.0), 0, 1, 0, "inline"),
        (RetryPolicy(10, 500, 2.0, 0.0), 2, 1, 0, "delayed"),
        (RetryPolicy(10, 500, 2.0, 0.0), 1, 1, 0, "inline"),
        (RetryPolicy.none(), 0, 1, 0, "reject"),
        (RetryPolicy(3, 100, 2.0, 0.0), 0, 4, 0, "exhausted"),
        (RetryPolicy(3, 100, 2.0, 0.0), 0, 4, 3, "inline"),
        (RetryPolicy(0, 100, 2.0, 0.0), 0, None, 0, "exhausted"),
    ],
)
def test_decision(spark, policy, attempt, delivery, slow, want):
    row = spark.createDataFrame([(attempt, delivery, slow)], "a int, d int, s int")
    eff = retry.effective_attempt(F.col("a"), F.col("d"), F.col("s"))
    assert row.select(retry.decision(policy, eff, retry.is_retriable(policy, F.lit("X"))).alias("r")).first().r == want


def test_jitter_bounds(spark):
    got = [r.d for r in spark.range(500).select(retry.jittered_ms(F.lit(200), 0.5, 3).alias("d")).collect()]
    assert min(got) >= 100 and max(got) < 300 and len(set(got)) > 50


@pytest.mark.parametrize(("n", "ms", "config", "want"), [(50, 100, {}, 30_000), (200, 1000, {}, 3000), (200, 20_000, {}, 30_000), (200, 10, {}, 1000), (200, 10, {"lock_ms": 500}, 500)])
def test_barrier(spark, n, ms, config, want):
    samples = spark.range(n).select(F.lit("t").alias("topic"), F.col("id").alias("offset"), F.lit(ms).cast("long").alias("duration_ms"))
    c = BarrierConfig(enabled=True, **({"lock_ms": 30_000} | config))
    assert barrier.adaptive_barrier(samples, ["topic"], c).first().barrier_ms == want


def test_percentiles(spark):
    rows = spark.range(1, 101).select(F.lit("t").alias("topic"), F.col("id").alias("offset"), F.col("id").alias("duration_ms"))
    assert tuple(barrier.percentiles(rows, ["topic"], (0.5, 0.99, 1.0)).first())[1:] == (100, 50, 99, 100)
    assert tuple(barrier.percentiles(barrier.latest(rows.where("offset <= 8"), ["topic"], 4), ["topic"], (0.01, 1.0)).first())[1:] == (4, 5, 8)


def test_hysteresis(spark):
    n = [1, 5, 10, 9, 6, 5, 4, 7, 10, 3]
    rows = pressure.hysteresis(spark.createDataFrame([("t", i, x) for i, x in enumerate(n)], "topic string, tick int, n int"), ["topic"], 10).orderBy("tick").collect()
    assert [r.paused for r in rows] == [False, False, True, True, True, False, False, False, True, False]
    assert [r.event for r in rows if r.event] == ["paused", "resumed", "paused", "resumed"]


def test_truncation_and_decoding(spark):
    got = spark.createDataFrame([("a" * 5000,), ("é" * 3000,), ("€",), ("🙂" * 1025,)], "t string").select(F.octet_length(decode.truncate_utf8(F.col("t"))).alias("n"))
    assert [r.n for r in got.collect()] == [4096, 4096, 3, 4096]
    bad = spark.createDataFrame([(b"ok",), (b"a\xff",), (None,)], "v binary").select(decode.utf8(F.col("v")).alias("t"), decode.is_malformed(F.col("v")).alias("m")).collect()
    assert [tuple(r) for r in bad] == [("ok", False), ("a�", True), (None, False)]


def test_outcome_tags(spark):
    assert spark.sql("select 'ACCEPT' as o").select(decode.outcome_tag(F.col("o"))).first()[0] == "accept"
    with pytest.raises(Exception, match="no terminal outcome"):
        spark.sql("select 'RENEW' as o").select(decode.outcome_tag(F.col("o"))).collect()


@pytest.mark.parametrize(
    "make",
    [
        lambda: DeliveryConfig(topic=" "),
        lambda: DeliveryConfig("t", concurrency=0),
        lambda: DeliveryConfig("t", ordering=Ordering.KEY),
        lambda: DeliveryConfig("t", guarantee=Guarantee.STRICT),
        lambda: DeliveryConfig("t", engine=Engine.CLASSIC, handler_timeout_ms=5),
        lambda: DeliveryConfig("t", engine=Engine.CLASSIC, barrier=BarrierConfig(enabled=True)),
        lambda: DeliveryConfig("t", properties={"auto.offset.reset": "earliest"}),
        lambda: DeliveryConfig("t", engine=Engine.CLASSIC, properties={"share.acquire.mode": "x"}),
        lambda: DeliveryConfig("t", max_poll_records=51),
        lambda: RetryPolicy(-1),
        lambda: RetryPolicy(multiplier=0.5),
        lambda: RetryPolicy(jitter=1.5),
        lambda: BarrierConfig(percentile=1.0),
        lambda: DeadLetterConfig(producer={}),
        lambda: broker_options("t", "h:1", "middle"),
    ],
)
def test_refused(make):
    with pytest.raises(ValueError):
        make()


def test_defaults():
    c = DeliveryConfig("t", engine=Engine.CLASSIC, ordering=Ordering.KEY, properties={"auto.offset.reset": "earliest"})
    assert (c.shard_count, c.poll_size, c.effective_guarantee) == (200, 50, Guarantee.STRICT)
    assert DeliveryConfig("t").effective_guarantee == Guarantee.LOCAL
    assert broker_options("t", "h:1", max_offsets=5)["maxOffsetsPerTrigger"] == "5"


def test_records_in_memory(spark):
    r = records_in_memory(spark, [{"key": b"k"}, {"offset": 3, "headers": [("a", b"1")]}]).collect()
    assert (r[0].topic, r[0].offset, r[0].delivery_count, r[1].headers[0].key) == ("test-topic", 0, 1, "a")
    with pytest.raises(ValueError):
        records_in_memory(spark, [{"partition": -1}])


def test_layout_keeps_lanes_together(spark):
    rows = records_in_memory(spark, [{"offset": i, "key": f"k{i % 9}".encode(), "partition": i % 3} for i in range(90)])
    parts = dispatch.layout(rows, Ordering.KEY, 8, 5).select(F.spark_partition_id().alias("p"), "partition", "shard", "offset")
    seen = {}
    for r in parts.collect():
        lane = seen.setdefault((r.partition, r.shard), (r.p, []))
        assert lane[0] == r.p and (not lane[1] or lane[1][-1] < r.offset)
        lane[1].append(r.offset)


def test_retry_budget_is_total_invocations(spark):
    rows = records_in_memory(spark, [{"offset": i} for i in range(3)])
    got = attempts.expand_attempts(rows, RetryPolicy(3, 10, 1.0, 0.0), F.when(F.col("offset") == 0, 0).when(F.col("offset") == 1, 2)).groupBy("offset").count()
    assert {r.offset: r["count"] for r in got.collect()} == {0: 1, 1: 3, 2: 4}


def test_duplicates_in_flight(spark):
    rows = spark.createDataFrame([("a", 0, 1, 10), ("a", 5, 2, 100), ("a", 12, 3, 1), ("a", 12, 4, 5), ("b", 0, 5, 1)], "k string, started_ms long, delivery_seq long, duration_ms long")
    got = {r.delivery_seq: r.duplicate for r in acks.mark_duplicates(rows, ["k"]).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_batch_handler_contains_errors(spark):
    def handler(pdf):
        return pd.DataFrame({"outcome": ["accept" if 10 // x else "reject" for x in pdf["x"]], "error": None})

    got = {r.x: (r.outcome, r.error) for r in handlers.apply_batches(spark.createDataFrame([(1,), (0,), (20,)], "x long"), handler).collect()}
    assert got[1] == ("accept", None) and got[20] == ("reject", None) and got[0][1].startswith("ZeroDivisionError")


def test_registry_rolls_back():
    reg, stopped = handlers.Registry(), []

    class Query:
        def stop(self):
            stopped.append(self)

    @reg.handler(DeliveryConfig("t"), "a")
    def a(pdf):
        return pdf

    reg.handler(DeliveryConfig("t"), "b")(a)
    with pytest.raises(ValueError):
        reg.handler(DeliveryConfig("t"), "a")(a)

    def start(r):
        if r.name == "b":
            raise RuntimeError("no")
        return Query()

    with pytest.raises(RuntimeError):
        reg.start_all(start)
    assert len(stopped) == 1


def test_stream_frontier_with_restart(spark, tmp_path):
    schema = "topic string, partition int, offset long, kind string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([("t", 0, o, "observe") for o in (10, 12, 15)] + [("t", 0, 15, "done")])
    run_to_table(stream_positions(spark.readStream.schema(schema).parquet(source)), out)
    put([("t", 0, 10, "done"), ("t", 0, 20, "observe")])
    run_to_table(stream_positions(spark.readStream.schema(schema).parquet(source)), out)
    put([("t", 0, 12, "done"), ("t", 0, 20, "done"), ("t", 0, 10, "done")])
    run_to_table(stream_positions(spark.readStream.schema(schema).parquet(source)), out)
    assert sorted(r.position for r in spark.read.parquet(out).collect()) == [10, 11, 21]


def test_stream_ledger_restart_repeats_nothing(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    events.where("event_id < 400").coalesce(1).write.parquet(source)
    policy, fails = RetryPolicy(2, 20, 1.5, 0.0), F.when(F.col("kind") == 2, F.lit(None)).otherwise(0)
    run_ledger(spark, source, target, policy, fails)
    events.where("event_id >= 400").coalesce(1).write.mode("append").parquet(source)
    run_ledger(spark, source, target, policy, fails)
    run_ledger(spark, source, target, policy, fails)
    acked = spark.read.parquet(f"{target}/acks")
    assert acked.count() == events.count() == acked.select("offset").distinct().count()


def test_windowed_stream_equals_batch_on_closed_windows(spark, sf_dir, tmp_path):
    from ledgerflow.schema import EVENTS

    batch = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    stream = windowed_counts(spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*"))
    run_to_table(stream, str(tmp_path / "w"))
    got = {(r.w.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    want = {(r.w.start, r.event_type): r.n for r in batch.collect()}
    assert got and got.items() <= want.items() and len(want) - len(got) < 30


def test_lifecycle():
    class Event:
        exception = "boom"

    seen = []
    life = Lifecycle(seen.append)
    assert life.state == "new"
    life.onQueryStarted(Event())
    assert life.state == "running"
    life.onQueryTerminated(Event())
    life.onQueryTerminated(Event())
    assert (life.state, seen) == ("failed", ["boom"])
