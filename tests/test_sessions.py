"""Sessions against their SQL where gaps meet the bound, milliseconds are shared and values are null."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators.sessions import sessions
from ledgerflow.plans import catalog
from ledgerflow.sources.records import epoch_ms, read_events

START, GAP = 1_704_067_200_000_000, 7_200_000_000
#: (user, microseconds): at the gap, at it in milliseconds only, just below and above, one millisecond against the order of ids, before 1970, nulls.
PLANTED = [(1, START), (1, START + GAP), (2, START + 900), (2, START + GAP + 100), (3, START), (3, START + GAP - 1), (4, START), (4, START + GAP + 1)]
PLANTED += [(5, START), (5, START + 3 * GAP + 200), (5, START + 3 * GAP + 100), (6, -500), (6, GAP + 100), (7, START), (7, None), (7, None), (8, None), (None, START), (None, START + GAP)]


def drawn(n):
    draw, rows = random.Random(3), []
    while len(rows) < n:
        user, us = draw.choice([None, *range(-9, 30)]), draw.choice([0, START]) + draw.randrange(-99, 99) * 3_600_000_000
        for _ in range(draw.randint(1, 6)):
            rows.append((user, None if draw.random() < 0.02 else us + draw.randrange(-3, 4) * draw.choice([1, 100, 1000])))
            us += draw.choice([0, 1, 999, GAP // 2, GAP - 1000, GAP - 500, GAP])
    return rows


@pytest.fixture(scope="module", params=["planted", "drawn"])
def table(request, tmp_path_factory):
    rows = PLANTED if request.param == "planted" else drawn(3000)
    ids = [*range(len(rows))] if request.param == "planted" else random.Random(4).sample(range(len(rows)), len(rows))
    folder, db = tmp_path_factory.mktemp(request.param), duckdb.connect()
    db.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    db.executemany("INSERT INTO events VALUES (?, make_timestamp(?), ?, 'a', 1.0, '{}')", [(i, us, user) for i, (user, us) in zip(ids, rows, strict=True)])
    db.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder), Counter(db.execute(f"SELECT user_id, start_ms, end_ms, n FROM ({catalog.ORACLE_SQL['throughput_session']})").fetchall())


def test_query_equals_sql_at_the_bound(spark, table):
    got = catalog.QUERIES["throughput_session"](spark, table[0]).select("user_id", "start_ms", "end_ms", "n")
    assert Counter(map(tuple, got.collect())) == table[1]


@pytest.mark.parametrize("block", [1, 1000, 10_000_000, 1 << 40])
def test_blocks_of_any_size_give_the_same_sessions(spark, table, block):
    got = sessions(read_events(spark, table[0]).withColumn("ts_ms", epoch_ms("ts")), ["user_id"], 7_200_000, block)
    assert Counter(map(tuple, got.collect())) == table[1]


def test_repeated_events_share_a_session(spark):
    one = spark.sql("SELECT 1L AS user_id, id AS event_id, timestampadd(HOUR, id * 3, timestamp_ntz'2024-01-01 00:00:00') AS ts FROM range(2)")
    got = sessions(one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("ts_ms", epoch_ms("ts")), ["user_id"], 7_200_000)
    assert sorted(got.select((F.col("end_ms") - F.col("start_ms")).alias("ms"), "n").collect()) == [(7_200_000, 6), (7_200_000, 6)]
