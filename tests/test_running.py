"""Blocked running folds against plain windows, and open spans."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.operators.pressure import in_flight
from ledgerflow.operators.running import running_max, running_sum


def test_blocks_of_any_size_equal_one_window(spark):
    draw = random.Random(7)
    rows = [(k, o, draw.choice([None, -5, 0, 3, 9])) for k in "ab" for o in draw.sample(range(-40, 400), 90)]
    df = spark.createDataFrame([*rows, ("c", 5, None)], "k string, o bigint, v bigint")
    line = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    for fold, blocked in ((F.sum, running_sum), (F.max, running_max)):
        want = sorted(map(str, df.withColumn("running", fold("v").over(line)).select("k", "o", "v", "running").collect()))
        for block in (1, 16, 1 << 17):
            assert sorted(map(str, blocked(df, ["k"], "o", "v", block).select("k", "o", "v", "running").collect())) == want


def test_running_sum_of_no_rows_is_empty(spark):
    assert running_sum(spark.createDataFrame([], "k string, o bigint, v bigint"), ["k"], "o", "v").count() == 0


def test_open_spans_stay_in_flight(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("a", 5, None), ("a", None, 7)], "k string, start_ms bigint, end_ms bigint")
    assert sorted((r.t_ms, r.n) for r in in_flight(spans, ["k"]).collect()) == [(0, 1), (5, 2), (10, 1)]
