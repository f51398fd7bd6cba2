import time

import pytest
from pyspark.sql import functions as F

from streamlat.functions import clock
from streamlat.operators import latency, records
from streamlat.plans import measured
from streamlat.plans.parity_windows import parity_mean, throughput
from streamlat.plans.record_latency import record_latency


@pytest.fixture
def now(spark):
    return clock.fixed(150)


def test_record_result_keeps_the_whole_line(lines, now):
    rows = record_latency(lines("7 100", "7 100 x"), now=now).collect()
    assert [r.result for r in rows] == ["7 100 150 50", "7 100 x 150 50"]
    assert tuple(rows[0])[:4] == (7, 100, 150, 50)
    assert record_latency(lines("7 100"), now=now, newline=True).collect()[0].result.endswith("50\n")


def test_clock_may_be_behind(lines, now):
    assert record_latency(lines("7 200"), now=now).collect()[0].latency_ms == -50


def test_window_result_has_four_fields(lines, now):
    rows = parity_mean(lines("1 100", "3 103", "2 100"), now=now).orderBy("parity").collect()
    assert [r.result for r in rows] == ["1 100 150 50", "2 101 150 49"]


def test_throughput_keeps_its_load(lines, now):
    rows = throughput(lines("1 100", "3 103 5", "2 100"), now=now).orderBy("parity").collect()
    assert [(r.parity, r.n, r.sum_digit_sum) for r in rows] == [
        ("even1111", 1, 3), ("odd0000", 2, 14)]


def test_per_row_clock_is_the_wall_clock_and_read_once(spark):
    before = time.time_ns() // 1_000_000
    df = spark.range(0, 200_000, 1, 4).select(F.lit(0).cast("long").alias("created_ms"))
    stamped = df.transform(latency.stamp_latency, clock.per_row())
    row = stamped.agg(F.min("processed_ms").alias("lo"), F.max("processed_ms").alias("hi"),
                      F.count_if(F.col("processed_ms") != F.col("latency_ms")).alias("torn"),
                      F.countDistinct("processed_ms").alias("instants")).collect()[0]
    assert before - 1 <= row.lo <= row.hi <= time.time_ns() // 1_000_000 + 1
    assert row.torn == 0 and row.instants > 1


def test_batch_clock_is_one_instant(spark):
    df = spark.range(0, 1000, 1, 4).select(clock.per_batch().alias("t"))
    assert df.distinct().count() == 1


def test_broker_latency(lines):
    results = lines("5 1000 1600 600").withColumn("timestamp", F.timestamp_millis(F.lit(1650)))
    row = measured.topic_results(results).collect()[0]
    assert row.measured == "5 1000 1600 600 1650 650" and row.diff_ms == 650


def test_port_latency(lines):
    row = measured.port_results(lines("5 1000 1600 600"), arrival=clock.fixed(1700)).collect()[0]
    assert row.measured == "5 1000 1600 600 1700 700 100"
    assert (row.e2e_ms, row.sink_leg_ms) == (700, 100)


def test_lenient_plans(lines, now):
    df = lines("1 100", "broken", "2 x")
    assert record_latency(df, now=now, lenient=True).count() == 1
    assert parity_mean(df, now=now, lenient=True).count() == 1
    assert throughput(df, now=now, lenient=True).count() == 1
    assert df.transform(records.rejected_lines).count() == 2
