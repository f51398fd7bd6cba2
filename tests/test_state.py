"""Timers, state that is looked into, sketches, rejected lines."""

import time

import pytest
from pyspark.sql import functions as F

from streamlat.functions import clock
from streamlat.operators import parity, records, sketches, windows
from streamlat.plans.parity_windows import parity_mean
from streamlat.session import new_dir
from streamlat.sinks import files
from streamlat.sources import load
from streamlat.sources.files import text_lines
from streamlat.streaming import jobs
from streamlat.streaming.run import replay, run_batches, start
from streamlat.streaming.state import open_windows, state_sizes
from streamlat.streaming.timer_windows import timer_window_sums

T0 = 1_700_000_000_000


def put(spark, path, *texts):
    spark.createDataFrame([(t,) for t in texts], "line string").coalesce(1).write.mode("append").text(path)


def counted(spark, path):
    return spark.read.schema("n long").parquet(path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def wait(query, done, seconds=120):
    deadline = time.monotonic() + seconds
    while not done():
        assert query.exception() is None
        assert time.monotonic() < deadline
        time.sleep(0.2)


def timed(spark, source, out, checkpoint, width_ms):
    sums = (text_lines(spark, source, streaming=True).transform(records.parse_lines)
            .transform(records.with_digit_sum).transform(parity.with_parity)
            .transform(timer_window_sums, width_ms, totals=("digit_sum",)))
    return start(spark, files.to_table(sums, out), checkpoint=checkpoint, interval_ms=200, state_partitions=2)


def test_a_window_comes_out_without_a_further_record(spark):
    source, out, checkpoint = (new_dir(spark, name) for name in ("in", "out", "checkpoint"))
    put(spark, source, "1 100", "2 200", "3 9223372036854775807", "5 9223372036854775807")
    query = timed(spark, source, out, checkpoint, 1_000)
    wait(query, lambda: query.lastProgress and counted(spark, out) == 4)
    query.stop()
    got = spark.read.parquet(out)
    assert got.where("window_start_ms % 1000 <> 0").isEmpty()
    sums = {r.parity: tuple(r)[1:] for r in got.groupBy("parity").agg(
        F.sum("n"), F.sum("sum_seq"), F.sum("sum_created_ms"), F.sum("sum_digit_sum")).collect()}
    assert sums == {"odd": (3, 9, 100 + 2 * (2**63 - 1), 2 + 91 + 93), "even": (1, 2, 200, 4)}


def test_an_open_window_comes_out_after_a_restart(spark):
    source, out, checkpoint = (new_dir(spark, name) for name in ("in", "out", "checkpoint"))
    width = 20_000
    # Not just before the end of a window.
    while time.time() * 1000 % width > width / 2:
        time.sleep(0.2)
    put(spark, source, "1 100", "2 200")
    query = timed(spark, source, out, checkpoint, width)
    wait(query, lambda: sum(p.numInputRows for p in query.recentProgress) == 2)
    query.stop()
    assert counted(spark, out) == 0
    put(spark, source, "3 300")
    query = timed(spark, source, out, checkpoint, width)
    wait(query, lambda: query.lastProgress and counted(spark, out) == 3)
    query.stop()


@pytest.mark.parametrize("results", [jobs.mean_results, jobs.throughput_results])
def test_jobs_with_timers(spark, results):
    source = new_dir(spark, "in")
    put(spark, source, "1 100")
    lines = text_lines(spark, source, streaming=True)
    made = results(lines, timers=True)
    assert {"window_start_ms", "parity", "n", "avg_created_ms", "result"} <= set(made.columns)
    plan = made._jdf.queryExecution().logical().toString()
    assert "TransformWithState" in plan and "rate" not in plan.lower().split("transformwithstate")[0]


def test_the_state_of_open_windows(spark):
    source, out, checkpoint = (new_dir(spark, name) for name in ("in", "out", "checkpoint"))
    put(spark, source, "1 1000", "3 1001", "2 9000000000000", "4 9000000000000")

    def run():
        lines = text_lines(spark, source, streaming=True)
        replay(spark, files.to_window_table(parity_mean(lines, width="1 hour", now=clock.fixed(0)), out),
               checkpoint=checkpoint, state_partitions=2)

    run()
    held = {r.parity: (r.n, int(r.sum_seq), int(r.sum_created_ms)) for r in open_windows(spark, checkpoint).collect()}
    assert held == {"odd": (2, 4, 2001), "even": (2, 6, 18_000_000_000_000)}
    put(spark, source, "5 1002")
    run()
    assert {r.parity: r.n for r in open_windows(spark, checkpoint).collect()} == {"odd": 3, "even": 2}
    sizes = state_sizes(spark, checkpoint).collect()
    assert [(r.numPartitions, r.maxBatchId) for r in sizes] == [(2, 1)]


def test_sketches_of_parts_give_the_quantiles_of_the_whole(spark):
    df = spark.range(100_000).selectExpr("pmod(id * 7919, 100000) AS latency_ms", f"{T0} + id * 36 AS created_ms",
                                         "'a' AS parity")
    minutes = sketches.latency_sketches(df, "1 minute")
    assert minutes.count() == 61
    row = sketches.quantiles(sketches.wider(minutes, 10**15)).first()
    assert row.n == 100_000
    for q, got in zip(sketches.QUANTILES, (row.p50, row.p95, row.p99)):
        assert abs(got / 100_000 - q) < 0.03
    none = sketches.latency_sketches(df.limit(0), "1 minute")
    assert sketches.quantiles(none, 0.5).collect() == []


def test_rejected_lines_beside_the_good_ones(spark):
    good, bad = new_dir(spark, "good"), new_dir(spark, "bad")
    batch = spark.createDataFrame([("1 100", 7), ("x 1", 8), (None, 9), ("2  3", 10), ("4 5 more", 11)],
                                  "line string, offset long").repartition(3)
    source = new_dir(spark, "batch")
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    writer = files.to_accepted_and_rejected(stream, good, bad)
    checkpoint = new_dir(spark, "checkpoint")
    replay(spark, writer, checkpoint=checkpoint)
    # The same batch once more, as after a failure before it was noted as done.
    replay(spark, files.to_accepted_and_rejected(stream, good, bad))
    assert sorted((r.line, r.offset, r.seq, r.created_ms) for r in spark.read.parquet(good).collect()) == [
        ("1 100", 7, 1, 100), ("4 5 more", 11, 4, 5)]
    rejected = spark.read.parquet(bad)
    assert sorted((r.offset, r.line) for r in rejected.collect()) == [(8, "x 1"), (9, None), (10, "2  3")]
    assert "seq" not in rejected.columns


def test_replayed_batches_are_the_same(spark):
    out, again = new_dir(spark, "load"), new_dir(spark, "again")

    def run(path, batches, checkpoint):
        lines = load.replayable_lines(spark, 100, load.constant_steps(1_500_000), T0, partitions=2)
        run_batches(spark, files.to_table(lines, path), batches, checkpoint=checkpoint)

    checkpoint = new_dir(spark, "checkpoint")
    run(out, 1, checkpoint)
    run(out, 3, checkpoint)
    run(again, 3, new_dir(spark, "other"))
    want = [f"{i} {T0 + i * 1_500_000 // 1_000_000}" for i in range(300)]
    for path in (out, again):
        lines = sorted((r.line for r in spark.read.parquet(path).collect()), key=lambda x: int(x.split()[0]))
        assert lines[:300] == want and len(lines) % 100 == 0


def test_windows_from_a_start(spark, typed):
    df = typed((1, 699), (3, 700), (5, 2699), (7, 2700)).transform(parity.with_parity)
    sums = windows.window_sums(df, "2 seconds", start_ms=1_700_000_000_700)
    assert sorted((r.window_start_ms, r.n) for r in sums.collect()) == [(-1300, 1), (700, 2), (2700, 1)]
    assert windows.milliseconds("6 hours") == 21_600_000
