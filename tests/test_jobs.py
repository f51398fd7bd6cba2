"""The jobs as a whole, with files in place of brokers and sockets."""

import time

import pytest
from pyspark.sql import functions as F

from streamlat.sinks import files
from streamlat.sources.files import text_lines
from streamlat.streaming import jobs

SERVERS = {"servers": "h:9092"}


@pytest.fixture
def wired(spark, tmp_path, monkeypatch):
    """Jobs that read `tmp_path/in` and write text below `tmp_path/out`."""
    source, sink = tmp_path / "in", tmp_path / "out"
    calls = {}

    def read(spark, *args, **options):
        calls["source"] = args, {k: v for k, v in options.items() if v is not None}
        return text_lines(spark, str(source), streaming=True, max_files_per_trigger=1)

    def read_results(spark, *args, **options):
        return read(spark, *args, **options).withColumn(
            "timestamp", F.timestamp_millis(F.lit(1650)))

    def write(results, *args, **options):
        calls["sink"] = args, options
        return files.to_text_log(results, str(sink))

    for name, stand_in in (("kafka_lines", read), ("socket_lines", read), ("to_kafka", write),
                           ("to_socket", write), ("kafka_results", read_results)):
        monkeypatch.setattr(jobs, name, stand_in)

    def put(*texts):
        for text in texts:
            spark.createDataFrame([(text,)], "line string").coalesce(1).write.mode(
                "append").text(str(source))

    def run(job, **options):
        query = job(spark, interval_ms=100, **options)
        deadline = time.time() + 90
        while not any(p.numInputRows for p in query.recentProgress) and time.time() < deadline:
            assert query.exception() is None
            time.sleep(0.1)
        return query

    def lines(path=sink):
        return [r.line for r in text_lines(spark, str(path)).collect()]

    return put, run, lines, calls


@pytest.mark.parametrize("job, options", [(jobs.record_latency_kafka, SERVERS | {"topics": "a"}),
                                          (jobs.record_latency_port, {})])
def test_record_latency(wired, job, options):
    put, run, lines, calls = wired
    put("7 100 x")
    query = run(job, **options)
    query.stop()
    fields = lines()[0].split(" ")
    assert fields[:3] == ["7", "100", "x"] and int(fields[3]) - 100 == int(fields[4])


def test_options_reach_source_and_sink(wired, tmp_path):
    put, run, lines, calls = wired
    put("7 100")
    run(jobs.record_latency_kafka, topics="a,b", out_topic="t", acks="0", min_partitions=64,
        checkpoint=str(tmp_path / "cp"), **SERVERS).stop()
    assert calls["source"] == (("h:9092", "a,b"), {"min_partitions": 64})
    assert calls["sink"] == (("h:9092", "t"), {"acks": "0"})
    assert (tmp_path / "cp" / "offsets").is_dir()


@pytest.mark.parametrize("job, options", [
    (jobs.parity_mean_kafka, SERVERS | {"topics": "a"}),
    (jobs.parity_mean_port, {}),
    (jobs.throughput_kafka, SERVERS | {"topics": "a"}),
])
def test_arrival_windows_come_out_with_a_later_batch(wired, job, options):
    put, run, lines, calls = wired
    put("1 100")
    query = run(job, clock_fired=False, **options)
    deadline, got = time.time() + 90, []
    while not got and time.time() < deadline:
        time.sleep(1)
        put("2 200")
        got = lines() if query.lastProgress else []
    query.stop()
    assert query.exception() is None
    n, mean, emitted, latency = map(int, got[0].split())
    assert n >= 1 and mean in (100, 200) and emitted - mean == latency


@pytest.mark.parametrize("job, options", [
    (jobs.parity_mean_kafka, SERVERS | {"topics": "a"}),
    (jobs.parity_mean_port, {}),
    (jobs.throughput_kafka, SERVERS | {"topics": "a"}),
])
def test_windows_need_no_later_record(wired, job, options):
    put, run, lines, calls = wired
    put("1 100")
    query = run(job, **options)
    deadline, got = time.time() + 90, []
    while not got and time.time() < deadline:
        time.sleep(1)
        got = lines()
    query.stop()
    assert query.exception() is None
    assert got[0].split()[:2] == ["1", "100"]


@pytest.mark.parametrize("clock_fired", [False, True])
def test_throughput_observes_its_load(wired, clock_fired):
    put, run, lines, calls = wired
    put("1 100", "3 9")
    query = run(jobs.throughput_kafka, topics="a", state_partitions=2, clock_fired=clock_fired,
                **SERVERS)
    deadline, seen = time.time() + 90, []
    while sum(m.records for m in seen) < 2 and time.time() < deadline:
        time.sleep(1)
        if not clock_fired:
            put("2 200")
        seen = [p.observedMetrics["throughput"] for p in query.recentProgress
                if p.observedMetrics["throughput"].records]
    query.stop()
    assert query.exception() is None
    # Each of "1 100", "3 9" and "2 200" has a digit sum of its own.
    assert seen and all(m.digit_sum >= 2 * m.records for m in seen)


def test_measure_topic(wired, tmp_path):
    put, run, lines, calls = wired
    put("5 1000 1600 600")
    run(jobs.measure_topic, path=str(tmp_path / "log"), lines_per_flush=10, **SERVERS).stop()
    assert lines(tmp_path / "log") == ["5 1000 1600 600 1650 650"]
    assert calls["source"][1] == {"max_per_trigger": 10}


def test_measure_port(wired, tmp_path):
    put, run, lines, calls = wired
    put("5 1000 1600 600")
    run(jobs.measure_port, path=str(tmp_path / "log")).stop()
    *result, arrival, whole, leg = map(int, lines(tmp_path / "log")[0].split(" "))
    assert result == [5, 1000, 1600, 600] and (whole, leg) == (arrival - 1000, arrival - 1600)


def test_a_bad_line_does_not_stop_a_lenient_job(wired):
    put, run, lines, calls = wired
    put("7 100", "bad", "8 x", "9 300")
    query = run(jobs.record_latency_kafka, topics="a", lenient=True, **SERVERS)
    query.processAllAvailable()
    query.stop()
    assert sorted(line.split()[:2] for line in lines()) == [["7", "100"], ["9", "300"]]
