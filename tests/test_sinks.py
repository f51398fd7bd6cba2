import io
import os

import pyarrow as pa
import pytest

from streamlat.__main__ import make_parser
from streamlat.functions.clock import fixed
from streamlat.plans.record_latency import record_latency
from streamlat.sinks import files
from streamlat.sinks.kafka import kafka_rows, sink_options
from streamlat.sinks.socket import send, to_socket
from streamlat.sources.kafka import source_options
from streamlat.sources.files import text_lines
from streamlat.streaming.run import replay


def test_kafka_source_options():
    assert source_options("h:9092", "a, b") == {
        "kafka.bootstrap.servers": "h:9092", "subscribe": "a,b", "startingOffsets": "latest"}
    more = source_options("h:9092", ["a"], starting="earliest", min_partitions=64,
                          max_per_trigger=1000, session_timeout_ms="30000")
    assert more["minPartitions"] == "64" and more["maxOffsetsPerTrigger"] == "1000"
    assert more["kafka.session.timeout.ms"] == "30000"


def test_kafka_sink_options():
    options = sink_options("h:9092")
    assert options["topic"] == "testRes" and options["kafka.acks"] == "all"
    assert options["kafka.retries"] == "0" and options["kafka.batch.size"] == "16384"
    assert options["kafka.buffer.memory"] == "33554432" and options["kafka.linger.ms"] == "0"
    assert sink_options("h:9092", acks="0", linger_ms="5")["kafka.acks"] == "0"
    assert sink_options("h:9092", acks="0", linger_ms="5")["kafka.linger.ms"] == "5"


def test_kafka_rows_have_a_value_only(lines):
    assert kafka_rows(record_latency(lines("7 100"))).columns == ["value"]


class Connection(io.BytesIO):
    writes = 0

    def write(self, data):
        self.writes += 1
        return super().write(data)

    def close(self):
        self.sent = self.getvalue()
        super().close()


def batch(*texts):
    return pa.RecordBatch.from_pydict({"result": pa.array(texts, pa.string())})


def test_socket_sink_sends_batches_over_one_connection():
    opened = []

    def connector(host, port):
        opened.append(((host, port), Connection()))
        return opened[-1][1]

    sent = list(send(iter([batch("a", "b\n"), batch(), batch("é")]), "h", 1, connector))
    assert [s.column(0)[0].as_py() for s in sent] == [2, 1]
    assert len(opened) == 1 and opened[0][0] == ("h", 1)
    assert opened[0][1].sent == "a\nb\né\n".encode() and opened[0][1].writes == 2


def test_socket_sink_opens_nothing_for_an_empty_partition():
    assert list(send(iter([batch()]), "h", 1, lambda host, port: pytest.fail("opened"))) == []


class FolderConnector:
    """Stands in for a server: every connection is a file of its own."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, host, port):
        return open(f"{self.folder}/{os.urandom(8).hex()}", "wb")


def test_stream_to_socket(spark, lines, tmp_path):
    lines("1 100", "2 200", "3 300").repartition(2).write.text(str(tmp_path / "in"))
    received = tmp_path / "received"
    received.mkdir()
    results = record_latency(text_lines(spark, str(tmp_path / "in"), streaming=True),
                             now=fixed(500), newline=True)
    replay(spark, to_socket(results, connector=FolderConnector(str(received))))
    sent = [line for f in received.iterdir() for line in f.read_text().splitlines()]
    assert sorted(sent) == ["1 100 500 400", "2 200 500 300", "3 300 500 200"]


class FailingConnector(FolderConnector):
    """Fails for one line, for as long as a file named `fail` is there."""

    def __call__(self, host, port):
        class Stream(io.FileIO):
            def write(stream, data):
                if b"2 200" in data and os.path.exists(f"{self.folder}/../fail"):
                    raise ConnectionError("gone")
                return super().write(data)
        return Stream(f"{self.folder}/{os.urandom(8).hex()}", "wb")


def received_lines(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().splitlines())


def test_a_batch_run_twice_sends_what_was_not_sent(spark, tmp_path):
    source, received = tmp_path / "in", tmp_path / "received"
    source.mkdir(), received.mkdir()
    for i in (1, 2, 3):
        (source / f"{i}.txt").write_text(f"{i} {i}00\n")
    (tmp_path / "fail").write_text("")

    def run(checkpoint, ledger):
        results = record_latency(text_lines(spark, str(source), streaming=True), now=fixed(500))
        # A partition for each file.
        before = spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
        try:
            replay(spark, to_socket(results, connector=FailingConnector(str(received)), ledger=ledger),
                   checkpoint=checkpoint)
        finally:
            spark.conf.set("spark.sql.files.openCostInBytes", before)

    first, second, ledger = (str(tmp_path / name) for name in ("first", "second", "ledger"))
    with pytest.raises(Exception, match="gone"):
        run(first, ledger)
    (tmp_path / "fail").unlink()
    want = ["1 100 500 400", "2 200 500 300", "3 300 500 200"]
    assert set(received_lines(received)) <= {want[0], want[2]}
    run(first, ledger)
    assert received_lines(received) == want
    # A new checkpoint with the same ledger stands for a batch that was sent and not committed.
    run(second, ledger)
    assert received_lines(received) == want


def test_stream_to_text_log(spark, lines, tmp_path):
    lines("1 100").write.text(str(tmp_path / "in"))
    stream = record_latency(text_lines(spark, str(tmp_path / "in"), streaming=True))
    replay(spark, files.to_text_log(stream, str(tmp_path / "log")))
    assert text_lines(spark, str(tmp_path / "log")).collect()[0].line.startswith("1 100 ")


def test_stream_to_console(spark, lines, tmp_path):
    # The JVM prints, so only that the stream runs to its end is checked.
    lines("1 100").write.text(str(tmp_path / "in"))
    replay(spark, files.to_console(text_lines(spark, str(tmp_path / "in"), streaming=True)))


def test_command_line():
    options = make_parser().parse_args(
        ["throughput-kafka", "--servers", "h:9092", "--topics", "a,b", "--interval-ms", "500",
         "--checkpoint", "/shared/cp", "--clock-fired"])
    assert options.run.__name__ == "throughput_kafka"
    assert (options.topics, options.interval_ms, options.clock_fired) == ("a,b", 500, True)
    assert options.out_topic == "testRes" and options.acks == "all"
    port = make_parser().parse_args(["record-latency-port"])
    assert (port.host, port.port, port.out_port) == ("localhost", 9999, 9998)
    with pytest.raises(SystemExit):
        make_parser().parse_args(["measure-topic"])
