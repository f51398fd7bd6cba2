"""The five queries as jobs, and the two jobs that measure their results.

Each function starts a stream and returns it; call `awaitTermination()` to block.
Delivery: a Kafka sink is at least once. A socket source loses what it had read when
the driver is lost, and a socket sink repeats the rows of a retried task. Clocks of the
machines that create, process and receive a record go into its latency.

Records are processed in micro-batches; `record_latency_kafka` can also pass each on as it
arrives (`continuous_ms`), for latencies of milliseconds.

Windows are of arrival time. The clock closes them, records or not; without `clock_fired` a
window closes with the first batch after its end that has records; with `timers` each window has a
timer of its own in place of the heartbeat. With `lenient`, lines
without two whole numbers are left out instead of stopping the job; `rejected_lines` over the
same source gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from streamlat.operators.parity import THROUGHPUT_LABELS, with_parity
from streamlat.operators.records import parse_lines, with_digit_sum
from streamlat.operators.windows import arrival_time
from streamlat.plans.measured import port_results, topic_results
from streamlat.plans.parity_windows import (
    MEAN_WINDOW_S, THROUGHPUT_WINDOW_S, parity_mean, throughput, window_results)
from streamlat.plans.record_latency import record_latency
from streamlat.sinks.files import to_text_log
from streamlat.sinks.kafka import RESULT_TOPIC, to_kafka
from streamlat.sinks.socket import RESULT_HOST, RESULT_PORT, to_socket
from streamlat.sources.kafka import kafka_lines, kafka_results
from streamlat.sources.socket import LINE_HOST, LINE_PORT, socket_lines
from streamlat.streaming.clock_windows import NO_LATENESS, clock_window_sums
from streamlat.streaming.run import start
from streamlat.streaming.timer_windows import timer_window_sums

# Tasks of a batch that keep the state of the windows: two keys a window.
STATE_PARTITIONS = 2


def mean_results(lines: DataFrame, *, clock_fired: bool = True, timers: bool = False, newline: bool = False,
                 lenient: bool = False) -> DataFrame:
    """Windowed means of a stream by arrival."""
    if timers:
        return (lines.transform(parse_lines, lenient=lenient).transform(with_parity)
                     .transform(timer_window_sums, MEAN_WINDOW_S * 1000)
                     .transform(window_results, newline=newline))
    if not clock_fired:
        return parity_mean(lines, time=arrival_time(), lateness=NO_LATENESS, newline=newline,
                           lenient=lenient)
    return (lines.transform(parse_lines, lenient=lenient).transform(with_parity)
                 .transform(clock_window_sums, f"{MEAN_WINDOW_S} seconds")
                 .transform(window_results, newline=newline))


def throughput_results(lines: DataFrame, *, clock_fired: bool = True, timers: bool = False,
                       lenient: bool = False) -> DataFrame:
    """The throughput query on a stream by arrival.

    A sink takes the text `result`, which has no digit sum in it. The metrics observed
    under `throughput` in the query's progress do, so the load stays in the plan.
    """
    if timers:
        results = (lines.transform(parse_lines, lenient=lenient).transform(with_digit_sum)
                        .transform(with_parity, THROUGHPUT_LABELS)
                        .transform(timer_window_sums, THROUGHPUT_WINDOW_S * 1000, totals=("digit_sum",))
                        .transform(window_results))
    elif clock_fired:
        results = (lines.transform(parse_lines, lenient=lenient).transform(with_digit_sum)
                        .transform(with_parity, THROUGHPUT_LABELS)
                        .transform(clock_window_sums, f"{THROUGHPUT_WINDOW_S} seconds",
                                   totals=("digit_sum",))
                        .transform(window_results))
    else:
        results = throughput(lines, time=arrival_time(), lateness=NO_LATENESS, lenient=lenient)
    return results.observe("throughput", F.count(F.lit(1)).alias("windows"),
                           F.sum("n").alias("records"),
                           F.sum("sum_digit_sum").alias("digit_sum"))


def record_latency_kafka(spark: SparkSession, *, servers: str, topics: str,
                         out_topic: str = RESULT_TOPIC, acks: str = "all",
                         min_partitions: int | None = None, max_per_trigger: int | None = None,
                         lenient: bool = False, checkpoint: str | None = None, interval_ms: int | None = None,
                         continuous_ms: int | None = None) -> StreamingQuery:
    """Latency of every record of the topics."""
    lines = kafka_lines(spark, servers, topics, min_partitions=min_partitions,
                        max_per_trigger=max_per_trigger)
    return start(spark, to_kafka(record_latency(lines, lenient=lenient), servers, out_topic, acks=acks),
                 checkpoint=checkpoint, interval_ms=interval_ms, continuous_ms=continuous_ms)


def record_latency_port(spark: SparkSession, *, host: str = LINE_HOST, port: int = LINE_PORT,
                        out_host: str = RESULT_HOST, out_port: int = RESULT_PORT,
                        partitions: int | None = None, lenient: bool = False,
                        checkpoint: str | None = None,
                        interval_ms: int | None = None) -> StreamingQuery:
    """Latency of every record of a line server."""
    lines = socket_lines(spark, host, port, partitions=partitions)
    return start(spark, to_socket(record_latency(lines, newline=True, lenient=lenient), out_host, out_port),
                 checkpoint=checkpoint, interval_ms=interval_ms)


def parity_mean_kafka(spark: SparkSession, *, servers: str, topics: str,
                      out_topic: str = RESULT_TOPIC, acks: str = "all",
                      min_partitions: int | None = None, max_per_trigger: int | None = None,
                      clock_fired: bool = True, timers: bool = False, lenient: bool = False,
                      state_partitions: int = STATE_PARTITIONS,
                      checkpoint: str | None = None,
                      interval_ms: int | None = None) -> StreamingQuery:
    """Windowed means of the topics."""
    lines = kafka_lines(spark, servers, topics, min_partitions=min_partitions,
                        max_per_trigger=max_per_trigger)
    results = mean_results(lines, clock_fired=clock_fired, timers=timers, lenient=lenient)
    return start(spark, to_kafka(results, servers, out_topic, acks=acks), checkpoint=checkpoint,
                 interval_ms=interval_ms, state_partitions=state_partitions)


def parity_mean_port(spark: SparkSession, *, host: str = LINE_HOST, port: int = LINE_PORT,
                     out_host: str = RESULT_HOST, out_port: int = RESULT_PORT,
                     partitions: int | None = None, clock_fired: bool = True, timers: bool = False,
                     lenient: bool = False,
                     state_partitions: int = STATE_PARTITIONS, checkpoint: str | None = None,
                     interval_ms: int | None = None) -> StreamingQuery:
    """Windowed means of a line server."""
    lines = socket_lines(spark, host, port, partitions=partitions)
    results = mean_results(lines, clock_fired=clock_fired, timers=timers, newline=True, lenient=lenient)
    return start(spark, to_socket(results, out_host, out_port), checkpoint=checkpoint,
                 interval_ms=interval_ms, state_partitions=state_partitions)


def throughput_kafka(spark: SparkSession, *, servers: str, topics: str,
                     out_topic: str = RESULT_TOPIC, acks: str = "all",
                     min_partitions: int | None = None, max_per_trigger: int | None = None,
                     clock_fired: bool = True, timers: bool = False, lenient: bool = False,
                      state_partitions: int = STATE_PARTITIONS,
                     checkpoint: str | None = None,
                     interval_ms: int | None = None) -> StreamingQuery:
    """Throughput of the topics: windows of ten seconds behind a load per record."""
    lines = kafka_lines(spark, servers, topics, min_partitions=min_partitions,
                        max_per_trigger=max_per_trigger)
    results = throughput_results(lines, clock_fired=clock_fired, timers=timers, lenient=lenient)
    return start(spark, to_kafka(results, servers, out_topic, acks=acks), checkpoint=checkpoint,
                 interval_ms=interval_ms, state_partitions=state_partitions)


def measure_topic(spark: SparkSession, *, servers: str, path: str, topic: str = RESULT_TOPIC,
                  lines_per_flush: int | None = None, checkpoint: str | None = None,
                  interval_ms: int | None = None) -> StreamingQuery:
    """Log the result lines of a topic with the broker's latency."""
    lines = kafka_results(spark, servers, topic, max_per_trigger=lines_per_flush)
    return start(spark, to_text_log(topic_results(lines), path, "measured"),
                 checkpoint=checkpoint, interval_ms=interval_ms)


def measure_port(spark: SparkSession, *, path: str, host: str = RESULT_HOST,
                 port: int = RESULT_PORT, checkpoint: str | None = None,
                 interval_ms: int | None = None) -> StreamingQuery:
    """Log the result lines of a socket with the latency at arrival."""
    lines = socket_lines(spark, host, port, received=True)
    return start(spark, to_text_log(port_results(lines), path, "measured"),
                 checkpoint=checkpoint, interval_ms=interval_ms)
