"""Start a stream, and wait for it."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from streamlat.session import new_dir

SHUFFLE_WIDTH = "spark.sql.shuffle.partitions"


def start(spark: SparkSession, writer: DataStreamWriter, *, checkpoint: str | None = None,
          interval_ms: int | None = None, continuous_ms: int | None = None,
          available_now: bool = False, state_partitions: int | None = None,
          name: str | None = None) -> StreamingQuery:
    """Start a stream that `sinks` prepared.

    With `checkpoint` a query that is started again goes on where it stopped. Without
    it the query gets a fresh folder, and a later run starts from the beginning.
    `interval_ms` is the micro-batch length; `available_now` processes what is there
    and ends. `continuous_ms` passes each record on as it arrives and is the time between
    checkpoints; this is for queries without windows, from and to topics, and takes a core
    per topic partition for as long as the query runs.
    `state_partitions` is how many parts the windows' state is kept in, and is fixed with
    the checkpoint; by default it is the session's shuffle width, which is a lot of small
    tasks per batch for a state of two keys per window.
    """
    writer = writer.option("checkpointLocation", checkpoint or new_dir(spark, "checkpoint"))
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif continuous_ms is not None:
        writer = writer.trigger(continuous=f"{continuous_ms} milliseconds")
    elif interval_ms is not None:
        writer = writer.trigger(processingTime=f"{interval_ms} milliseconds")
    if state_partitions is None:
        return writer.start()
    # A stream copies the session's settings when it starts.
    width = spark.conf.get(SHUFFLE_WIDTH)
    spark.conf.set(SHUFFLE_WIDTH, str(state_partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(SHUFFLE_WIDTH, width)


def replay(spark: SparkSession, writer: DataStreamWriter, **options) -> None:
    """Run a stream over what its source holds now, and return when that is done."""
    start(spark, writer, available_now=True, **options).awaitTermination()


def run_batches(spark: SparkSession, writer: DataStreamWriter, batches: int, *, timeout_s: float = 300,
                **options) -> None:
    """Run a stream without end until it has done the batches before number `batches`, and stop it.

    A batch that was begun when the stream stops is done by the next run with the same checkpoint.
    """
    query = start(spark, writer, **options)
    deadline = time.monotonic() + timeout_s
    try:
        while (query.lastProgress is None or query.lastProgress.batchId + 1 < batches):
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > deadline:
                raise TimeoutError(f"fewer than {batches} batches after {timeout_s} s")
            time.sleep(0.05)
    finally:
        query.stop()
