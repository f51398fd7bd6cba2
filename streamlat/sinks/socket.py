"""Results to a TCP server, one connection per partition that has rows."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from streamlat.session import subfolders

# Where results are received.
RESULT_HOST = "localhost"
RESULT_PORT = 9998


def connect(host: str, port: int) -> BinaryIO:
    """A buffered binary stream to the server."""
    with socket.create_connection((host, port)) as connection:
        return connection.makefile("wb")  # the stream keeps the connection open


def as_lines(results: pa.Array) -> bytes:
    """The texts as lines; one that already ends in a newline gets no second one."""
    ended = pc.binary_join_element_wise(pc.utf8_rtrim(results, characters="\n"), "", "\n")
    return pc.binary_join(pa.ListArray.from_arrays([0, len(ended)], ended), "")[0].as_py().encode()


def send(batches: Iterator[pa.RecordBatch], host: str, port: int,
         connector: Callable[[str, int], BinaryIO] = connect) -> Iterator[pa.RecordBatch]:
    """Send `result` of all batches over one connection, which is opened for the first row."""
    stream = None
    try:
        for batch in batches:
            if batch.num_rows:
                stream = stream or connector(host, port)
                stream.write(as_lines(batch.column(0).drop_null()))
                yield pa.RecordBatch.from_pydict({"sent": [batch.num_rows]})
    finally:
        if stream is not None:
            stream.close()


def to_socket(results: DataFrame, host: str = RESULT_HOST, port: int = RESULT_PORT,
              connector: Callable[[str, int], BinaryIO] = connect, ledger: str | None = None) -> DataStreamWriter:
    """Send `result` to a TCP server, a write for each Arrow batch.

    A retried task sends its rows again, and rows sent before a failure stay sent. With `ledger`, a folder
    that belongs to the checkpoint, each partition that was sent whole is noted there when its task ends, and
    a batch that is run again sends the others only. What remains possible: a task that is lost between its
    last row and its note, or within its rows, sends them twice. Partitions are told apart by their numbers,
    so the rows must be dealt out alike when a batch is run again, as those of files and topics are.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if ledger is None:
            sent = batch.mapInArrow(lambda batches: send(batches, host, port, connector), "sent long")
            sent.agg(F.sum("sent")).collect()
            return
        folder = f"{ledger}/batch_id={batch_id}"
        done = noted(batch.sparkSession, ledger, folder)

        def send_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            partition = TaskContext.get().partitionId()
            if partition not in done:
                # The connection is closed, and with it all rows are flushed, before the note.
                n = sum(part.column(0)[0].as_py() for part in send(batches, host, port, connector))
                yield pa.RecordBatch.from_pydict({"partition": [partition], "sent": [n]})

        # With this version of the committer a task's note stays when other tasks of the batch fail.
        (batch.mapInArrow(send_once, "partition long, sent long").write.mode("append")
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder))

    return results.select("result").writeStream.outputMode("append").foreachBatch(write)


def noted(spark: SparkSession, ledger: str, folder: str) -> frozenset[int]:
    """Partitions of a batch that were sent, a number for each."""
    if folder not in subfolders(spark, ledger):
        return frozenset()
    notes = spark.read.schema("partition long, sent long").parquet(folder)
    return frozenset(r.partition for r in notes.collect())
