"""What streams report of themselves, as a table: rows a second, times of batches, state, observed metrics."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Event, Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = ("query_id string, run_id string, name string, batch_id long, at string, rows long, rows_per_second double, "
            "batch_ms long, state_rows long, observed string")


class ProgressTable(StreamingQueryListener):
    """Appends a row for each batch of each stream to parquet files, `held` rows at a time.

    What is held is written too when a stream ends. A batch that is run again has a second row, of another
    run. Observed metrics are a JSON object by their names.
    """

    def __init__(self, spark: SparkSession, path: str, held: int = 100):
        self.spark, self.path, self.held = spark, path, held
        self.rows: list[tuple] = []
        self.lock, self.ended = Lock(), Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = {name: row.asDict(recursive=True) for name, row in (p.observedMetrics or {}).items()}
        with self.lock:
            self.rows.append((
                str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond),
                p.batchDuration, sum(s.numRowsTotal for s in p.stateOperators),
                json.dumps(observed, default=str, sort_keys=True)))
            full = len(self.rows) >= self.held
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()
        self.ended.set()

    def flush(self) -> None:
        """Write what is held."""
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)


@contextmanager
def reported(spark: SparkSession, path: str, *, held: int = 100, wait_s: float = 30) -> Iterator[ProgressTable]:
    """Streams of the session report to `path` while this is open.

    At its end it waits for the report of the stream that ended last, which comes after the stream's own end.
    """
    table = ProgressTable(spark, path, held)
    spark.streams.addListener(table)
    try:
        yield table
    finally:
        table.ended.wait(wait_s)
        spark.streams.removeListener(table)
        table.flush()


def rates(progress: DataFrame) -> DataFrame:
    """Records, batches, records a second of busy time, and largest state of each stream and run.

    Batches without records count for the time but not as batches.
    """
    return progress.groupBy("query_id", "run_id", "name").agg(
        F.sum("rows").alias("rows"), F.count_if(F.col("rows") > 0).alias("batches"),
        (F.sum("rows") * 1000 / F.greatest(F.sum("batch_ms"), F.lit(1))).alias("rows_per_second"),
        F.max("state_rows").alias("most_state_rows"))
