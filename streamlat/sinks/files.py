"""Results to files: a text log, a typed table, a table of windows that still change."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from streamlat.operators.parity import share
from streamlat.operators.records import judged_lines
from streamlat.session import remove, subfolders


def to_text_log(results: DataFrame, path: str, column: str = "result") -> DataStreamWriter:
    """Append one text column to files in `path`; each micro-batch is one flush."""
    return (results.select(F.col(column).alias("value")).writeStream.outputMode("append")
            .format("text").option("path", path))


def to_table(results: DataFrame, path: str) -> DataStreamWriter:
    """Append rows to parquet files in `path`, exactly once."""
    return results.writeStream.outputMode("append").format("parquet").option("path", path)


def _changes(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*folders)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of changes, one for each run and batch."""
    return [batch for run in subfolders(spark, path) if "/run=" in run for batch in subfolders(spark, run)]


def _last(changes: DataFrame, key: tuple[str, ...], versions: bool = False) -> DataFrame:
    """The newest row of each window, column by column, so that columns nobody reads are dropped."""
    version = (F.col("run").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)")
               + F.col("batch_id").cast("decimal(12,0)"))
    values = [name for name in changes.columns if name not in key and (versions or name not in ("run", "batch_id"))]
    return (changes.withColumn("version", version).groupBy(*key)
            .agg(*[F.max_by(name, "version").alias(name) for name in values]))


def to_window_table(results: DataFrame, path: str, *, key: tuple[str, ...] = ("window_start_ms", "parity"),
                    every: int = 100, width_ms: int | None = None, lateness_ms: int = 0) -> DataStreamWriter:
    """Write every window that changed, batch by batch, without waiting for it to close.

    A batch that is run again writes over its own folder, or counts as newer if the job was
    started again. A job with a new checkpoint counts anew; its windows take the place of
    those of earlier runs. Read with `latest_windows`.

    Each `every` batches the folders so far become one. With `width_ms`, windows that ended `lateness_ms`
    before the start of the newest one move into one table that is only appended to, so that what is put
    together each time does not grow with the age of the job; a later change of such a window still counts.
    Folders that were put together go one such step later, so a reader has as long to finish.
    """
    run = time.time_ns()
    superseded: list[str] = []

    def put_together(batch: DataFrame, batch_id: int, older: list[str], folder: str) -> None:
        spark = batch.sparkSession
        now = batch.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id).cast("long")})
        before = _changes(spark, path, older).withColumns({n: F.col(n).cast("long") for n in ("run", "batch_id")})
        last = share(_last(before.unionByName(now), key, versions=True))
        try:
            closed = F.lit(False)
            if width_ms is not None:
                newest = last.agg(F.max("window_start_ms")).first()[0]
                if newest is not None:
                    closed = F.col("window_start_ms") <= newest - width_ms - lateness_ms
            last.where(closed).write.mode("append").parquet(f"{path}/closed")
            last.where(~closed).drop("run", "batch_id").write.mode("overwrite").parquet(folder)
        finally:
            last.unpersist()

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/run={run}/batch_id={batch_id}"
        older = _folders(spark, path) if batch_id % every == 0 else []
        if not older:
            batch.write.mode("overwrite").parquet(folder)
            return
        remove(spark, superseded)
        older = [f for f in older if f not in superseded]
        put_together(batch, batch_id, older, folder)
        superseded[:] = older

    return results.writeStream.outputMode("update").foreachBatch(write)


def latest_windows(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """The last state of each window in a table written by `to_window_table`."""
    changes = _changes(spark, path, [f"{path}/run=*"])
    if f"{path}/closed" in subfolders(spark, path):
        changes = changes.unionByName(spark.read.parquet(f"{path}/closed"))
    return _last(changes, key)


def to_console(results: DataFrame, rows: int = 20) -> DataStreamWriter:
    """Print at most `rows` rows of every batch, for looking at a stream."""
    return (results.writeStream.outputMode("append").format("console")
            .option("truncate", "false").option("numRows", rows))


def to_each(results: DataFrame, *writers: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Give every batch to several writers, reading and computing it once.

    Writers get the batch and its number, and may see the same number again after a failure.
    What does not fit in memory goes to disk. Only what is lost with an executor is computed
    again, with later instants where the clock is read per row.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        shared = share(batch)
        try:
            for writer in writers:
                writer(shared, batch_id)
        finally:
            shared.unpersist()

    return results.writeStream.outputMode("append").foreachBatch(write)


def to_accepted_and_rejected(lines: DataFrame, accepted: str, rejected: str) -> DataStreamWriter:
    """Parse each batch of lines once: records to parquet below `accepted`, lines that do not parse below `rejected`.

    Further columns of the source, an offset say, stay beside the line on both sides. A batch that is run again
    writes over its own two folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        both = share(judged_lines(batch))
        try:
            (both.where("accepted").drop("accepted").write.mode("overwrite")
             .parquet(f"{accepted}/batch_id={batch_id}"))
            (both.where("NOT accepted").drop("accepted", "seq", "created_ms").write.mode("overwrite")
             .parquet(f"{rejected}/batch_id={batch_id}"))
        finally:
            both.unpersist()

    return lines.writeStream.outputMode("append").foreachBatch(write)
