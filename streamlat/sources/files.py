"""Lines from text files, as a table or as a replayable stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str, *, streaming: bool = False,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """`line` per line of the files at `path`.

    A stream takes files in order of their modification times. With
    `max_files_per_trigger` and event-time windows these times must follow the order of
    the records, or windows close before their records are read.
    """
    if not streaming:
        return spark.read.text(path).select(F.col("value").alias("line"))
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(F.col("value").alias("line"))
