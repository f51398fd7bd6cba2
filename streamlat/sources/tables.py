"""Records from columnar tables, as lines and as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlat.functions.lines import format_result

# Columns the queries use. With the schema given, no file is opened to plan a query.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, props STRING",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_shipdate TIMESTAMP_NTZ",
    "documents": "doc_id BIGINT, text STRING",
}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of parquet files."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def table_stream(spark: SparkSession, directory: str, name: str, *,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream of its files, at most `max_files_per_trigger` of them a batch."""
    reader = spark.readStream.schema(SCHEMAS[name])
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # A stream reads a single file only by a pattern; this one matches no other name.
    return reader.parquet(f"{directory}/{name}.parque[t]")


def epoch_ms(timestamp: Column) -> Column:
    """Milliseconds since 1970, cut (not rounded); the session time zone must be UTC."""
    return F.unix_millis(timestamp.cast("timestamp"))


def as_lines(df: DataFrame, seq: Column, created_ms: Column, *keep: str) -> DataFrame:
    """`line` = `seq created_ms` from two columns."""
    return df.select(format_result(seq, created_ms).alias("line"), *keep)


def event_lines(events: DataFrame, *keep: str) -> DataFrame:
    """The events as lines: `event_id` and the time of the event."""
    return as_lines(events, F.col("event_id"), epoch_ms(F.col("ts")), *keep)


def as_messages(lines: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Lines in the shape of the Kafka source: binary `value`, and `timestamp` if given."""
    columns = [F.col("line").cast("binary").alias("value")]
    if timestamp is not None:
        columns.append(timestamp.alias("timestamp"))
    return lines.select(*columns)
