"""Latency columns, measured inside the query and outside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlat.functions.lines import format_result


def stamp_latency(df: DataFrame, now: Column, *, since: str = "created_ms",
                  stamp: str = "processed_ms") -> DataFrame:
    """Add the instant `stamp` and `latency_ms`, the time from `since` to it."""
    return (df.withColumn(stamp, now)
              .withColumn("latency_ms", F.col(stamp) - F.col(since)))


def broker_latency(results: DataFrame) -> DataFrame:
    """Result lines read back from a topic: time from creation to the broker's stamp.

    Needs `line`, `created_ms` (field 1 of the result line) and the message's
    `timestamp`. `measured` is the line with both numbers appended.
    """
    return (results
            .withColumn("broker_ms", F.unix_millis("timestamp"))
            .withColumn("diff_ms", F.col("broker_ms") - F.col("created_ms"))
            .withColumn("measured", format_result(
                F.col("line"), F.col("broker_ms"), F.col("diff_ms"))))


def port_latency(results: DataFrame) -> DataFrame:
    """Result lines read back from a socket: whole way, and the leg after the query.

    Needs `line`, `created_ms` and `processed_ms` (fields 1 and 2) and `arrival_ms`.
    """
    return (results
            .withColumn("e2e_ms", F.col("arrival_ms") - F.col("created_ms"))
            .withColumn("sink_leg_ms", F.col("arrival_ms") - F.col("processed_ms"))
            .withColumn("measured", format_result(
                F.col("line"), F.col("arrival_ms"), F.col("e2e_ms"), F.col("sink_leg_ms"))))
