"""Latency measured outside the query, on result lines that were read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlat.functions.clock import per_row
from streamlat.functions.lines import parse_created_ms, parse_field
from streamlat.operators.latency import broker_latency, port_latency


def topic_results(results: DataFrame) -> DataFrame:
    """Result lines of a topic (`line`, `timestamp`) with the broker's latency."""
    return (results.withColumn("created_ms", parse_created_ms(F.col("line")))
                   .transform(broker_latency)
                   .select("created_ms", "broker_ms", "diff_ms", "measured"))


def port_results(results: DataFrame, *, arrival: Column | None = None) -> DataFrame:
    """Result lines of a socket (`line`) with both latencies at arrival.

    A line arrives when it is received (`timestamp`), where the source says so; without that
    column and without `arrival`, when the batch reads it.
    """
    line = F.col("line")
    if arrival is None:
        arrival = F.unix_millis("timestamp") if "timestamp" in results.columns else per_row()
    return (results.withColumn("arrival_ms", arrival)
                   .withColumn("created_ms", parse_created_ms(line))
                   .withColumn("processed_ms", parse_field(line, 2, "processing time"))
                   .transform(port_latency)
                   .select("created_ms", "processed_ms", "arrival_ms", "e2e_ms",
                           "sink_leg_ms", "measured"))
