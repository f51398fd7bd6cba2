"""Latency of every record, over a topic or over a socket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlat.functions.clock import per_row
from streamlat.functions.lines import format_result
from streamlat.operators.latency import stamp_latency
from streamlat.operators.records import parse_lines


def record_latency(lines: DataFrame, *, now: Column | None = None, newline: bool = False,
                   lenient: bool = False) -> DataFrame:
    """`seq, created_ms, processed_ms, latency_ms` and the text `result`.

    `result` is the whole line with the instant and the latency appended, so fields
    after the first two are kept. `newline` is the socket form.
    """
    stamped = (lines.transform(parse_lines, lenient=lenient)
                    .transform(stamp_latency, per_row() if now is None else now))
    result = format_result(F.col("line"), F.col("processed_ms"), F.col("latency_ms"),
                           newline=newline)
    return stamped.select("seq", "created_ms", "processed_ms", "latency_ms",
                          result.alias("result"))
