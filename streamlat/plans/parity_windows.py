"""Windowed means by parity, and the throughput query built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlat.functions.clock import per_batch
from streamlat.functions.lines import format_result
from streamlat.operators.latency import stamp_latency
from streamlat.operators.parity import MEAN_LABELS, THROUGHPUT_LABELS, Labels, with_parity
from streamlat.operators.records import parse_lines, with_digit_sum
from streamlat.operators.windows import window_mean, window_sums

# The window widths.
MEAN_WINDOW_S = 2
THROUGHPUT_WINDOW_S = 10


def window_results(sums: DataFrame, *, now: Column | None = None,
                   newline: bool = False) -> DataFrame:
    """Mean, instant and latency of each window, and the text `result`.

    `result` has four fields: count, mean creation time, instant, latency. As typed
    columns the window, the key and the sums are kept.
    """
    stamped = (sums.transform(window_mean)
                   .transform(stamp_latency, per_batch() if now is None else now,
                              since="avg_created_ms", stamp="emitted_ms"))
    return stamped.withColumn("result", format_result(
        F.col("n"), F.col("avg_created_ms"), F.col("emitted_ms"), F.col("latency_ms"),
        newline=newline))


def parity_mean(lines: DataFrame, *, width: str = f"{MEAN_WINDOW_S} seconds",
                time: Column | None = None, lateness: str | None = None,
                now: Column | None = None, labels: Labels = MEAN_LABELS, newline: bool = False,
                lenient: bool = False) -> DataFrame:
    """Count and mean creation time of odd and of even records per tumbling window."""
    return (lines.transform(parse_lines, lenient=lenient)
                 .transform(with_parity, labels)
                 .transform(window_sums, width, time=time, lateness=lateness)
                 .transform(window_results, now=now, newline=newline))


def throughput(lines: DataFrame, *, width: str = f"{THROUGHPUT_WINDOW_S} seconds",
               time: Column | None = None, lateness: str | None = None, now: Column | None = None,
               lenient: bool = False) -> DataFrame:
    """The windowed mean with a digit sum per record in front of it.

    The digit sum is load and not part of `result`. It is summed into `sum_digit_sum`,
    as Catalyst would leave out a column nobody reads.
    """
    return (lines.transform(parse_lines, lenient=lenient)
                 .transform(with_digit_sum)
                 .transform(with_parity, THROUGHPUT_LABELS)
                 .transform(window_sums, width, time=time, lateness=lateness,
                            totals=("digit_sum",))
                 .transform(window_results, now=now))
