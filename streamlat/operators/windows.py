"""Tumbling windows by key: count, exact sums and whole-number mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlat.functions.exact import exact_sum, integer_mean
from streamlat.functions.lines import format_result


# Milliseconds of the units that a width may have.
UNITS = {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def milliseconds(width: str) -> int:
    """A width such as `6 hours` in milliseconds."""
    n, unit = width.split()
    return int(n) * UNITS[unit.removesuffix("s")]


def created_time() -> Column:
    """Event time of a record: when it was created."""
    return F.timestamp_millis(F.col("created_ms"))


def arrival_time() -> Column:
    """Processing time: the clock of the micro-batch that reads the record."""
    return F.current_timestamp()


def window_sums(df: DataFrame, width: str, *, time: Column | None = None,
                lateness: str | None = None, key: str = "parity",
                totals: tuple[str, ...] = (), start_ms: int = 0) -> DataFrame:
    """Count and sums per tumbling window of `width` and key.

    Windows are counted from the instant `start_ms`, say that of a job's start, and not from 1970.

    `time` is created_time() (default) or arrival_time(). On a stream, `lateness` is how
    long a window waits for late records before it is closed and its state dropped.
    Columns named in `totals` are summed as well.

    Every task combines its rows per window and key before the one shuffle, so two keys
    with half of the rows each send a handful of rows per task and window.
    """
    time = created_time() if time is None else time
    if df.isStreaming and lateness is not None:
        df = df.withColumn("event_time", time).withWatermark("event_time", lateness)
        time = F.col("event_time")
    # The offset of a window must be less than its width.
    window = F.window(time, width, startTime=f"{start_ms % milliseconds(width)} milliseconds")
    # State is dropped by the window's end, so a stream groups by the whole window.
    # A table groups by its start, which is half as much to hash and compare.
    group = window if df.isStreaming else window["start"]
    grouped = df.groupBy(group.alias("w"), F.col(key)).agg(
        F.count(F.lit(1)).alias("n"),
        exact_sum("seq").alias("sum_seq"),
        exact_sum("created_ms").alias("sum_created_ms"),
        *[F.sum(name).alias(f"sum_{name}") for name in totals],
    )
    start = F.col("w.start") if df.isStreaming else F.col("w")
    return grouped.select(
        F.unix_millis(start).alias("window_start_ms"), key, "n", "sum_seq", "sum_created_ms",
        *[f"sum_{name}" for name in totals])


def partial_line(sums: DataFrame) -> DataFrame:
    """A window's sums as text: `sum_seq sum_created_ms`."""
    return sums.withColumn("line", format_result(F.col("sum_seq"), F.col("sum_created_ms")))


def window_mean(sums: DataFrame) -> DataFrame:
    """Add the mean creation time, cut to whole milliseconds."""
    return sums.withColumn("avg_created_ms", integer_mean("sum_created_ms", "n"))
