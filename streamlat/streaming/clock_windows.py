"""Tumbling windows of arrival that the clock closes, also when no record follows.

A window closes with a batch after its end, and a batch comes with each row of a source. So
the records are joined by a heartbeat: one row a second without values, which is in no window's
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlat.operators.windows import arrival_time, window_sums

# Batches do not go back in time, so no record arrives after its window's end, unless the
# driver's clock is set back by more than a window.
NO_LATENESS = "0 seconds"


def with_heartbeat(records: DataFrame) -> DataFrame:
    """The records of a stream, and one row a second in which all their columns are NULL."""
    beat = (records.sparkSession.readStream.format("rate").option("rowsPerSecond", 1)
            .option("numPartitions", 1).load())
    return records.unionByName(beat.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema]))


def clock_window_sums(records: DataFrame, width: str, *,
                      totals: tuple[str, ...] = ()) -> DataFrame:
    """`window_sums` by arrival of labelled records, closed within a second or so and a batch of their end."""
    sums = window_sums(with_heartbeat(records), width, time=arrival_time(),
                       lateness=NO_LATENESS, totals=totals)
    # A condition on the key would be pushed below the watermark and take the heartbeat away.
    return sums.where(F.col("sum_seq").isNotNull())
