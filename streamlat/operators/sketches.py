"""Quantiles of latency from sketches that can be put together.

A KLL sketch has a bounded size, whatever it has seen, and the sketch of two sets together is made from their
two sketches. So it is the state of a window on a stream, and wider windows come from narrower ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlat.operators.windows import created_time

# Entries of a sketch's widest level: ranks are off by about one percent of the rows, at most.
SIZE = 400
QUANTILES = (0.5, 0.95, 0.99)


def latency_sketches(df: DataFrame, width: str, *, time: Column | None = None, lateness: str | None = None,
                     key: str = "parity", value: str = "latency_ms", size: int = SIZE) -> DataFrame:
    """Rows and sketch of `value` for each tumbling window and key. Missing values count as rows only."""
    time = created_time() if time is None else time
    if df.isStreaming and lateness is not None:
        df = df.withColumn("event_time", time).withWatermark("event_time", lateness)
        time = F.col("event_time")
    window = F.window(time, width).alias("w")
    return df.groupBy(window, key).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(value, F.lit(size)).alias("sketch"),
    ).select(F.unix_millis("w.start").alias("window_start_ms"), key, "n", "sketch")


def wider(sketches: DataFrame, width_ms: int, *, key: str = "parity") -> DataFrame:
    """Sketches of windows of `width_ms` from those of windows that fit into them."""
    start = F.col("window_start_ms") - F.pmod("window_start_ms", F.lit(width_ms))
    return sketches.groupBy(start.alias("window_start_ms"), key).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, *ranks: float) -> DataFrame:
    """`p50` and so on for each of the ranks, in place of the sketch."""
    return sketches.select("*", *[
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(f"p{q * 100:g}") for q in ranks or QUANTILES
    ]).drop("sketch")
