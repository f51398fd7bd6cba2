"""A look into the state of a stopped stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlat.functions.exact import combine


def open_windows(spark: SparkSession, checkpoint: str, *, key: str = "parity",
                 totals: tuple[str, ...] = ()) -> DataFrame:
    """Count and sums so far of the windows that `window_sums` had open when the stream of `checkpoint` stopped.

    The state has the buffers of the aggregates in their order: the count, three parts of each exact sum, and
    a sum for each of `totals`.
    """
    state = spark.read.format("statestore").load(checkpoint)
    window, label = (F.col("key")[f.name] for f in state.schema["key"].dataType)
    buffers = [f"buffer{i}" for i in range(7 + len(totals))]
    # Several buffers may have one name, so they are renamed by a cast, which goes by place.
    kinds = [f.dataType.simpleString() for f in state.schema["value"].dataType]
    value = F.col("value").cast(f"struct<{', '.join(f'{b}: {k}' for b, k in zip(buffers, kinds))}>")
    named = state.select(F.unix_millis(window["start"]).alias("window_start_ms"), label.alias(key),
                         value.alias("value")).select("window_start_ms", key, "value.*")
    return named.select(
        "window_start_ms", key, F.col(buffers[0]).alias("n"), combine(*buffers[1:4]).alias("sum_seq"),
        combine(*buffers[4:7]).alias("sum_created_ms"),
        *[F.col(name).alias(f"sum_{total}") for name, total in zip(buffers[7:], totals)])


def state_sizes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Name, partitions and batches of each state in a checkpoint."""
    return spark.read.format("state-metadata").load(checkpoint).select(
        "operatorName", "stateStoreName", "numPartitions", "minBatchId", "maxBatchId")
