"""Lines from a TCP server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamlat.operators.records import rescale

# Where the line server listens.
LINE_HOST = "localhost"
LINE_PORT = 9999


def socket_lines(spark: SparkSession, host: str = LINE_HOST, port: int = LINE_PORT,
                 *, partitions: int | None = None, received: bool = False) -> DataFrame:
    """`line` per line received; with `received`, also the `timestamp` of its receipt.

    The socket source cannot replay: what was received and not yet processed is lost
    with the driver. `partitions` spreads the rows over that many tasks.
    """
    reader = spark.readStream.format("socket").option("host", host).option("port", port)
    if received:
        reader = reader.option("includeTimestamp", True)
    lines = reader.load().withColumnRenamed("value", "line")
    return rescale(lines, partitions) if partitions else lines
