"""Lines and result lines from Kafka topics. Needs Spark's Kafka connector on the classpath."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlat.functions.lines import record_value
from streamlat.operators.records import message_lines


def source_options(servers: str, topics: str | Iterable[str], *, starting: str = "latest",
                   min_partitions: int | None = None, max_per_trigger: int | None = None,
                   **consumer: str) -> dict[str, str]:
    """Reader options. `topics` is one name, a comma list or several names.

    `min_partitions` cuts large topic partitions into several tasks, so one partition
    with most of the records does not become one long task. Offsets are kept in the
    query's checkpoint, not committed to the broker. Keyword arguments are consumer
    settings, written with underscores: `session_timeout_ms="30000"`.
    """
    names = topics.split(",") if isinstance(topics, str) else list(topics)
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(name.strip() for name in names),
        "startingOffsets": starting,
    }
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options | {f"kafka.{k.replace('_', '.')}": v for k, v in consumer.items()}


def kafka_messages(spark: SparkSession, servers: str, topics: str | Iterable[str],
                   *, streaming: bool = True, **options) -> DataFrame:
    """Messages as Spark's Kafka source gives them. `streaming=False` reads what is there."""
    if not streaming:
        options.setdefault("starting", "earliest")
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**source_options(servers, topics, **options)).load()


def kafka_lines(spark: SparkSession, servers: str, topics: str | Iterable[str],
                **options) -> DataFrame:
    """`line` of every message."""
    return message_lines(kafka_messages(spark, servers, topics, **options))


def result_lines(messages: DataFrame) -> DataFrame:
    """`line` and the broker's `timestamp` of result messages."""
    return messages.select(record_value(F.col("value")).alias("line"), "timestamp")


def kafka_results(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Result lines with the broker's time stamp."""
    return result_lines(kafka_messages(spark, servers, topic, **options))
