"""Results to a Kafka topic. Needs Spark's Kafka connector on the classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

# Fixed value: the topic results are sent to.
RESULT_TOPIC = "testRes"

# The producer settings of the micro-batch jobs.
PRODUCER = {
    "retries": "0",
    "batch.size": "16384",
    "linger.ms": "0",
    "buffer.memory": "33554432",
}


def sink_options(servers: str, topic: str = RESULT_TOPIC, *, acks: str = "all",
                 **producer: str) -> dict[str, str]:
    """Writer options. `acks="0"` sends without waiting for the broker.

    Keyword arguments change producer settings, written with underscores.
    """
    settings = PRODUCER | {k.replace("_", "."): v for k, v in producer.items()}
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": acks,
    } | {f"kafka.{k}": v for k, v in settings.items()}


def kafka_rows(results: DataFrame) -> DataFrame:
    """`value STRING` without a key. The broker stamps the message; our own time is in it."""
    return results.selectExpr("result AS value")


def to_kafka(results: DataFrame, servers: str, topic: str = RESULT_TOPIC,
             **options: str) -> DataStreamWriter:
    """Send `result` to a topic, at least once."""
    return (kafka_rows(results).writeStream.format("kafka").outputMode("append")
            .options(**sink_options(servers, topic, **options)))
