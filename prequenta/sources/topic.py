"""Message topics. Thin wrappers over Spark's Kafka connector, which the cluster must provide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.operators.parse import publish_payload

# Fixed value: the topic the application reads and writes.
TOPIC = "auto_trnx"


def message_lines(messages: DataFrame) -> DataFrame:
    """The message body as text in ``value``; the key is ignored."""
    return messages.select(F.col("value").cast("string").alias("value"))


def read_topic(
    spark: SparkSession,
    servers: str,
    topic: str = TOPIC,
    starting_offsets: str = "latest",
    max_per_batch: int | None = None,
    **options: str,
) -> DataFrame:
    """A stream of message bodies. ``max_per_batch`` bounds a micro-batch after a backlog."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .options(**options)
    )
    if max_per_batch is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_batch)
    return message_lines(reader.load())


def write_topic(lines: DataFrame, servers: str, topic: str = TOPIC, line: str = "value") -> None:
    """Publish one message per line."""
    (
        publish_payload(lines, line)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
