"""Kafka readers and writers as option builders.

The connector jar is not part of PySpark: add ``spark-sql-kafka-0-10`` to the cluster.
Every operator only needs the columns of a Kafka read, so a file stream of the same
schema takes its place in tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter

from ..functions.constants import FEATURE_TOPIC, INGEST_TOPICS

LOG_SCHEMA = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"


def telemetry_source(spark: SparkSession, servers: str, topic: str = "raw.telemetry", starting: str = "latest") -> DataStreamReader:
    """One topic from the newest message on."""
    return log_source(spark, servers, [topic], starting)


def log_source(
    spark: SparkSession, servers: str, topics: list[str] | None = None, starting: str = "earliest",
    max_offsets: int | None = None, min_partitions: int | None = None,
) -> DataStreamReader:
    """Several topics from the oldest message on; progress lives in the query's checkpoint.

    ``min_partitions`` splits a large topic partition over several tasks.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics or INGEST_TOPICS))
        .option("startingOffsets", starting)
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    if min_partitions is not None:
        reader = reader.option("minPartitions", min_partitions)
    return reader


def sink(messages: DataFrame, servers: str, checkpoint: str, topic: str | None = FEATURE_TOPIC) -> DataStreamWriter:
    """Append key/value rows to a topic; with ``topic=None`` each row names its own."""
    writer = (
        messages.writeStream.format("kafka")
        .outputMode("append")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.enable.idempotence", "true")
        .option("kafka.compression.type", "lz4")
        .option("checkpointLocation", checkpoint)
    )
    return writer if topic is None else writer.option("topic", topic)
