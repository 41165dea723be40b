"""Kafka in and out. The connector comes with the cluster; here only options are built.

Offsets live in the checkpoint of the query, so a log counts as read once the
sink of its micro-batch is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter

LOG_TOPIC = "logs.raw"
METRIC_TOPIC = "logs.metrics.window"
ALERT_TOPIC = "alerts"


def read_options(servers: str, topic: str, max_offsets: int | None = None) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "kafka.isolation.level": "read_committed",
    }
    if max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def stream_reader(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataStreamReader:
    return spark.readStream.format("kafka").options(**read_options(servers, topic, max_offsets))


def raw_lines(kafka: DataFrame) -> DataFrame:
    """Kafka rows as (ord, source_ts, raw).

    Arrival order is the broker's timestamp, then partition, then offset, whole:
    ``ord`` is a struct of the three, which orders like its fields. Tables made
    from it are read back with ``schemas.arrived`` of their schema.
    """
    return kafka.select(
        F.struct("timestamp", "partition", "offset").alias("ord"),
        F.col("timestamp").alias("source_ts"),
        F.col("value").cast("string").alias("raw"),
    )


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, value) rows with every column in the JSON; a log has no key."""
    value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select((F.col(key) if key else F.lit(None)).cast("string").alias("key"), value.alias("value"))


def log_messages(logs: DataFrame) -> DataFrame:
    """Logs as (key, value) rows in their canonical JSON, which the parser and the review read back."""
    return to_messages(logs.select("ts", "service", "level", "message", F.col("latency_ms").alias("latencyMs"), "stacktrace"))


def write_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}


def stream_writer(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """At-least-once; consumers drop repeats by the key columns inside the value."""
    options = write_options(servers, topic) | {"checkpointLocation": checkpoint}
    return messages.writeStream.format("kafka").options(**options)


def write_batch(messages: DataFrame, servers: str, topic: str) -> None:
    messages.write.format("kafka").options(**write_options(servers, topic)).save()
