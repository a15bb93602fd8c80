"""Kafka source and sink of alert events (needs the Kafka connector on the classpath)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, servers: str, topic: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """Streaming JSON values from the earliest offset; ``per_trigger`` bounds a micro-batch."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "earliest")
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select(
        F.from_json(F.col("value").cast("string"), schema).alias("r"), F.col("timestamp").alias("enqueued_at")
    ).select("r.*", "enqueued_at")


def write_events(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "event_id"):
    return (
        df.select(F.col(key).alias("key"), F.to_json(F.struct("*")).alias("value"))
        .writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
