"""Reading messages: JSON in a topic, or JSON lines in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadweave import schemas


def parse_messages(raw: DataFrame, value: str = "value", schema: str = schemas.READING) -> DataFrame:
    """Binary or text JSON -> typed columns; an unreadable message gives NULL columns."""
    return raw.select(F.from_json(F.col(value).cast("string"), schema).alias("message")).select("message.*")


def read_topic_stream(
    spark: SparkSession, servers: str, topic: str = "traffic-data", offsets: str = "latest",
    group: str | None = None, max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of readings from a topic (the connector package must be on the classpath)."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", offsets)
    )
    if group:
        reader = reader.option("kafka.group.id", group)
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return parse_messages(reader.load())


def read_file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same stream from JSON lines files."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_messages(reader.load(path))


def read_message_files(spark: SparkSession, path: str) -> DataFrame:
    return parse_messages(spark.read.text(path))


def as_messages(readings: DataFrame, location_name=None) -> DataFrame:
    """One JSON ``value`` per row; ``location_name`` (a column) is merged into the record."""
    if location_name is not None:
        readings = readings.withColumn("location_name", location_name)
    return readings.select(F.to_json(F.struct("*")).alias("value"))


def publish(messages: DataFrame, servers: str, topic: str = "traffic-data") -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_stream(messages: DataFrame, servers: str, checkpoint: str, topic: str = "traffic-data") -> StreamingQuery:
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def write_message_files(messages: DataFrame, path: str, mode: str = "append") -> None:
    messages.write.mode(mode).text(path)
