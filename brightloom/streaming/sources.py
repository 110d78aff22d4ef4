"""Event streams: landed files, sockets, message brokers, and tables read as they grow."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.sources.events import parse_event_lines


def landed_lines(spark: SparkSession, folder: str, since: datetime | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Lines of files that land in a folder; `since` skips what was there before.

    Files are written whole, so there is no half line to wait for, and the checkpoint keeps
    the place.
    """
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(folder)
    if since is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time") >= F.lit(since).cast("timestamp"))
    return lines.select("value")


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket, for trials: a socket cannot be read again after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def broker_lines(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Lines from a Kafka topic, where the session has the connector."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def event_stream(lines: DataFrame, default_payload: str, verbatim_payload: bool = False) -> DataFrame:
    """Accepted events of a line stream; a line without a usable time gets the current one."""
    parsed = parse_event_lines(lines, F.current_timestamp(), default_payload, verbatim_payload)
    return parsed.filter("accepted").select("type", "occurred_at", "payload_json")


def growing_table(spark: SparkSession, folder: str, schema: T.StructType, file_pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A columnar table as a stream of the files added to it."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(folder)
    for field in schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df
