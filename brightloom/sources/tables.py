"""Columnar tables: reading with one timestamp type, and portable output columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.session import ensure_settings


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read `{root}/{name}.parquet`; zone-less timestamps are taken as UTC instants."""
    ensure_settings(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    for column in zoneless:
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def portable(df: DataFrame) -> DataFrame:
    """Plain result columns for exchange: micros for instants, text for days, 0/1 for flags."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.unix_micros(column.cast("timestamp"))
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.BooleanType):
            column = column.cast("int")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            column = F.array_join(column, "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)
