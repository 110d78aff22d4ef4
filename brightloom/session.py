"""Session settings, lineage cuts and the helpers that keep hot keys apart."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on: UTC days, run-time re-planning, skew splitting, and a bound on the bytes that
# are in a Python worker at once. By rows alone a batch holds ten thousand texts or vectors of any length.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

# A key with more rows than this is spread over several tasks by `lookup_join`.
HOT_KEY_ROWS = 1_000_000


def build_session(master: str, app_name: str = "brightloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in {**SESSION_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_settings(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else has built."""
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage cuts are written to: the cluster's own, if it names one.

    Only a local session without a setting gets a folder made here. A cluster has to
    name a shared one, because a folder on one machine is lost with that machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="brightloom-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a columnar table into the checkpoint folder and go on from the table.

    Unlike a checkpointed RDD the table can be read column by column, and its size is known,
    so the planner does not take an exploded table for a small one and broadcast it.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Keys held by more than `hot_rows` rows, with the number of tasks to spread them over.

    There are at most `rows / hot_rows` of them, so the result stays small enough to
    broadcast: a hundred thousand keys for 10^11 rows at the default.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int").alias("_spread"))
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    spread_by: Column,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Join many rows to a keyed table when one key may hold a large share of `left`.

    Run-time skew splitting does not apply once `right` comes straight out of an
    aggregation on the same keys, so hot keys are found first; their left rows are dealt
    out by `spread_by` and only their right rows are copied. Other keys are shuffled once.
    """
    hot = F.broadcast(hot_keys(left, keys, hot_rows))
    dealt = left.join(hot, keys, "left").withColumn(
        "_part", F.when(F.col("_spread").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread_by), F.col("_spread")).cast("int"))
    )
    copied = (
        right.join(hot, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_spread"), F.lit(1)) - 1)))
        .drop("_spread")
    )
    return dealt.drop("_spread").join(copied, [*keys, "_part"], how).drop("_part")
