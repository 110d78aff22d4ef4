"""Streaming jobs: the ledger, daily counters, sessions and the ticker.

Sinks write one folder per micro-batch and replace it when a batch is run again after a
failure, so every job may be stopped and restarted at any point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from brightloom.operators.ledger import accept_events

BATCH = "batch_id"


def _earlier(spark: SparkSession, folder: str, batch_id: int, schema) -> DataFrame | None:
    """Rows written by batches before this one, or None when there are none."""
    try:
        rows = spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.filter(F.col(BATCH) < batch_id)


def _write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(BATCH).parquet(folder)


LEDGER_SCHEMA = (
    "event_id string, user_id long, type string, occurred_at timestamp, payload_json string, seq long, "
    "content_hash string, received_at timestamp, batch_id long"
)


def ledger_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: insert a batch into the ledger, ignoring what it already holds.

    Every event is accepted however late it is: there is no watermark, the whole ledger is
    the memory. Only its key columns are read. A batch that was written before it failed
    finds only older batches and writes the same rows again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = _earlier(batch.sparkSession, folder, batch_id, LEDGER_SCHEMA)
        keys = None if stored is None else stored.select("event_id", "user_id", "content_hash")
        decided = accept_events(batch, keys)
        rows = decided.filter("accepted").drop("accepted").withColumn("received_at", F.current_timestamp())
        _write_batch(rows, folder, batch_id)

    return write


def daily_counters(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """Events per user, UTC day and type, for update mode; `lateness` bounds the state kept."""
    if lateness is not None:
        events = events.withWatermark("occurred_at", lateness)
    keys = ["user_id", F.window("occurred_at", "1 day").alias("_day"), "type"]
    counted = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    return counted.select("user_id", F.to_date("_day.start").alias("day"), "type", "events")


SESSION_SCHEMA = "user_id long, started_at timestamp, ended_at timestamp, event_count long, batch_id long"


def session_counters(events: DataFrame, gap_seconds: int, lateness: str) -> DataFrame:
    """Sessions as they close, each once, for append mode.

    The state holds, by user, the sessions that may still grow: an event that falls between two
    of them makes them one. A session closes when the watermark, `lateness` behind the latest event, has passed its
    last event by the gap; with it its state goes. Repeated events (of one user and id) count once
    as long as they come within the watermark, later ones are dropped as late. Two events exactly a
    gap apart are one session. Events of a user are merged in each task before they are shuffled.
    """
    once = events.withWatermark("occurred_at", lateness).dropDuplicatesWithinWatermark(["user_id", "event_id"])
    window = F.session_window("occurred_at", f"{gap_seconds} seconds")
    counted = once.groupBy("user_id", window.alias("_session")).agg(
        F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"), F.count(F.lit(1)).alias("event_count")
    )
    return counted.drop("_session")


def closed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """What `session_counters` has put out so far."""
    return spark.read.schema(SESSION_SCHEMA).parquet(folder)


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sessions that may still grow, read from the job's state as of its last finished batch; no events are read."""
    state = spark.read.format("statestore").option("operatorId", 0).load(checkpoint)
    return state.select("value.*").toDF("user_id", "_session", "started_at", "ended_at", "event_count").drop("_session")


def current_sessions(spark: SparkSession, folder: str, checkpoint: str) -> DataFrame:
    """All sessions, open ones with `open`. What a batch put out before it failed is still in the state, and counts as open."""
    finished = spark.read.format("state-metadata").load(checkpoint).agg(F.max("maxBatchId")).first()[0]
    closed = closed_sessions(spark, folder).filter(F.col(BATCH) <= finished).drop(BATCH)
    return closed.withColumn("open", F.lit(False)).unionByName(open_sessions(spark, checkpoint).withColumn("open", F.lit(True)))


def batch_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: keep what each micro-batch put out, such as the counters it changed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, folder, batch_id)

    return write


def current_counters(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The last value written for every key."""
    written = spark.read.parquet(folder)
    rest = [c for c in written.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_newest"))
    return newest.select(*keys, "_newest.*").drop(BATCH)


TICKER_SCHEMA = "user_id long, event_id string, type string, occurred_at timestamp, seq long, batch_id long"


def _snapshot(spark: SparkSession, folder: str, batch_id: int, schema: str) -> DataFrame | None:
    """The table one batch left, found by its path alone, or None if there is none."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{BATCH}={batch_id}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def ticker_writer(folder: str, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: the last `keep` events of every user, newest first.

    The state is a table of at most `keep` rows per user, written whole by each batch; a batch opens
    the one before it and no other. An event delivered again counts once. Ranking cuts each task's rows to
    `keep` per user before they are shuffled, so a busy user is no burden on one task.
    """
    columns = ["user_id", "event_id", "type", "occurred_at", "seq"]

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*columns)
        earlier = _snapshot(batch.sparkSession, folder, batch_id - 1, TICKER_SCHEMA)
        if earlier is not None:
            rows = rows.unionByName(earlier.select(*columns))
        rows = rows.dropDuplicates(columns)
        last = Window.partitionBy("user_id").orderBy(F.desc("occurred_at"), F.desc("seq"))
        kept = rows.withColumn("_nr", F.row_number().over(last)).filter(F.col("_nr") <= keep).drop("_nr")
        kept.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch_id}")

    return write


def current_ticker(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(TICKER_SCHEMA).parquet(folder)
    return rows.filter(F.col(BATCH) == rows.agg(F.max(BATCH)).scalar()).drop(BATCH)


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """A stream writer that runs `write` on every micro-batch and keeps its place."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)


def run_available(writer: DataStreamWriter) -> None:
    """Process everything there is, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
