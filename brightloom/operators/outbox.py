"""The delivery outbox: enqueueing, due rows, state changes and status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import scalars as S

PENDING, SYNCED, DEAD = "pending", "synced", "dead_lettered"


def due_rows(outbox: DataFrame, as_of: datetime, batch_size: int | None = None) -> DataFrame:
    """Pending rows whose next attempt is not in the future, oldest first."""
    now = F.lit(as_of).cast("timestamp")
    due = outbox.filter((F.col("status") == PENDING) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))
    ordered = due.orderBy("created_at", "event_id")
    return ordered if batch_size is None else ordered.limit(batch_size)


def due_events(due: DataFrame, events: DataFrame) -> DataFrame:
    """Events behind the due rows."""
    return events.join(due.select("event_id"), "event_id", "left_semi")


def batch_key(due: DataFrame) -> DataFrame:
    """One row: the key under which a batch of due rows is delivered."""
    return due.agg(
        S.outbox_batch_key(F.min_by("event_id", F.struct("created_at", "event_id")), F.count(F.lit(1))).alias("batch_key"),
        F.count(F.lit(1)).alias("size"),
    )


def enqueue(events: DataFrame, outbox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with blank hashes stamped, and outbox rows for those that have none yet."""
    blank = F.coalesce(F.length(F.trim("content_hash")), F.lit(0)) == 0
    stamp = S.client_content_hash(F.col("user_id"), F.col("type"), F.col("occurred_at"), F.col("payload_json"))
    stamped = events.withColumn("content_hash", F.when(blank, stamp).otherwise(F.col("content_hash")))
    rows = stamped.join(outbox.select("event_id"), "event_id", "left_anti").select(
        "event_id",
        F.col("content_hash").alias("payload_hash"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(None).cast("timestamp").alias("next_attempt_at"),
        F.lit(PENDING).alias("status"),
        F.col("occurred_at").alias("created_at"),
    )
    return stamped, rows


def apply_outcomes(outbox: DataFrame, responses: DataFrame, as_of: datetime, jitter: Column) -> DataFrame:
    """Outbox after the responses `(event_id, http_status, error)`; rows without one stay.

    Success ends a row, a permanent refusal buries it, anything else counts an attempt and
    either schedules the next one or buries the row at the attempt limit.
    """
    now = F.lit(as_of).cast("timestamp")
    joined = outbox.join(responses, "event_id", "left").withColumn(
        "outcome", F.when(F.col("http_status").isNotNull(), S.delivery_outcome(F.col("http_status")))
    )
    retried = F.col("outcome").isin("auth", "transient")
    attempts = F.when(retried, F.col("attempts") + 1).otherwise(F.col("attempts"))
    buried = (F.col("outcome") == "permanent") | (retried & (attempts >= S.MAX_ATTEMPTS))
    delay = F.make_dt_interval(secs=S.retry_delay_seconds(attempts, jitter).cast("decimal(18,6)"))
    return joined.select(
        "event_id",
        attempts.alias("attempts"),
        F.when(F.col("outcome").isNull(), F.col("status"))
        .when(F.col("outcome") == "success", SYNCED)
        .when(buried, DEAD)
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(F.col("outcome").isNull(), F.col("next_attempt_at"))
        .when(retried & ~buried, now + delay)
        .alias("next_attempt_at"),
        F.when(F.col("outcome").isNull(), F.col("last_error"))
        .when(F.col("outcome") != "success", F.col("error"))
        .alias("last_error"),
        "created_at",
    )


def snapshot(outbox: DataFrame, last_success_at: datetime | None = None, last_error: str | None = None) -> DataFrame:
    """One status row: pending and buried rows, last success, last error."""
    return outbox.agg(
        F.count_if(F.col("status") == PENDING).alias("pending"),
        F.count_if(F.col("status") == DEAD).alias("dead_lettered"),
    ).select(
        "pending",
        "dead_lettered",
        F.lit(last_success_at).cast("timestamp").alias("last_success_at"),
        F.lit(last_error).cast("string").alias("last_error"),
    )
