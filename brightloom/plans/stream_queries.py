"""Streaming jobs run over the event table until it is read, compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brightloom.functions.scalars import scan_int_field
from brightloom.plans.derived import VIEWS
from brightloom.plans.event_queries import _ACCEPTED, GAP_SECONDS
from brightloom.plans.registry import query
from brightloom.session import ensure_checkpoint_dir
from brightloom.sources.events import write_event_lines
from brightloom.streaming import jobs
from brightloom.streaming import sources as S


def _folder(t, name: str) -> str:
    """A fresh folder next to the session's checkpoints, shared by all executors."""
    return f"{ensure_checkpoint_dir(t.spark)}/streams/{name}-{uuid.uuid4().hex}"


def _typed_stream(t):
    schema = t.spark.read.parquet(f"{t.root}/events.parquet").schema
    events = S.growing_table(t.spark, t.root, schema, "events.parquet")
    return t.spark.sql(VIEWS["typed_events"][1], events=events)


LATE_HOURS = 24


def _in_rounds(t, name: str, run) -> None:
    """All typed events land in three rounds, oldest first, and `run(stream)` follows each.

    Of the last hours of a round one event in three lands a round late, and all others land again in the next.
    """
    landing, events = _folder(t, name), t("typed_events")
    low, high = events.agg(F.unix_micros(F.min("occurred_at")), F.unix_micros(F.max("occurred_at"))).first()
    at, width = F.unix_micros("occurred_at"), (high - low) // 3 + 1
    own = F.floor((at - low) / width)
    tail = (at - low) - own * width > width - LATE_HOURS * 1_800_000_000
    for k in range(3):
        late = tail & (F.xxhash64("event_id") % 3 == 0)
        lands = (own == k) & ((~late) | F.lit(k == 2)) | (own == k - 1) & tail
        events.filter(lands).write.mode("append").parquet(landing)
        run(S.growing_table(t.spark, landing, events.schema))


@query(
    f"SELECT event_id, user_id, type, epoch_us(occurred_at) AS occurred_at, payload_json, seq FROM ({_ACCEPTED}) WHERE accepted",
    ("incoming_events",),
)
def stream_ledger(t):
    """Deliveries arrive as a stream of files, in two rounds; the ledger ends up without repetitions."""
    landing, ledger, checkpoint = _folder(t, "landing"), _folder(t, "ledger"), _folder(t, "ledger-checkpoint")
    incoming = t("incoming_events")
    first_round = F.col("seq") < 100_000_000_000
    for part in (first_round, ~first_round):
        incoming.filter(part).write.mode("append").parquet(landing)
        stream = S.growing_table(t.spark, landing, incoming.schema)
        jobs.run_available(jobs.start(stream, jobs.ledger_writer(ledger), checkpoint))
    return t.spark.read.parquet(ledger).select("event_id", "user_id", "type", "occurred_at", "payload_json", "seq")


@query(
    """SELECT user_id, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, type, count(*) AS events FROM typed_events GROUP BY ALL""",
    ("typed_events",),
)
def stream_daily_counters(t):
    keys = ["user_id", "day", "type"]
    out = _folder(t, "daily")
    writer = jobs.start(jobs.daily_counters(_typed_stream(t)), jobs.batch_writer(out), _folder(t, "daily-checkpoint"), "update")
    jobs.run_available(writer)
    return jobs.current_counters(t.spark, out, keys)


@query(
    """WITH g AS (SELECT user_id, occurred_at, seq,
              CASE WHEN occurred_at <= lag(occurred_at) OVER w + INTERVAL '12' HOUR THEN 0 ELSE 1 END AS opens
            FROM typed_events WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, seq)),
          n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY occurred_at, seq ROWS UNBOUNDED PRECEDING) AS s FROM g)
       SELECT user_id, epoch_us(min(occurred_at)) AS started_at, epoch_us(max(occurred_at)) AS ended_at, count(*) AS event_count FROM n GROUP BY user_id, s""",
    ("typed_events",),
)
def stream_sessions(t):
    """Sessions of a stream in three rounds with late and repeated events: the closed ones as put out, the open ones from the state."""
    out, checkpoint = _folder(t, "sessions"), _folder(t, "sessions-checkpoint")

    def run(stream):
        jobs.run_available(jobs.start(jobs.session_counters(stream, GAP_SECONDS, f"{LATE_HOURS} hours"), jobs.batch_writer(out), checkpoint))

    _in_rounds(t, "sessions-landing", run)
    return jobs.current_sessions(t.spark, out, checkpoint).drop("open")


@query(
    """SELECT user_id, event_id, type, epoch_us(occurred_at) AS occurred_at, seq FROM typed_events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, seq DESC) <= 3""",
    ("typed_events",),
)
def stream_ticker(t):
    out, checkpoint = _folder(t, "ticker"), _folder(t, "ticker-checkpoint")
    _in_rounds(t, "ticker-landing", lambda stream: jobs.run_available(jobs.start(stream, jobs.ticker_writer(out), checkpoint)))
    return jobs.current_ticker(t.spark, out)


@query(
    """SELECT type, count(*) AS events, CAST(sum(CAST(regexp_extract(payload_json, '"level":([0-9]+)', 1) AS INT)) AS BIGINT) AS levels FROM typed_events GROUP BY type""",
    ("typed_events",),
)
def stream_landed_lines(t):
    """Events written as JSON lines and read back as a stream of landed files."""
    landing, out = _folder(t, "lines"), _folder(t, "parsed")
    write_event_lines(t("typed_events"), landing)
    events = S.event_stream(S.landed_lines(t.spark, landing), "{}")
    jobs.run_available(jobs.start(events, jobs.batch_writer(out), _folder(t, "lines-checkpoint")))
    level = scan_int_field(F.col("payload_json"), "level")
    return t.spark.read.parquet(out).groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.sum(level).alias("levels"))
