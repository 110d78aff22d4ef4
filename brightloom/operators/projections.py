"""Read-side views of the event table: counts, playtime, timelines, logs and pages."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import scalars as S


def _window_start(as_of: date, days: int) -> Column:
    """First instant of the `days` calendar days that end with the day of `as_of`."""
    return F.date_sub(F.lit(as_of).cast("date"), days - 1).cast("timestamp")


def for_user(df: DataFrame, user_id) -> DataFrame:
    """Rows of one user; every other view also keeps `user_id` in its keys and serves all."""
    return df.filter(F.col("user_id") == user_id)


def events_per_day(events: DataFrame, as_of: date, days: int) -> DataFrame:
    """Events per user and day in the trailing days; days without events are absent."""
    recent = events.filter(F.col("occurred_at") >= _window_start(as_of, days))
    return recent.groupBy("user_id", S.utc_day(F.col("occurred_at")).alias("day")).agg(F.count(F.lit(1)).alias("events"))


def playtime_per_day(sessions: DataFrame, as_of: date, days: int) -> DataFrame:
    """Minutes of closed sessions, the whole session credited to the day it started."""
    recent = sessions.filter((F.col("started_at") >= _window_start(as_of, days)) & F.col("ended_at").isNotNull())
    minutes = S.minutes_between(F.col("started_at"), F.col("ended_at"))
    return recent.groupBy("user_id", S.utc_day(F.col("started_at")).alias("day")).agg(F.sum(minutes).alias("minutes"))


def dashboard_totals(events: DataFrame, sessions: DataFrame, as_of: date, days: int, level_type: str) -> DataFrame:
    """Per user: events and minutes of the trailing days, and the highest level of all time."""
    recent = F.col("occurred_at") >= _window_start(as_of, days)
    level = F.when(F.col("type") == level_type, S.scan_int_field(F.col("payload_json"), "level"))
    counted = events.groupBy("user_id").agg(
        F.count_if(recent).alias("total_events"), F.coalesce(F.max(level), F.lit(0)).alias("max_level")
    )
    played = playtime_per_day(sessions, as_of, days).groupBy("user_id").agg(F.sum("minutes").alias("total_minutes"))
    return counted.join(played, "user_id", "full").select(
        "user_id",
        F.coalesce("total_events", F.lit(0)).alias("total_events"),
        F.coalesce("total_minutes", F.lit(0.0)).alias("total_minutes"),
        F.coalesce("max_level", F.lit(0)).alias("max_level"),
    )


def daily_rollup(events: DataFrame) -> DataFrame:
    """The declared daily counter per user, day and type."""
    keys = ["user_id", S.utc_day(F.col("occurred_at")).alias("day"), "type"]
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))


def distinct_types(events: DataFrame) -> DataFrame:
    return events.select("user_id", "type").distinct().orderBy("user_id", "type")


def distinct_sources(events: DataFrame) -> DataFrame:
    """Sources per user ignoring case, empty ones dropped, in the spelling met first."""
    source = F.coalesce(S.scan_string_field(F.col("payload_json"), "source"), F.lit(""))
    named = events.select("user_id", "seq", source.alias("source")).filter(F.col("source") != "")
    return (
        named.groupBy("user_id", F.lower("source").alias("_folded"))
        .agg(F.min_by("source", "seq").alias("source"))
        .orderBy("user_id", "_folded")
        .drop("_folded")
    )


def level_progression(events: DataFrame, level_type: str) -> DataFrame:
    """Levels in order of occurrence; payloads without a readable level are skipped."""
    level = S.scan_int_field(F.col("payload_json"), "level")
    return (
        events.filter(F.col("type") == level_type)
        .select("user_id", "event_id", "occurred_at", level.alias("level"))
        .filter(F.col("level").isNotNull())
        .orderBy("user_id", "occurred_at", "event_id")
    )


def play_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Contiguous sessions per user: a pause longer than the gap starts a new one.

    Events are first counted into slots as wide as the gap. No two events of a slot are
    further apart than that, so a slot never spans two sessions, and only one row per user
    and slot reaches the window below however many events a single user has.
    """
    micros = F.unix_micros("occurred_at")
    slots = events.groupBy("user_id", F.floor(micros / F.lit(gap_seconds * 1_000_000)).alias("slot")).agg(
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
        F.count(F.lit(1)).alias("events"),
    )
    in_order = Window.partitionBy("user_id").orderBy("slot")
    pause = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(in_order))
    opens = F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = slots.withColumn("_opens", opens).withColumn(
        "session_no", F.sum("_opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy("user_id", "session_no")
        .agg(
            F.min("first_at").alias("started_at"),
            F.max("last_at").alias("ended_at"),
            F.sum("events").alias("event_count"),
        )
        .withColumn("session_id", F.concat_ws("-", F.col("user_id").cast("string"), F.col("session_no").cast("string")))
    )


def newest_sessions(sessions: DataFrame, limit: int) -> DataFrame:
    """The `limit` sessions of each user that started last."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("started_at"), "session_id")
    return sessions.withColumn("_nr", F.row_number().over(newest)).filter(F.col("_nr") <= limit).drop("_nr")


def session_timeline(
    sessions: DataFrame,
    events: DataFrame,
    as_of: datetime,
    session_limit: int = 20,
    events_per_session: int = 50,
    slot_seconds: int = 86_400,
) -> DataFrame:
    """Newest sessions with their newest events; both session ends are inclusive.

    An open session runs to `as_of`; an event inside two sessions is listed in both; a
    session without events keeps one row with NULL event columns. The range condition is
    met on time slots, so the join has an equality key narrower than the user.
    """
    shown = newest_sessions(sessions, session_limit)
    slot_width = F.lit(slot_seconds * 1_000_000)

    def slot(instant: Column) -> Column:
        return F.floor(F.unix_micros(instant) / slot_width)

    until = F.coalesce(F.col("ended_at"), F.lit(as_of).cast("timestamp"))
    spans = shown.select("session_id", "user_id", "started_at", until.alias("_until")).filter(
        F.col("_until") >= F.col("started_at")
    )
    spans = spans.withColumn("_slot", F.explode(F.sequence(slot(F.col("started_at")), slot(F.col("_until")))))
    slotted = events.select("user_id", "event_id", "type", "occurred_at", "payload_json").withColumn(
        "_slot", slot(F.col("occurred_at"))
    )
    inside = spans.join(slotted, ["user_id", "_slot"]).filter(
        F.col("occurred_at").between(F.col("started_at"), F.col("_until"))
    )
    newest = Window.partitionBy("session_id").orderBy(F.desc("occurred_at"), "event_id")
    listed = (
        inside.withColumn("event_rank", F.row_number().over(newest))
        .filter(F.col("event_rank") <= events_per_session)
        .select("session_id", "event_rank", "event_id", "type", "occurred_at", "payload_json")
    )
    return shown.join(listed, "session_id", "left")


def achievement_list(achievements: DataFrame, catalogue: DataFrame, default_text: str = "Custom achievement.") -> DataFrame:
    """Stored achievements with title and description, unlocked ones first, then by code."""
    return (
        achievements.join(catalogue, "code", "left")
        .withColumn("title", F.coalesce("title", "code"))
        .withColumn("description", F.coalesce("description", F.lit(default_text)))
        .orderBy("user_id", F.desc("unlocked"), "code")
    )


def achievement_summary(achievements: DataFrame) -> DataFrame:
    return achievements.groupBy("user_id").agg(
        F.count_if("unlocked").alias("unlocked"), F.count(F.lit(1)).alias("total")
    )


def matching_events(events: DataFrame, types: list[str], from_at=None, to_at=None) -> DataFrame:
    """Events of the given types (none means all) between two inclusive instants (NULL is open)."""
    if types:
        events = events.filter(F.col("type").isin(types))
    if from_at is not None:
        events = events.filter(F.col("occurred_at") >= F.lit(from_at).cast("timestamp"))
    if to_at is not None:
        events = events.filter(F.col("occurred_at") <= F.lit(to_at).cast("timestamp"))
    return events


def event_log(events: DataFrame, limit: int, types: list[str] = (), from_at=None, to_at=None, source: str = "") -> DataFrame:
    """Newest `limit` events of each user with their source.

    The source filter comes after the limit, so fewer than `limit` rows may remain.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("occurred_at"), "event_id")
    chosen = (
        matching_events(events, list(types), from_at, to_at)
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= limit)
    )
    rows = chosen.select(
        "user_id",
        "position",
        "event_id",
        "type",
        "occurred_at",
        "payload_json",
        F.coalesce(S.scan_string_field(F.col("payload_json"), "source"), F.lit("")).alias("source"),
    )
    return rows.filter(F.lower("source") == source.lower()) if source else rows


def latest_events(events: DataFrame, keep: int, prefix: str) -> DataFrame:
    """The last few events of each user, newest first, with clock time and label."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("occurred_at"), F.desc("seq"))
    return (
        events.withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= keep)
        .select(
            "user_id",
            "position",
            "event_id",
            S.clock_label(F.col("occurred_at")).alias("clock"),
            S.ticker_label(F.col("type"), prefix).alias("label"),
        )
    )


def events_after(events: DataFrame, since: int | None, limit: int) -> DataFrame:
    """One page of each user's events after a cursor, in arrival order.

    `next_cursor` is the last key of the page when the page is full and NULL otherwise.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    arrival = Window.partitionBy("user_id").orderBy("seq")
    page = (
        events.filter(F.col("seq") > (since or 0))
        .withColumn("position", F.row_number().over(arrival))
        .filter(F.col("position") <= limit)
    )
    last = page.filter(F.col("position") == limit).select("user_id", F.col("seq").alias("next_cursor"))
    return page.join(last, "user_id", "left")


def payload_views(events: DataFrame, type_name: str, payload_schema: str) -> DataFrame:
    """Typed columns of one event type's payloads."""
    parsed = F.from_json("payload_json", payload_schema).alias("payload")
    return events.filter(F.col("type") == type_name).select("user_id", "event_id", "occurred_at", parsed).select(
        "user_id", "event_id", "occurred_at", "payload.*"
    )


def with_category(events: DataFrame, categories: DataFrame) -> DataFrame:
    """Events with the category of their type; unknown types keep NULL."""
    return events.join(categories, "type", "left")
