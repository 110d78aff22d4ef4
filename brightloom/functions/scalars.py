"""Scalar functions on events, labels, scores and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TIER_BOOST = 0.05
FRESHNESS_HALF_LIFE_DAYS = 90
SNIPPET_CHARS = 300
RETRY_CAP_SECONDS = 30.0
MAX_ATTEMPTS = 10
IDEMPOTENCY_KEY_PATTERN = r"^[A-Za-z0-9._:\-]+$"
IDEMPOTENCY_KEY_MAX_CHARS = 128


def utc_day(instant: Column) -> Column:
    """Calendar day of an instant; days are UTC days under the package's session settings."""
    return F.to_date(instant)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(6e7)


def scan_string_field(payload: Column, field: str) -> Column:
    """Text of the first quoted run after `"field":`, by text scan; NULL if there is none.

    A scan, not a parse: a numeric member yields the next string further on.
    """
    pattern = f'"{re.escape(field)}"[^:]*:[^"]*"([^"]*)"'
    return F.when(payload.rlike(pattern), F.regexp_extract(payload, pattern, 1))


def scan_int_field(payload: Column, field: str) -> Column:
    """Leading integer after `"field":`, by text scan; quoted numbers give NULL, 3.7 gives 3."""
    pattern = f'"{re.escape(field)}"[^:]*:\\s*([0-9-]*)'
    return F.regexp_extract(payload, pattern, 1).try_cast("int")


def server_content_hash(user_id: Column, event_type: Column, occurred_at: Column, payload: Column) -> Column:
    """Hash that identifies an event's content for its user: user, type, epoch ms, payload."""
    parts = [user_id.cast("string"), event_type, F.unix_millis(occurred_at).cast("string"), payload]
    return F.sha2(_joined_by_newline(parts), 256)


def client_content_hash(user_id: Column, event_type: Column, occurred_at: Column, payload: Column) -> Column:
    """The sender's form of the hash: the instant is ISO text with seven fraction digits.

    Spark keeps six; the seventh is always zero for instants it has stored.
    """
    iso = F.concat(F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    return F.sha2(_joined_by_newline([user_id.cast("string"), event_type, iso, payload]), 256)


def _joined_by_newline(parts: list[Column]) -> Column:
    # concat, not concat_ws: a missing part must give NULL, not a shorter text.
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit("\n"), part]
    return F.concat(*pieces[1:])


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def decode_base64(data: Column) -> Column:
    """Bytes of a base64 text, NULL when it is not base64."""
    return F.try_to_binary(data, F.lit("base64"))


def bytes_hash(data_base64: Column) -> Column:
    return F.sha2(decode_base64(data_base64), 256)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4)).cast("int")


def tier_boost(tier: Column) -> Column:
    return F.when(tier >= 1, F.lit(TIER_BOOST) / tier).otherwise(F.lit(0.0))


def freshness(crawled_at: Column, as_of: Column, half_life_days: float = FRESHNESS_HALF_LIFE_DAYS) -> Column:
    age_days = (F.unix_micros(as_of) - F.unix_micros(crawled_at)) / F.lit(86_400_000_000.0)
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / F.lit(float(half_life_days)))


def ticker_label(event_type: Column, prefix: str) -> Column:
    """Last dotted segment with underscores as spaces; a type without a dot stays as it is."""
    bare = _without_prefix(event_type, prefix)
    return F.when(F.instr(bare, ".") > 0, F.replace(F.substring_index(bare, ".", -1), F.lit("_"), F.lit(" "))).otherwise(bare)


def chip_label(event_type: Column, prefix: str) -> Column:
    """Dots as spaces for types under the prefix; others stay as they are."""
    bare = _without_prefix(event_type, prefix)
    return F.when(F.startswith(event_type, F.lit(prefix)), F.replace(bare, F.lit("."), F.lit(" "))).otherwise(event_type)


def _without_prefix(event_type: Column, prefix: str) -> Column:
    return F.when(
        F.startswith(event_type, F.lit(prefix)), F.substring(event_type, F.lit(len(prefix) + 1), F.length(event_type))
    ).otherwise(event_type)


def elapsed_label(start: Column, now: Column) -> Column:
    """Minutes and seconds since `start`, never negative; dashes when nothing has started."""
    seconds = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(start)) / F.lit(1_000_000)))
    label = F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)
    return F.when(start.isNull(), F.lit("--:--")).otherwise(label)


def clock_label(instant: Column) -> Column:
    return F.date_format(instant, "HH:mm:ss")


def fraction(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.try_divide(part.cast("double"), whole.cast("double")))


def snippet(text: Column, max_chars: int = SNIPPET_CHARS) -> Column:
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("…"))).otherwise(text)


def retry_delay_seconds(attempt: Column, jitter: Column) -> Column:
    """Delay after the `attempt`-th failure: `jitter` in [0, 1) times a doubling, capped bound."""
    return jitter * F.least(F.lit(RETRY_CAP_SECONDS), F.pow(F.lit(2.0), attempt - 1))


def delivery_outcome(status: Column) -> Column:
    """Class of a delivery by its response status."""
    return (
        F.when(status.between(200, 299), "success")
        .when(status.isin(401, 403), "auth")
        .when(status >= 500, "transient")
        .otherwise("permanent")
    )


def is_idempotency_key(key: Column) -> Column:
    return key.isNotNull() & (F.length(key) <= IDEMPOTENCY_KEY_MAX_CHARS) & key.rlike(IDEMPOTENCY_KEY_PATTERN)


def outbox_batch_key(first_id: Column, size: Column) -> Column:
    """Key of a delivery batch; ids are written without their hyphens."""
    return F.concat(F.lit("outbox-"), F.replace(first_id, F.lit("-"), F.lit("")), F.lit("-"), size.cast("string"))


def parse_tags(tags_json: Column) -> Column:
    return F.coalesce(F.from_json(tags_json, "array<string>"), F.array().cast("array<string>"))


def canonical_json(text: Column) -> Column:
    """The same JSON value with object keys in alphabetical order, NULL for malformed text."""
    return F.to_json(F.try_parse_json(text))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length of the two, 0 when either norm is 0."""
    size = F.least(F.size(a), F.size(b))
    left, right = F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size)

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)

    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(left, right) / norm)
