"""Event input: JSON lines, request envelopes, payload catalogues; and the line writer."""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of one delivered batch.
MAX_BATCH_EVENTS = 500
MAX_TYPE_CHARS = 128
MAX_PAYLOAD_CHARS = 65_536
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def read_event_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder)


@F.pandas_udf(T.StringType())
def raw_payload(lines: pd.Series) -> pd.Series:
    """The `payload` member of each JSON line exactly as it was written."""
    decoder = json.JSONDecoder()

    def slice_of(line: str | None) -> str | None:
        found, at = None, (line or "").find("{") + 1
        while at:
            while at < len(line) and line[at] in " \t\r\n,":
                at += 1
            if at >= len(line) or line[at] == "}":
                break
            name, at = decoder.raw_decode(line, at)
            at = line.index(":", at) + 1
            while line[at] in " \t\r\n":
                at += 1
            start = at
            _, at = decoder.raw_decode(line, at)
            if name == "payload":
                found = line[start:at]
        return found

    def safe(line: str | None) -> str | None:
        try:
            return slice_of(line)
        except (ValueError, IndexError):
            return None

    return pd.Series([safe(line) for line in lines], dtype=object)


def parse_event_lines(
    lines: DataFrame, as_of: Column, default_payload: str, verbatim_payload: bool = False
) -> DataFrame:
    """Parse a `value` column of JSON lines into `type, occurred_at, payload_json, accepted`.

    A line without a textual type or with malformed JSON is not accepted and keeps its text
    for a quarantine table. A numeric time is epoch milliseconds, a textual one is parsed,
    anything else means `as_of`. Payload text is the re-serialised member; with
    `verbatim_payload` it is cut from the line as written, at the price of a Python stage.
    """
    parsed = lines.withColumn("_json", F.try_parse_json("value"))
    for member in ("type", "occurredAt", "payload"):
        parsed = parsed.withColumn(f"_{member}", F.try_variant_get("_json", f"$.{member}", "variant"))
    kind = F.schema_of_variant("_occurredAt")
    is_number = kind == "BIGINT"
    occurred_at = (
        F.when(is_number, F.timestamp_millis(F.try_variant_get("_json", "$.occurredAt", "bigint")))
        .when(kind == "STRING", F.try_to_timestamp(F.try_variant_get("_json", "$.occurredAt", "string")))
    )
    accepted = F.coalesce(
        (F.schema_of_variant("_type") == "STRING") & ~F.coalesce(kind.rlike("^(DECIMAL|DOUBLE)"), F.lit(False)), F.lit(False)
    )
    text = raw_payload("value") if verbatim_payload else F.get_json_object("value", "$.payload")
    payload = F.when(F.col("_payload").isNull(), F.lit(default_payload)).otherwise(F.coalesce(text, F.lit("null")))
    kept = [c for c in lines.columns]
    return parsed.select(
        *kept,
        accepted.alias("accepted"),
        F.when(accepted, F.try_variant_get("_json", "$.type", "string")).alias("type"),
        F.when(accepted, F.coalesce(occurred_at, as_of)).alias("occurred_at"),
        F.when(accepted, payload).alias("payload_json"),
    )


def read_push_requests(requests: DataFrame) -> DataFrame:
    """Explode request bodies `{"events": [...]}` into events, with every reason to refuse.

    One faulty event refuses its whole request, as does an empty or oversized list; such a
    request without events keeps one row with NULL event columns.
    """
    parsed = requests.withColumn(
        "_events", F.try_variant_get(F.try_parse_json("body"), "$.events", "array<variant>")
    )

    def text_faults(event: Column, name: str, low: int, high: int) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(event, f"$.{name}", "variant"))
        value = F.try_variant_get(event, f"$.{name}", "string")
        ok = (kind == "STRING") & F.length(value).between(low, high)
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    def faults(event: Column) -> Column:
        id_text = F.try_variant_get(event, "$.eventId", "string")
        id_ok = (F.schema_of_variant(F.try_variant_get(event, "$.eventId", "variant")) == "STRING") & id_text.rlike(UUID_PATTERN)
        time_kind = F.schema_of_variant(F.try_variant_get(event, "$.occurredAt", "variant"))
        time_ok = (time_kind == "BIGINT") & (F.try_variant_get(event, "$.occurredAt", "bigint") >= 0)
        return F.array_compact(
            F.array(
                F.when(~F.coalesce(id_ok, F.lit(False)), F.lit("eventId")),
                text_faults(event, "type", 1, MAX_TYPE_CHARS),
                F.when(~F.coalesce(time_ok, F.lit(False)), F.lit("occurredAt")),
                text_faults(event, "payloadJson", 2, MAX_PAYLOAD_CHARS),
            )
        )

    size_ok = F.coalesce(F.size("_events").between(1, MAX_BATCH_EVENTS), F.lit(False)) & F.col("_events").isNotNull()
    per_request = parsed.withColumn(
        "violations",
        F.when(size_ok, F.array_distinct(F.flatten(F.transform("_events", faults)))).otherwise(F.array(F.lit("events"))),
    ).withColumn("accepted", F.size("violations") == 0)
    rows = per_request.select(*requests.columns, "violations", "accepted", F.posexplode_outer("_events").alias("pos", "_event"))
    return rows.drop("body").select(
        "*",
        F.try_variant_get("_event", "$.eventId", "string").alias("event_id"),
        F.try_variant_get("_event", "$.type", "string").alias("type"),
        F.timestamp_millis(F.try_variant_get("_event", "$.occurredAt", "bigint")).alias("occurred_at"),
        F.try_variant_get("_event", "$.payloadJson", "string").alias("payload_json"),
    ).drop("_event")


def payload_violations(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add `violations` to events checked against a catalogue of payload fields.

    Catalogue rows are `(type, field, kind, required, low, high, options)`. Kinds: `string`
    (length bounds), `int` (value bounds), `bool`, `enum` (options), `object`, `array` (size
    bounds). A field is a dotted path; `items[].name` is checked in every element. The
    catalogue is configuration: it is read once and compiled into one expression.
    """
    rows = catalogue.orderBy("type", "field").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a payload catalogue holds at most 10,000 fields")
    by_type: dict[str, list] = {}
    for row in rows:
        by_type.setdefault(row["type"], []).append(row)
    payload = F.col("_payload")
    branches = None
    for name, fields in sorted(by_type.items()):
        found = F.array_compact(F.array(*[_field_fault(payload, row) for row in fields]))
        branches = F.when(F.col("type") == name, found) if branches is None else branches.when(F.col("type") == name, found)
    unknown = F.array(F.lit("type"))
    verdict = unknown if branches is None else branches.otherwise(unknown)
    return (
        events.withColumn("_payload", F.try_parse_json("payload_json"))
        .withColumn("violations", F.when(F.col("_payload").isNull(), F.array(F.lit("payload"))).otherwise(verdict))
        .drop("_payload")
    )


def _field_fault(payload: Column, row) -> Column:
    if "[]" in row["field"]:
        head, _, tail = row["field"].partition("[]")
        inner = "$" + tail
        items = F.try_variant_get(payload, f"$.{head}", "array<variant>")
        bad = F.exists(items, lambda item: ~_field_ok(item, inner, row))
    else:
        bad = ~_field_ok(payload, f"$.{row['field']}", row)
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(row["field"]))


def _field_ok(value: Column, path: str, row) -> Column:
    member = F.try_variant_get(value, path, "variant")
    shape = F.schema_of_variant(member)
    low, high = row["low"], row["high"]

    def within(measure: Column) -> Column:
        checks = F.lit(True)
        if low is not None:
            checks = checks & (measure >= low)
        if high is not None:
            checks = checks & (measure <= high)
        return checks

    if row["kind"] == "string":
        ok = (shape == "STRING") & within(F.length(F.try_variant_get(value, path, "string")))
    elif row["kind"] == "int":
        number = F.try_variant_get(value, path, "double")
        ok = shape.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (number == F.floor(number)) & within(number)
    elif row["kind"] == "bool":
        ok = shape == "BOOLEAN"
    elif row["kind"] == "enum":
        ok = (shape == "STRING") & F.try_variant_get(value, path, "string").isin(list(row["options"]))
    elif row["kind"] == "object":
        ok = F.startswith(shape, F.lit("OBJECT"))
    elif row["kind"] == "array":
        ok = F.startswith(shape, F.lit("ARRAY")) & within(F.size(F.try_variant_get(value, path, "array<variant>")))
    else:
        raise ValueError(f"unknown field kind: {row['kind']}")
    missing_ok = F.lit(not row["required"])
    return F.when(member.isNull(), missing_ok).otherwise(F.coalesce(ok, F.lit(False)))


def event_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines with their keys in alphabetical order."""
    return events.select(
        F.to_json(
            F.struct(
                F.unix_millis("occurred_at").alias("occurredAt"),
                F.try_parse_json("payload_json").alias("payload"),
                F.col("type"),
            )
        ).alias("value")
    )


def write_event_lines(events: DataFrame, folder: str) -> None:
    event_lines(events).write.mode("append").text(folder)


def merge_sources(named: dict[str, DataFrame]) -> DataFrame:
    """One DataFrame of several event sources, batch or streaming, with the source's name."""
    merged = None
    for name, df in named.items():
        tagged = df.withColumn("source_name", F.lit(name))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no event source given")
    return merged
