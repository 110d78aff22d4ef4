"""Queries over the event tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from brightloom.functions import scalars as S
from brightloom.operators import ledger, outbox
from brightloom.operators import projections as P
from brightloom.plans.registry import query
from brightloom.sources import events as E

AS_OF_DAY = date(2024, 1, 30)
AS_OF = datetime(2024, 1, 31)
DAYS = 14
GAP_SECONDS = 12 * 3600
LEVEL_TYPE = "app.signup"
PREFIX = "app."

TITLES = [("app.click", "Clicker", "Fifteen clicks."), ("app.purchase", "Shopper", "Fifteen purchases.")]
CATEGORIES = [("app.click", "activity"), ("app.view", "activity"), ("app.purchase", "commerce"), ("app.signup", "account")]


@query(
    """SELECT user_id, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, count(*) AS events FROM typed_events
       WHERE occurred_at >= TIMESTAMP '2024-01-17' GROUP BY ALL""",
    ("typed_events",),
)
def events_per_day(t):
    return P.events_per_day(t("typed_events"), AS_OF_DAY, DAYS)


@query(
    """SELECT user_id, CAST(CAST(started_at AS DATE) AS VARCHAR) AS day,
         round(sum((epoch_us(ended_at) - epoch_us(started_at)) / 6e7), 6) AS minutes
       FROM play_sessions WHERE started_at >= TIMESTAMP '2024-01-17' AND ended_at IS NOT NULL GROUP BY ALL""",
    ("play_sessions",),
)
def playtime_per_day(t):
    return P.playtime_per_day(t("play_sessions"), AS_OF_DAY, DAYS)


@query(
    """WITH e AS (SELECT user_id, count(*) FILTER (occurred_at >= TIMESTAMP '2024-01-01') AS total_events,
                    coalesce(max(CASE WHEN type = 'app.signup' THEN CAST(regexp_extract(payload_json, '"level":([0-9]+)', 1) AS INT) END), 0) AS max_level
                  FROM typed_events GROUP BY user_id),
            s AS (SELECT user_id, sum((epoch_us(ended_at) - epoch_us(started_at)) / 6e7) AS m FROM play_sessions
                  WHERE started_at >= TIMESTAMP '2024-01-01' AND ended_at IS NOT NULL GROUP BY user_id)
       SELECT e.user_id, total_events, round(coalesce(m, 0.0), 6) AS total_minutes, max_level FROM e LEFT JOIN s USING (user_id)""",
    ("play_sessions",),
)
def dashboard_totals(t):
    return P.dashboard_totals(t("typed_events"), t("play_sessions"), AS_OF_DAY, 30, LEVEL_TYPE)


@query(
    """SELECT user_id, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, type, count(*) AS events
       FROM typed_events GROUP BY ALL""",
    ("typed_events",),
)
def daily_rollup(t):
    return P.daily_rollup(t("typed_events"))


@query("SELECT DISTINCT user_id, type FROM typed_events", ("typed_events",))
def distinct_types(t):
    return P.distinct_types(t("typed_events"))


@query(
    """SELECT user_id, arg_min(s, seq) AS source
       FROM (SELECT user_id, seq, regexp_extract(payload_json, '"source":"([^"]*)"', 1) AS s FROM typed_events)
       WHERE s <> '' GROUP BY user_id, lower(s)""",
    ("typed_events",),
)
def distinct_sources_ci(t):
    return P.distinct_sources(t("typed_events"))


@query(
    """SELECT user_id, event_id, epoch_us(occurred_at) AS occurred_at,
         CAST(regexp_extract(payload_json, '"level":([0-9]+)', 1) AS INT) AS level
       FROM typed_events WHERE type = 'app.signup'""",
    ("typed_events",),
)
def level_progression(t):
    return P.level_progression(t("typed_events"), LEVEL_TYPE)


@query(
    """WITH g AS (SELECT user_id, occurred_at, seq,
              CASE WHEN occurred_at <= lag(occurred_at) OVER w + INTERVAL '12' HOUR THEN 0 ELSE 1 END AS opens
            FROM typed_events WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, seq)),
          n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY occurred_at, seq ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
       SELECT user_id, CAST(session_no AS BIGINT) AS session_no, epoch_us(min(occurred_at)) AS started_at,
         epoch_us(max(occurred_at)) AS ended_at, count(*) AS event_count,
         concat(user_id, '-', CAST(session_no AS BIGINT)) AS session_id
       FROM n GROUP BY user_id, session_no""",
    ("typed_events",),
)
def play_sessions(t):
    return P.play_sessions(t("typed_events"), GAP_SECONDS)


@query(
    """WITH shown AS (SELECT * FROM play_sessions
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, session_id) <= 20),
          inside AS (SELECT s.session_id, e.event_id, e.type, e.occurred_at,
                row_number() OVER (PARTITION BY s.session_id ORDER BY e.occurred_at DESC, e.event_id) AS event_rank
              FROM shown s JOIN typed_events e ON e.user_id = s.user_id
                AND e.occurred_at BETWEEN s.started_at AND coalesce(s.ended_at, TIMESTAMP '2024-01-31'))
       SELECT s.user_id, s.session_id, epoch_us(s.started_at) AS started_at, s.event_count, i.event_rank, i.event_id, i.type,
         epoch_us(i.occurred_at) AS occurred_at
       FROM shown s LEFT JOIN inside i ON i.session_id = s.session_id AND i.event_rank <= 50""",
    ("play_sessions",),
)
def session_timeline(t):
    timeline = P.session_timeline(t("play_sessions"), t("typed_events"), AS_OF, 20, 50)
    return timeline.select("user_id", "session_id", "started_at", "event_count", "event_rank", "event_id", "type", "occurred_at")


@query(
    """WITH c(code, title, description) AS (VALUES ('app.click', 'Clicker', 'Fifteen clicks.'), ('app.purchase', 'Shopper', 'Fifteen purchases.'))
       SELECT a.user_id, a.code, coalesce(c.title, a.code) AS title, coalesce(c.description, 'Custom achievement.') AS description,
         CAST(unlocked AS INT) AS unlocked, progress_numerator, progress_denominator, epoch_us(unlocked_at) AS unlocked_at
       FROM achievements a LEFT JOIN c USING (code)""",
    ("achievements",),
)
def achievement_list(t):
    return P.achievement_list(t("achievements"), t.rows(TITLES, "code string, title string, description string"))


@query(
    "SELECT user_id, count(*) FILTER (unlocked) AS unlocked, count(*) AS total FROM achievements GROUP BY user_id",
    ("achievements",),
)
def achievement_summary(t):
    return P.achievement_summary(t("achievements"))


@query(
    """SELECT * FROM (
         SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, event_id) AS position, event_id, type,
           epoch_us(occurred_at) AS occurred_at, payload_json, regexp_extract(payload_json, '"source":"([^"]*)"', 1) AS source
         FROM typed_events WHERE type IN ('app.click', 'app.purchase', 'app.view')
           AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at <= TIMESTAMP '2024-01-25')
       WHERE position <= 20 AND lower(source) = 'mobile'""",
    ("typed_events",),
)
def event_log(t):
    return P.event_log(
        t("typed_events"), 20, ["app.click", "app.purchase", "app.view"], datetime(2024, 1, 5), datetime(2024, 1, 25), "MOBILE"
    )


@query(
    """WITH p AS (SELECT user_id, seq, event_id, type, epoch_us(occurred_at) AS occurred_at,
              row_number() OVER (PARTITION BY user_id ORDER BY seq) AS position FROM typed_events WHERE seq > 2000)
       SELECT user_id, seq, event_id, type, occurred_at, position,
         max(CASE WHEN position = 25 THEN seq END) OVER (PARTITION BY user_id) AS next_cursor
       FROM p WHERE position <= 25""",
    ("typed_events",),
)
def event_page(t):
    page = P.events_after(t("typed_events"), 2000, 25)
    return page.select("user_id", "seq", "event_id", "type", "occurred_at", "position", "next_cursor")


@query(
    """SELECT event_id,
         sha256(concat(user_id, chr(10), type, chr(10), epoch_us(occurred_at) // 1000, chr(10), payload_json)) AS server_hash,
         sha256(concat(user_id, chr(10), type, chr(10), strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f'), '0Z', chr(10), payload_json)) AS client_hash
       FROM typed_events""",
    ("typed_events",),
)
def event_hash(t):
    parts = [F.col(c) for c in ("user_id", "type", "occurred_at", "payload_json")]
    return t("typed_events").select(
        "event_id", S.server_content_hash(*parts).alias("server_hash"), S.client_content_hash(*parts).alias("client_hash")
    )


_ACCEPTED = """SELECT *, seq = min(seq) OVER (PARTITION BY event_id)
    AND seq = min(seq) OVER (PARTITION BY user_id, type, epoch_us(occurred_at) // 1000, payload_json) AS accepted FROM incoming_events"""


@query(f"SELECT seq, event_id, user_id, CAST(accepted AS INT) AS accepted FROM ({_ACCEPTED})", ("incoming_events",))
def ledger_accept(t):
    return ledger.accept_events(t("incoming_events")).select("seq", "event_id", "user_id", "accepted")


@query(
    f"""SELECT user_id, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS duplicates
        FROM ({_ACCEPTED}) GROUP BY user_id""",
    ("incoming_events",),
)
def ledger_counts(t):
    return ledger.batch_counts(ledger.accept_events(t("incoming_events")))


@query(
    """SELECT seq, event_id, CAST(seq >= 100000000000 AND type <> 'app.purchase' AND type <> 'app.error' AS INT) AS accepted
       FROM incoming_events""",
    ("incoming_events",),
)
def ledger_accept_stored(t):
    """A batch against a ledger that already holds every event."""
    stored = ledger.with_content_hash(t("typed_events"))
    return ledger.accept_events(t("incoming_events"), stored).select("seq", "event_id", "accepted")


@query(
    """WITH r AS (SELECT seq, user_id, concat('k', regexp_extract(payload_json, '"level":([0-9]+)', 1)) AS k, event_id FROM typed_events)
       SELECT seq, user_id, k AS idempotency_key,
         CASE WHEN k = 'k1' THEN 'stored' ELSE first_value(event_id) OVER (PARTITION BY user_id, k ORDER BY seq) END AS response_json,
         CAST(k = 'k1' OR seq <> min(seq) OVER (PARTITION BY user_id, k) AS INT) AS replayed
       FROM r""",
    ("typed_events",),
)
def idempotent_answers(t):
    key = F.concat(F.lit("k"), S.scan_int_field(F.col("payload_json"), "level").cast("string"))
    requests = t("typed_events").select("user_id", key.alias("idempotency_key"), "seq", F.col("event_id").alias("response_json"))
    answered = t("typed_events").select("user_id").distinct().select(
        "user_id", F.lit("k1").alias("idempotency_key"), F.lit("stored").alias("response_json")
    )
    return ledger.answer_requests(requests, answered)


FIELDS = [
    ("app.click", "source", "enum", True, None, None, ["web", "mobile"]),
    ("app.click", "level", "int", True, 1, 15, None),
    ("app.purchase", "level", "int", True, 1, 20, None),
    ("app.purchase", "source", "string", True, 1, 3, None),
    ("app.view", "level", "int", True, 5, None, None),
    ("app.error", "code", "string", True, 1, 8, None),
    ("app.error", "source", "bool", False, None, None, None),
]


@query(
    """WITH x AS (SELECT event_id, type, json_extract_string(payload_json, '$.source') AS s, CAST(json_extract(payload_json, '$.level') AS INT) AS l
                  FROM typed_events)
       SELECT event_id, array_to_string(list_filter(CASE type
           WHEN 'app.click' THEN [CASE WHEN l NOT BETWEEN 1 AND 15 THEN 'level' END, CASE WHEN s NOT IN ('web', 'mobile') THEN 'source' END]
           WHEN 'app.purchase' THEN [CASE WHEN l NOT BETWEEN 1 AND 20 THEN 'level' END, CASE WHEN length(s) > 3 THEN 'source' END]
           WHEN 'app.view' THEN [CASE WHEN l < 5 THEN 'level' END]
           WHEN 'app.error' THEN ['code', 'source']
           ELSE ['type'] END, lambda v: v IS NOT NULL), '|') AS violations
       FROM x""",
    ("typed_events",),
)
def payload_violations(t):
    catalogue = t.rows(FIELDS, "type string, field string, kind string, required boolean, low int, high int, options array<string>")
    return E.payload_violations(t("typed_events"), catalogue).select("event_id", "violations")


@query(
    """WITH c(type, category) AS (VALUES ('app.click', 'activity'), ('app.view', 'activity'), ('app.purchase', 'commerce'), ('app.signup', 'account'))
       SELECT coalesce(category, 'other') AS category, count(*) AS events FROM typed_events LEFT JOIN c USING (type) GROUP BY 1""",
    ("typed_events",),
)
def event_category_counts(t):
    tagged = P.with_category(t("typed_events"), t.rows(CATEGORIES, "type string, category string"))
    return tagged.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("events"))


_LINES = """SELECT seq, CASE type
    WHEN 'app.error' THEN concat('{"occurredAt":', CAST(seq * 1000 AS STRING), '}')
    WHEN 'app.view' THEN concat('{"type":"app.view", "occurredAt":"', CAST(occurred_at AS STRING), '","payload":', payload_json, '}')
    WHEN 'app.signup' THEN concat('{"occurredAt":', CAST(seq * 1000 AS STRING), ',"type":"app.signup"}')
    WHEN 'app.purchase' THEN concat('{"type":"app.purchase","payload":', payload_json)
    ELSE concat('{"type":"app.click","occurredAt":', CAST(seq * 1000 AS STRING), ',"payload":', payload_json, '}') END AS value"""

_PARSED_ORACLE = """SELECT seq, CAST(type IN ('app.view', 'app.signup', 'app.click') AS INT) AS accepted,
         CASE WHEN type IN ('app.view', 'app.signup', 'app.click') THEN type END AS type,
         CASE WHEN type = 'app.view' THEN epoch_us(occurred_at) WHEN type IN ('app.signup', 'app.click') THEN seq * 1000000 END AS occurred_at,
         CASE WHEN type IN ('app.view', 'app.click') THEN payload_json WHEN type = 'app.signup' THEN '{"source":"default"}' END AS payload_json
       FROM typed_events"""


def _parsed(t, verbatim: bool):
    events = t("typed_events")
    lines = t.spark.sql(_LINES.replace("{", "{{").replace("}", "}}") + " FROM {events}", events=events)
    parsed = E.parse_event_lines(lines, F.lit(AS_OF).cast("timestamp"), '{"source":"default"}', verbatim)
    return parsed.drop("value")


@query(_PARSED_ORACLE, ("typed_events",))
def event_line_parse(t):
    return _parsed(t, verbatim=False)


@query(_PARSED_ORACLE, ("typed_events",))
def event_line_parse_verbatim(t):
    return _parsed(t, verbatim=True)


@query(
    """SELECT concat('{"occurredAt":', epoch_us(occurred_at) // 1000, ',"payload":{"level":', event_id::BIGINT % 20 + 1,
         ',"source":"', regexp_extract(payload_json, '"source":"([^"]*)"', 1), '"},"type":"', type, '"}') AS value FROM typed_events""",
    ("typed_events",),
)
def event_lines(t):
    return E.event_lines(t("typed_events"))


@query(
    """SELECT seq, pos, CAST(type NOT IN ('app.error', 'app.click') AS INT) AS accepted,
         CASE type WHEN 'app.error' THEN 'eventId' WHEN 'app.click' THEN 'type' ELSE '' END AS violations,
         CASE WHEN pos = 1 AND type = 'app.click' THEN '' WHEN pos = 1 THEN 'app.beat' ELSE type END AS type,
         seq * 1000 * 1000 AS occurred_at
       FROM typed_events, (VALUES (0), (1)) AS p(pos)""",
    ("typed_events",),
)
def push_requests(t):
    """Delivered bodies of two events each; one faulty event refuses both."""
    digest = F.md5("event_id")
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    event_id = F.when(F.col("type") == "app.error", F.col("event_id")).otherwise(F.concat_ws("-", *parts))

    def event(type_name):
        return F.struct(
            event_id.alias("eventId"),
            type_name.alias("type"),
            (F.col("seq") * 1000).alias("occurredAt"),
            F.col("payload_json").alias("payloadJson"),
        )

    beat = F.when(F.col("type") == "app.click", "").otherwise("app.beat")
    body = F.to_json(F.struct(F.array(event(F.col("type")), event(beat)).alias("events")))
    requests = t("typed_events").select("seq", body.alias("body"))
    return E.read_push_requests(requests).select("seq", "pos", "accepted", "violations", "type", "occurred_at")


@query(
    """SELECT user_id, event_id, epoch_us(occurred_at) AS occurred_at, json_extract_string(payload_json, '$.source') AS source,
         CAST(json_extract(payload_json, '$.level') AS INT) AS level FROM typed_events WHERE type = 'app.purchase'""",
    ("typed_events",),
)
def payload_view(t):
    return P.payload_views(t("typed_events"), "app.purchase", "source string, level int")


@query(
    """SELECT event_id, attempts, epoch_us(created_at) AS created_at FROM outbox
       WHERE status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-20')""",
    ("outbox",),
)
def outbox_due(t):
    return outbox.due_rows(t("outbox"), datetime(2024, 1, 20)).select("event_id", "attempts", "created_at")


@query(
    """SELECT concat('outbox-', arg_min(event_id, (created_at, event_id)), '-', count(*)) AS batch_key, count(*) AS size
       FROM (SELECT * FROM outbox WHERE status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-20')
             ORDER BY created_at, event_id LIMIT 100)""",
    ("outbox",),
)
def outbox_batch_key(t):
    return outbox.batch_key(outbox.due_rows(t("outbox"), datetime(2024, 1, 20), 100))


@query(
    """SELECT e.event_id, e.type, epoch_us(e.occurred_at) AS occurred_at FROM typed_events e
       WHERE e.event_id IN (SELECT event_id FROM outbox WHERE status = 'pending'
                            AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-20'))""",
    ("outbox",),
)
def outbox_due_events(t):
    due = outbox.due_rows(t("outbox"), datetime(2024, 1, 20))
    return outbox.due_events(due, t("typed_events")).select("event_id", "type", "occurred_at")


@query(
    """SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'dead_lettered') AS dead_lettered,
         epoch_us(TIMESTAMP '2024-01-31') AS last_success_at, 'timeout' AS last_error FROM outbox""",
    ("outbox",),
)
def outbox_snapshot(t):
    return outbox.snapshot(t("outbox"), AS_OF, "timeout")


@query(
    """SELECT event_id, CASE WHEN type = 'app.click' THEN 'given' ELSE
           sha256(concat(user_id, chr(10), type, chr(10), strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f'), '0Z', chr(10), payload_json)) END AS payload_hash,
         0 AS attempts, 'pending' AS status, epoch_us(occurred_at) AS created_at
       FROM typed_events WHERE type <> 'app.view'""",
    ("typed_events",),
)
def outbox_enqueue(t):
    events = t("typed_events").withColumn("content_hash", F.when(F.col("type") == "app.click", "given").otherwise(" "))
    _, rows = outbox.enqueue(events, events.filter("type = 'app.view'").select("event_id"))
    return rows.select("event_id", "payload_hash", "attempts", "status", "created_at")


@query(
    """WITH j AS (SELECT o.*, CASE e.type WHEN 'app.click' THEN 'success' WHEN 'app.view' THEN 'auth'
                                          WHEN 'app.error' THEN 'transient' WHEN 'app.purchase' THEN 'permanent' END AS outcome
                  FROM outbox o JOIN typed_events e USING (event_id)),
            k AS (SELECT *, CASE WHEN outcome IN ('auth', 'transient') THEN attempts + 1 ELSE attempts END AS tries FROM j)
       SELECT event_id, tries AS attempts,
         CASE WHEN outcome IS NULL THEN status WHEN outcome = 'success' THEN 'synced'
              WHEN outcome = 'permanent' OR (outcome IN ('auth', 'transient') AND tries >= 10) THEN 'dead_lettered' ELSE status END AS status,
         CASE WHEN outcome IS NULL THEN epoch_us(next_attempt_at)
              WHEN outcome IN ('auth', 'transient') AND tries < 10
                THEN epoch_us(TIMESTAMP '2024-01-31') + CAST(500000 * least(30, power(2, tries - 1)) AS BIGINT) END AS next_attempt_at,
         CASE WHEN outcome IS NOT NULL AND outcome <> 'success' THEN 'refused' END AS last_error
       FROM k""",
    ("outbox",),
)
def outbox_transition(t):
    status = F.when(F.col("type") == "app.click", 204).when(F.col("type") == "app.view", 403)
    status = status.when(F.col("type") == "app.error", 503).when(F.col("type") == "app.purchase", 422)
    responses = t("typed_events").filter("type <> 'app.signup'").select("event_id", status.alias("http_status"), F.lit("refused").alias("error"))
    current = t("outbox").withColumn("last_error", F.lit(None).cast("string"))
    changed = outbox.apply_outcomes(current, responses, AS_OF, F.lit(0.5))
    return changed.select("event_id", "attempts", "status", "next_attempt_at", "last_error")


@query(
    """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, seq DESC) AS position, event_id,
         strftime(occurred_at, '%H:%M:%S') AS clock, substr(type, 5) AS label
       FROM typed_events QUALIFY position <= 3""",
    ("typed_events",),
)
def latest_events(t):
    return P.latest_events(t("typed_events"), 3, PREFIX)


@query(
    """WITH e AS (SELECT event_id, occurred_at, concat(type, '.step_one') AS type, event_id::BIGINT % 20 + 1 AS level, seq % 5 AS whole FROM typed_events),
            x AS (SELECT *, greatest(0, floor((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(occurred_at)) / 1000000))::BIGINT AS secs FROM e)
       SELECT event_id, 'step one' AS ticker, replace(substr(type, 5), '.', ' ') AS chip, strftime(occurred_at, '%H:%M:%S') AS clock,
         concat(CASE WHEN secs // 60 < 10 THEN '0' ELSE '' END, secs // 60, ':', lpad(CAST(secs % 60 AS VARCHAR), 2, '0')) AS elapsed,
         CASE WHEN whole = 0 THEN 0.0 ELSE round(level::DOUBLE / whole, 6) END AS share
       FROM x""",
    ("typed_events",),
)
def display_labels(t):
    typed = F.concat(F.col("type"), F.lit(".step_one"))
    level = S.scan_int_field(F.col("payload_json"), "level")
    return t("typed_events").select(
        "event_id",
        S.ticker_label(typed, PREFIX).alias("ticker"),
        S.chip_label(typed, PREFIX).alias("chip"),
        S.clock_label(F.col("occurred_at")).alias("clock"),
        S.elapsed_label(F.col("occurred_at"), F.lit(datetime(2024, 1, 20)).cast("timestamp")).alias("elapsed"),
        S.fraction(level, F.col("seq") % 5).alias("share"),
    )


@query(
    """SELECT user_id, type, arg_max(event_id, (occurred_at, event_id)) AS event_id, epoch_us(max(occurred_at)) AS occurred_at
       FROM typed_events GROUP BY user_id, type""",
    ("typed_events",),
)
def server_wins(t):
    states = t("typed_events").select("user_id", "type", "event_id", "occurred_at")
    return ledger.latest_by_server_clock(states, ["user_id", "type"], "occurred_at")


@query(
    """SELECT source_name, type, count(*) AS events FROM (
         SELECT 'files' AS source_name, type FROM typed_events UNION ALL SELECT 'socket', type FROM incoming_events) GROUP BY ALL""",
    ("incoming_events",),
)
def merged_sources(t):
    merged = E.merge_sources({"files": t("typed_events"), "socket": t("incoming_events")})
    return merged.groupBy("source_name", "type").agg(F.count(F.lit(1)).alias("events"))


@query(
    """SELECT event_id, CAST(length(k) BETWEEN 1 AND 128 AND regexp_full_match(k, '[A-Za-z0-9._:-]+') AS INT) AS valid
       FROM (SELECT event_id, CASE WHEN type = 'app.error' THEN concat('bad key ', event_id) WHEN type = 'app.view' THEN repeat('x', 129)
                              ELSE concat('outbox-', event_id, '-1') END AS k FROM typed_events)""",
    ("typed_events",),
)
def idempotency_keys(t):
    key = F.when(F.col("type") == "app.error", F.concat(F.lit("bad key "), "event_id"))
    key = key.when(F.col("type") == "app.view", F.repeat(F.lit("x"), F.lit(129)))
    key = key.otherwise(F.concat(F.lit("outbox-"), "event_id", F.lit("-1")))
    return t("typed_events").select("event_id", S.is_idempotency_key(key).alias("valid"))
