import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brightloom.operators import ledger, outbox
from brightloom.operators import projections as P
from brightloom.sources import events as E

EVENTS = "event_id string, user_id long, type string, occurred_at timestamp, payload_json string, seq long"
SESSIONS = "session_id string, user_id long, started_at timestamp, ended_at timestamp, event_count long"
D = datetime(2024, 1, 10)


def event(spark, rows):
    return spark.createDataFrame([(f"e{i}", *row, i) for i, row in enumerate(rows)], EVENTS)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_events_per_day_counts_inside_the_window(spark):
    events = event(spark, [(1, "t", D, "{}"), (1, "t", D + timedelta(hours=5), "{}"), (1, "t", D - timedelta(days=3), "{}"), (2, "t", D, "{}")])
    got = rows_of(P.for_user(P.events_per_day(events, date(2024, 1, 10), 3), 1), "day", "events")
    assert got == [(D.date(), 2)]


def test_playtime_credits_the_start_day_and_skips_open_sessions(spark):
    rows = [
        ("a", 1, D, D + timedelta(minutes=60), 0),
        ("b", 1, D + timedelta(hours=23, minutes=30), D + timedelta(days=1, minutes=15), 0),
        ("c", 1, D, None, 0),
    ]
    got = rows_of(P.playtime_per_day(spark.createDataFrame(rows, SESSIONS), date(2024, 1, 10), 7), "day", "minutes")
    assert got == [(D.date(), 105.0)]


def test_sessions_split_after_more_than_the_gap(spark):
    gap = 3600
    offsets = [0, 10, 3610, 3610 + 3600, 3610 + 3600 + 3601]
    events = event(spark, [(1, "t", D + timedelta(seconds=s), "{}") for s in offsets] + [(2, "t", D, "{}")])
    got = sorted(rows_of(P.play_sessions(events, gap), "user_id", "session_no", "event_count"))
    assert got == [(1, 1, 4), (1, 2, 1), (2, 1, 1)]


def test_sessions_equal_a_walk_over_sorted_times(spark):
    chance = random.Random(3)
    times = sorted(chance.sample(range(200_000), 300))
    events = event(spark, [(chance.randint(1, 3), "t", D + timedelta(seconds=s), "{}") for s in times])
    expected = {}
    for user in (1, 2, 3):
        last = None
        for row in sorted(events.filter(F.col("user_id") == user).collect(), key=lambda r: r["occurred_at"]):
            if last is None or row["occurred_at"] - last > timedelta(seconds=900):
                expected.setdefault(user, []).append(0)
            expected[user][-1] += 1
            last = row["occurred_at"]
    got = {}
    for user, _, count in sorted(rows_of(P.play_sessions(events, 900), "user_id", "session_no", "event_count")):
        got.setdefault(user, []).append(count)
    assert got == expected


def test_timeline_is_inclusive_keeps_empty_sessions_and_overlaps(spark):
    sessions = spark.createDataFrame(
        [("a", 1, D, D + timedelta(hours=1), 0), ("open", 1, D + timedelta(minutes=30), None, 0), ("empty", 1, D - timedelta(days=9), D - timedelta(days=8), 0)],
        SESSIONS,
    )
    events = event(spark, [(1, "t", D + timedelta(hours=1), "{}"), (1, "t", D, "{}"), (1, "t", D + timedelta(days=2), "{}"), (2, "t", D, "{}")])
    got = sorted(rows_of(P.session_timeline(sessions, events, D + timedelta(days=3)), "session_id", "event_rank", "event_id"), key=str)
    assert got == [("a", 1, "e0"), ("a", 2, "e1"), ("empty", None, None), ("open", 1, "e2"), ("open", 2, "e0")]
    capped = P.session_timeline(sessions, events, D + timedelta(days=3), session_limit=1, events_per_session=1)
    assert rows_of(capped, "session_id", "event_id") == [("open", "e2")]


def test_event_log_limits_before_it_filters_by_source(spark):
    payloads = ['{"source":"web"}', '{"source":"Mobile"}', '{"source":"web"}', "{}"]
    events = event(spark, [(1, "t", D + timedelta(minutes=i), p) for i, p in enumerate(payloads)])
    got = rows_of(P.event_log(events, 3, source="MOBILE"), "event_id", "source")
    assert got == [("e1", "Mobile")]
    assert rows_of(P.event_log(events, 2, source="mobile"), "event_id") == []
    assert len(rows_of(P.event_log(events, 10, ["t"], D + timedelta(minutes=1), D + timedelta(minutes=2)), "event_id")) == 2


def test_sources_ignore_case_and_keep_the_first_spelling(spark):
    events = event(spark, [(1, "t", D, '{"source":"Web"}'), (1, "t", D, '{"source":"web"}'), (1, "t", D, "{}"), (1, "t", D, '{"source":"App"}')])
    assert rows_of(P.distinct_sources(events), "source") == [("App",), ("Web",)]


def test_event_page_cursor_only_when_full(spark):
    events = event(spark, [(1, "t", D, "{}")] * 3)
    first = sorted(rows_of(P.events_after(events, -1, 2), "seq", "next_cursor"))
    assert first == [(0, 1), (1, 1)]
    assert rows_of(P.events_after(events, 1, 2), "seq", "next_cursor") == [(2, None)]
    with pytest.raises(ValueError):
        P.events_after(events, 0, 501)


def test_level_progression_skips_unreadable(spark):
    events = event(spark, [(1, "up", D + timedelta(minutes=2), '{"level":3}'), (1, "up", D, '{"level":2}'), (1, "up", D, "{}"), (1, "x", D, '{"level":9}')])
    assert [r[0] for r in rows_of(P.level_progression(events, "up"), "level")] == [2, 3]


# ---- the ledger ----


def replay(rows, stored=()):
    ids, contents, accepted = {s[0] for s in stored}, {s[1] for s in stored}, set()
    for seq, (event_id, content) in enumerate(rows):
        if event_id in ids or content in contents:
            continue
        ids.add(event_id)
        contents.add(content)
        accepted.add(seq)
    return accepted


def incoming(spark, rows):
    return spark.createDataFrame([(i, 1, "t", D, c, n) for n, (i, c) in enumerate(rows)], EVENTS)


def accepted_seqs(df):
    return {r["seq"] for r in df.filter("accepted").collect()}


def test_a_refused_row_blocks_nobody(spark):
    rows = [("id1", "h1"), ("id2", "h1"), ("id2", "h2"), ("id3", "h2"), ("id3", "h3")]
    assert accepted_seqs(ledger.accept_events(incoming(spark, rows))) == replay(rows) == {0, 2, 4}


@pytest.mark.parametrize("seed", range(4))
def test_ledger_equals_sequential_inserts(spark, seed):
    chance = random.Random(seed)
    rows = [(f"i{chance.randint(0, 12)}", f"h{chance.randint(0, 12)}") for _ in range(40)]
    assert accepted_seqs(ledger.accept_events(incoming(spark, rows))) == replay(rows)


def test_ledger_against_stored_rows(spark):
    stored = ledger.with_content_hash(incoming(spark, [("old", "h-old")]))
    rows = [("old", "h1"), ("n1", "h-old"), ("n1", "h1"), ("n2", "h1")]
    decided = ledger.accept_events(incoming(spark, rows), stored)
    assert accepted_seqs(decided) == {2}
    assert [tuple(r) for r in ledger.batch_counts(decided).collect()] == [(1, 1, 3)]
    assert ledger.next_ledger(stored, decided, D).count() == 2


def test_same_content_of_two_users_is_two_events(spark):
    rows = [("a", 1, "t", D, "{}", 0), ("b", 2, "t", D, "{}", 1)]
    assert accepted_seqs(ledger.accept_events(spark.createDataFrame(rows, EVENTS))) == {0, 1}


def test_first_answer_of_a_key_stays(spark):
    requests = spark.createDataFrame(
        [(1, "k", 0, "a"), (1, "k", 1, "b"), (1, "old", 2, "c"), (1, None, 3, "d"), (2, "k", 4, "e")],
        "user_id long, idempotency_key string, seq long, response_json string",
    )
    answered = spark.createDataFrame([(1, "old", "stored")], "user_id long, idempotency_key string, response_json string")
    got = {r["seq"]: (r["response_json"], r["replayed"]) for r in ledger.answer_requests(requests, answered).collect()}
    assert got == {0: ("a", False), 1: ("a", True), 2: ("stored", True), 3: ("d", False), 4: ("e", False)}
    after = ledger.next_answers(requests, answered, D)
    assert sorted(r["response_json"] for r in after.collect()) == ["a", "e", "stored"]


# ---- the outbox ----


def test_outbox_transitions(spark):
    box = spark.createDataFrame(
        [("ok", 0), ("auth", 0), ("last", 9), ("bad", 3), ("none", 2)], "event_id string, attempts int"
    ).select("*", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("next_attempt_at"), F.lit("old").alias("last_error"), F.lit(D).alias("created_at"))
    answers = spark.createDataFrame([("ok", 200, None), ("auth", 401, "no"), ("last", 503, "down"), ("bad", 404, "gone")], "event_id string, http_status int, error string")
    got = {r["event_id"]: (r["attempts"], r["status"], r["next_attempt_at"], r["last_error"]) for r in outbox.apply_outcomes(box, answers, D, F.lit(0.5)).collect()}
    assert got == {
        "ok": (0, "synced", None, None),
        "auth": (1, "pending", D + timedelta(seconds=0.5), "no"),
        "last": (10, "dead_lettered", None, "down"),
        "bad": (3, "dead_lettered", None, "gone"),
        "none": (2, "pending", None, "old"),
    }


# ---- input ----


def parsed(spark, line, verbatim=False):
    df = spark.createDataFrame([(line,)], "value string")
    return E.parse_event_lines(df, F.lit(D).cast("timestamp"), '{"source":"default"}', verbatim).collect()[0]


@pytest.mark.parametrize(
    "line, accepted, at, payload",
    [
        ('{"type":"a","occurredAt":1000,"payload":{"x":1}}', True, datetime(1970, 1, 1, 0, 0, 1), '{"x":1}'),
        ('{"type":"a","occurredAt":"2024-02-03T04:05:06Z"}', True, datetime(2024, 2, 3, 4, 5, 6), '{"source":"default"}'),
        ('{"type":"a","occurredAt":"nonsense"}', True, D, '{"source":"default"}'),
        ('{"type":"a","occurredAt":null}', True, D, '{"source":"default"}'),
        ('{"type":5}', False, None, None),
        ('{"occurredAt":1}', False, None, None),
        ("not json", False, None, None),
        ("", False, None, None),
    ],
)
def test_event_lines(spark, line, accepted, at, payload):
    row = parsed(spark, line)
    assert (row["accepted"], row["occurred_at"], row["payload_json"]) == (accepted, at, payload)


def test_verbatim_payload_keeps_spaces_and_digits(spark):
    line = '{"type":"a", "payload": {"x": 2.50, "s":"}{"} }'
    assert parsed(spark, line, verbatim=True)["payload_json"] == '{"x": 2.50, "s":"}{"}'
    assert parsed(spark, '{"type":"a","payload":null}', verbatim=True)["payload_json"] == "null"


def test_catalogue_checks_nested_fields(spark):
    fields = [
        ("p", "member", "object", True, None, None, None),
        ("p", "member.hp", "int", True, 0, None, None),
        ("p", "members", "array", True, 0, 2, None),
        ("p", "members[].name", "string", True, 1, 4, None),
        ("p", "won", "bool", True, None, None, None),
        ("p", "kind", "enum", False, None, None, ["x", "y"]),
    ]
    catalogue = spark.createDataFrame(fields, "type string, field string, kind string, required boolean, low int, high int, options array<string>")
    good = '{"member":{"hp":1},"members":[{"name":"abc"}],"won":true}'
    bad = '{"member":{"hp":-1},"members":[{"name":"abc"},{"name":""},{}],"won":"true","kind":"z"}'
    events = event(spark, [(1, "p", D, good), (1, "p", D, bad), (1, "q", D, "{}"), (1, "p", D, "nope")])
    got = [sorted(r["violations"]) for r in E.payload_violations(events, catalogue).orderBy("seq").collect()]
    assert got == [[], ["kind", "member.hp", "members", "members[].name", "won"], ["type"], ["payload"]]


def test_push_requests_accept_or_refuse_as_a_whole(spark):
    good = '{"eventId":"0188c8f2-0000-7000-8000-000000000001","type":"t","occurredAt":5,"payloadJson":"{}"}'
    bodies = [f'{{"events":[{good}]}}', f'{{"events":[{good},{{"eventId":"x","type":"","occurredAt":-1,"payloadJson":"{{"}}]}}', '{"events":[]}', "junk", "{}"]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = {}
    for r in E.read_push_requests(df).collect():
        got.setdefault(r["n"], (r["accepted"], sorted(r["violations"])))
    assert got == {
        0: (True, []),
        1: (False, ["eventId", "occurredAt", "payloadJson", "type"]),
        2: (False, ["events"]),
        3: (False, ["events"]),
        4: (False, ["events"]),
    }
