from datetime import datetime, timedelta

import pytest

from brightloom.operators import projections as P
from brightloom.sources.events import merge_sources, write_event_lines
from brightloom.streaming import jobs
from brightloom.streaming import sources as S

EVENTS = "event_id string, user_id long, type string, occurred_at timestamp, payload_json string, seq long"
D = datetime(2024, 1, 10)


def table(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def feed(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_ledger_stream_survives_restarts_and_late_rows(spark, tmp_path):
    landing, ledger, checkpoint = (str(tmp_path / n) for n in ("landing", "ledger", "checkpoint"))
    rounds = [
        [("a", 1, "t", D, "{}", 1), ("b", 1, "t", D, "{}", 2), ("c", 1, "u", D, "{}", 3)],
        [("a", 1, "t", D, '{"x":1}', 4), ("d", 1, "u", D, "{}", 5), ("late", 1, "t", D - timedelta(days=900), "{}", 6)],
    ]
    for rows in rounds:
        feed(table(spark, rows), landing)
        stream = S.growing_table(spark, landing, table(spark, []).schema)
        jobs.run_available(jobs.start(stream, jobs.ledger_writer(ledger), checkpoint))
    assert sorted(r["event_id"] for r in spark.read.parquet(ledger).collect()) == ["a", "c", "late"]


def test_a_repeated_batch_writes_the_same_rows(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    write = jobs.ledger_writer(ledger)
    first, second = table(spark, [("a", 1, "t", D, "{}", 1)]), table(spark, [("b", 1, "u", D, "{}", 2), ("a", 1, "v", D, "{}", 3)])
    write(first, 0)
    for _ in range(2):
        write(second, 1)
        assert sorted(r["event_id"] for r in spark.read.parquet(ledger).collect()) == ["a", "b"]


def test_ticker_keeps_the_last_three_per_user(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "ticker", "checkpoint"))
    rows = [(f"e{n}", n % 2, "app.x", D + timedelta(minutes=n), "{}", n) for n in range(12)]
    for part in (rows[:7], rows[7:]):
        feed(table(spark, part), landing)
        jobs.run_available(jobs.start(S.growing_table(spark, landing, table(spark, []).schema), jobs.ticker_writer(out), checkpoint))
    expected = sorted((r["user_id"], r["event_id"]) for r in P.latest_events(table(spark, rows), 3, "app.").collect())
    assert sorted((r["user_id"], r["event_id"]) for r in jobs.current_ticker(spark, out).collect()) == expected


def test_counters_follow_the_stream(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "daily", "checkpoint"))
    keys = ["user_id", "day", "type"]
    rows = [(f"e{n}", n % 2, "t", D + timedelta(hours=9 * n), "{}", n) for n in range(10)]
    for part in (rows[:6], rows[6:], rows[:1]):
        feed(table(spark, part), landing)
        counted = jobs.daily_counters(S.growing_table(spark, landing, table(spark, []).schema), "30 days")
        jobs.run_available(jobs.start(counted, jobs.batch_writer(out), checkpoint, "update"))
    expected = sorted(map(tuple, P.daily_rollup(table(spark, rows + rows[:1])).select(*keys, "events").collect()))
    assert sorted(map(tuple, jobs.current_counters(spark, out, keys).select(*keys, "events").collect())) == expected


def test_closed_sessions_come_out_behind_the_watermark(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "sessions", "checkpoint"))
    rows = [("a", 1, "t", D, "{}", 1), ("b", 1, "t", D + timedelta(minutes=5), "{}", 2), ("z", 1, "t", D + timedelta(days=2), "{}", 3)]
    for part in ([rows[0], rows[1]], [rows[2]]):
        feed(table(spark, part), landing)
        sessions = jobs.session_counters(S.growing_table(spark, landing, table(spark, []).schema), 600, "1 hour")
        jobs.run_available(jobs.start(sessions, jobs.batch_writer(out), checkpoint))
    got = spark.read.parquet(out).select("started_at", "ended_at", "event_count").collect()
    assert [tuple(r) for r in got] == [(D, D + timedelta(minutes=5), 2)]


def test_landed_lines_skip_older_files_and_bad_lines(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("lines", "out", "checkpoint"))
    write_event_lines(table(spark, [("a", 1, "t", D, '{"x":1}', 1)]), landing)
    spark.createDataFrame([("broken",)], "value string").write.mode("append").text(landing)
    events = S.event_stream(S.landed_lines(spark, landing), "{}")
    merged = merge_sources({"files": events})
    jobs.run_available(jobs.start(merged, jobs.batch_writer(out), checkpoint))
    got = [tuple(r) for r in spark.read.parquet(out).select("type", "occurred_at", "payload_json", "source_name").collect()]
    assert got == [("t", D, '{"x":1}', "files")]
    future = S.event_stream(S.landed_lines(spark, landing, since=datetime.now() + timedelta(days=1)), "{}")
    jobs.run_available(jobs.start(future, jobs.batch_writer(out + "2"), checkpoint + "2"))
    assert not list(tmp_path.glob("out2/batch_id=*"))


def test_no_source_is_an_error():
    with pytest.raises(ValueError):
        merge_sources({})


def session_rows(*events):
    return [(f"e{user}-{hour}", user, "t", D + timedelta(hours=hour), "{}", int(hour * 10)) for user, hour in events]


def test_sessions_merge_close_once_and_leave_the_state(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "sessions", "checkpoint"))
    rounds = [
        session_rows((1, 0), (1, 22), (2, 0), (1, 30)),
        session_rows((1, 11), (1, 22), (2, 40), (1, 30)),  # the first joins what were two sessions; repeats
        session_rows((1, 100), (2, 120), (1, 1)),  # the last is behind the watermark
    ]
    got = []
    for rows in rounds:
        feed(table(spark, rows), landing)
        stream = S.growing_table(spark, landing, table(spark, []).schema)
        jobs.run_available(jobs.start(jobs.session_counters(stream, 12 * 3600, "1 day"), jobs.batch_writer(out), checkpoint))
        now = jobs.current_sessions(spark, out, checkpoint).collect()
        got.append(sorted((r.user_id, (r.started_at - D).total_seconds() / 3600, (r.ended_at - D).total_seconds() / 3600, r.event_count, r.open) for r in now))
    assert got[0] == [(1, 0, 0, 1, True), (1, 22, 30, 2, True), (2, 0, 0, 1, True)]
    assert got[1] == [(1, 0, 30, 4, True), (2, 0, 0, 1, False), (2, 40, 40, 1, True)]
    assert got[2] == [(1, 0, 30, 4, False), (1, 100, 100, 1, True), (2, 0, 0, 1, False), (2, 40, 40, 1, False), (2, 120, 120, 1, True)]
    assert jobs.closed_sessions(spark, out).count() == 3 and jobs.open_sessions(spark, checkpoint).count() == 2


def test_ticker_opens_only_the_batch_before(spark, tmp_path):
    """History that cannot be read does not matter, and an event delivered again counts once."""
    folder = str(tmp_path / "ticker")
    write = jobs.ticker_writer(folder, 2)
    for n in range(4):
        write(table(spark, [(f"e{n}", 1, "t", D + timedelta(hours=n), "{}", n), ("e0", 1, "t", D, "{}", 0)]), n)
        if n >= 2:
            (tmp_path / "ticker" / f"batch_id={n - 2}" / "part-broken.parquet").write_bytes(b"no table")
    rows = spark.read.parquet(f"{folder}/batch_id=3").collect()
    assert sorted(r.event_id for r in rows) == ["e2", "e3"]
