"""The event ledger: insert-or-ignore under two keys, and replayed requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions import scalars as S
from brightloom.session import cut_lineage

CONTENT_KEY = ["user_id", "content_hash"]


def with_content_hash(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "content_hash",
        S.server_content_hash(F.col("user_id"), F.col("type"), F.col("occurred_at"), F.col("payload_json")),
    )


def accept_events(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Flag each incoming row `accepted`, as if rows were inserted one by one in `seq` order.

    A row is refused when its event id or its (user, content hash) is already *inserted*; a
    row that was itself refused blocks nobody. Refusals can therefore free later rows, which
    takes rounds: every row that comes first under both of its keys is inserted, everything
    sharing a key with an inserted row goes, and what is left goes round again. Plain
    repetitions end after one round.

    Exact repetitions are merged before anything is shuffled, and both minima are combined
    on the map side, so many copies of one event cost no more than one.
    """
    hashed = with_content_hash(incoming)
    open_rows = hashed.groupBy("event_id", *CONTENT_KEY).agg(F.min("seq").alias("seq"))
    if stored is not None:
        open_rows = open_rows.join(stored.select("event_id"), "event_id", "left_anti")
        open_rows = open_rows.join(stored.select(*CONTENT_KEY), CONTENT_KEY, "left_anti")
    open_rows = cut_lineage(open_rows)
    inserted = None
    while True:
        first_of_id = open_rows.groupBy("event_id").agg(F.min("seq").alias("seq"))
        first_of_content = open_rows.groupBy(*CONTENT_KEY).agg(F.min("seq").alias("seq"))
        winners = cut_lineage(first_of_id.join(first_of_content, "seq"))
        inserted = winners if inserted is None else inserted.unionByName(winners)
        open_rows = cut_lineage(
            open_rows.join(winners.select("event_id"), "event_id", "left_anti").join(
                winners.select(*CONTENT_KEY), CONTENT_KEY, "left_anti"
            )
        )
        if open_rows.isEmpty():
            break
    marks = inserted.select("seq", F.lit(True).alias("accepted"))
    return hashed.join(marks, "seq", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def next_ledger(stored: DataFrame, decided: DataFrame, received_at: datetime) -> DataFrame:
    """The stored events with the accepted rows of a decided batch added."""
    added = decided.filter("accepted").drop("accepted").withColumn("received_at", F.lit(received_at).cast("timestamp"))
    return stored.unionByName(added, allowMissingColumns=True)


def batch_counts(decided: DataFrame) -> DataFrame:
    """Accepted and duplicate rows per user."""
    return decided.groupBy("user_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("duplicates")
    )


def answer_requests(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """Requests `(user_id, idempotency_key, seq, response_json)` with the answer each one gets.

    A key already answered for the user returns the stored answer; otherwise the first
    request with the key answers for all of them. Requests without a key always count as new.
    """
    key = ["user_id", "idempotency_key"]
    keyed = requests.filter(F.col("idempotency_key").isNotNull())
    firsts = keyed.groupBy(*key).agg(
        F.min("seq").alias("_first_seq"), F.min_by("response_json", "seq").alias("_first_response")
    )
    known = answered.select(*key, F.col("response_json").alias("_stored"))
    answers = firsts.join(known, key, "left")
    return requests.join(answers, key, "left").select(
        "seq",
        *key,
        F.coalesce("_stored", "_first_response", "response_json").alias("response_json"),
        (F.col("_stored").isNotNull() | F.coalesce(F.col("seq") != F.col("_first_seq"), F.lit(False))).alias("replayed"),
    )


def next_answers(requests: DataFrame, answered: DataFrame, as_of: datetime) -> DataFrame:
    """The stored answers with those of new keys added; the first write of a key stays."""
    key = ["user_id", "idempotency_key"]
    fresh = (
        requests.filter(F.col("idempotency_key").isNotNull())
        .groupBy(*key)
        .agg(F.min_by("response_json", "seq").alias("response_json"))
        .join(answered, key, "left_anti")
    )
    return answered.unionByName(fresh.withColumn("created_at", F.lit(as_of).cast("timestamp")), allowMissingColumns=True)


def latest_by_server_clock(states: DataFrame, keys: list[str], clock: str) -> DataFrame:
    """Server wins: of several states of a key the one written last by the server's clock."""
    rest = [c for c in states.columns if c not in keys]
    newest = states.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(clock), *rest)).alias("_newest"))
    return newest.select(*keys, "_newest.*")
