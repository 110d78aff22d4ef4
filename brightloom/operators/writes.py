"""Crawl batches that hold a URL more than once, settled as if written one request after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators.ordered import BLOCK_ROWS, best_before
from brightloom.operators.rules import load_rules, normalize, page_candidates, validate
from brightloom.session import cut_lineage

KEY = ["source_id", "url"]
_BEFORE_ALL, _AFTER_ALL = -(2**62), 2**62


def write_batch(requests: DataFrame, stored: DataFrame, rules: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`(page_id, source_id, url, content_hash, seq, verdict)` of every request.

    `requests` is `(page_id, source_id, url, html, seq, ...)` without NULL in these, `seq` a whole
    number that orders the batch and occurs once; `stored` has one row per source and URL. The
    verdicts are those of writing one request after another: `unchanged` if the page holds
    these bytes at that moment, else `rejected` by validation, else `deduped` (the URL is new
    and a page of the source holds these bytes at that moment) or `stored`. `page_id` is the
    stored page's, that of the request that first stored the URL, or the request's own.
    """
    candidates = page_candidates(requests).withColumn("content_hash", F.sha2("html", 256))
    checked = validate(normalize(candidates, load_rules(rules, "normalize")), load_rules(rules, "validate"))
    kinds = [rule.kind for rule in load_rules(rules, "dedup")]
    return settle(checked, stored, kinds, block_rows)


def settle(checked: DataFrame, stored: DataFrame, dedup_kinds: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Verdicts of validated requests `(page_id, KEY, canonical_url, content_hash, seq, passed)`.

    Once a URL is stored, each later valid request leaves its bytes there, so bytes are held from
    a valid request to the next one of its URL. Only the request that first stores a URL depends
    on the other URLs: the guess that it is the first valid one is corrected until nothing
    changes. A request depends on earlier ones alone, hence every round settles at least one more
    request of each source for good, and the end is the only solution.
    """
    narrow = checked.select(
        "page_id", *KEY, "canonical_url", "content_hash", F.col("seq").cast("long").alias("seq"), "passed"
    )
    known = stored.select(*KEY, F.col("page_id").alias("known_id"), F.col("content_hash").alias("known_hash"))
    backwards = narrow.withColumn("_back", -F.col("seq"))
    following = best_before(backwards, KEY, "_back", F.when(F.col("passed"), F.col("seq")), "until", block_rows)
    rows = cut_lineage(
        following.drop("_back").join(known, KEY, "left").withColumn("until", F.coalesce("until", F.lit(_AFTER_ALL)))
    )
    by_hash = "near_duplicate_hash" in dedup_kinds
    before_hash = dedup_kinds[: dedup_kinds.index("near_duplicate_hash")] if by_hash else []
    merged_first = "same_canonical_url" in before_hash

    first = F.min(F.struct("seq", "page_id"))
    new_and_valid = F.col("known_id").isNull() & F.col("passed")
    guess = rows.filter(new_and_valid).groupBy(*KEY).agg(first.alias("accepted"))
    if by_hash:
        guess = cut_lineage(guess)
        held_from_store = _held_from_store(rows, stored)
        changed = True
        while changed:
            placed = _placed(rows, guess)
            taken = _taken(placed, held_from_store, block_rows)
            if merged_first:
                taken = _unless_merged(taken, stored)
            better = cut_lineage(taken.filter(new_and_valid & ~F.col("taken")).groupBy(*KEY).agg(first.alias("accepted")))
            changed = not guess.exceptAll(better).isEmpty() or not better.exceptAll(guess).isEmpty()
            guess = better
    return _verdicts(_placed(rows, guess), block_rows)


def _placed(rows: DataFrame, guess: DataFrame) -> DataFrame:
    """Rows with the request that first stored their URL and whether their bytes were left there."""
    since = F.when(F.col("known_id").isNotNull(), F.lit(_BEFORE_ALL)).otherwise(F.col("accepted.seq"))
    joined = rows.join(guess, KEY, "left").withColumn("since", since)
    return joined.withColumn("holds", F.col("passed") & F.coalesce(F.col("seq") >= F.col("since"), F.lit(False)))


def _held_from_store(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Until when any stored page of a source holds the bytes, for the bytes of the batch."""
    replaced = rows.filter("passed").groupBy(*KEY).agg(F.min("seq").alias("_replaced"))
    wanted = rows.select("source_id", "content_hash").distinct()
    return cut_lineage(
        stored.select(*KEY, "content_hash")
        .join(wanted, ["source_id", "content_hash"], "left_semi")
        .join(replaced, KEY, "left")
        .groupBy("source_id", "content_hash")
        .agg(F.max(F.coalesce("_replaced", F.lit(_AFTER_ALL))).alias("store_until"))
    )


def _taken(placed: DataFrame, held_from_store: DataFrame, block_rows: int) -> DataFrame:
    """Whether another page of the source holds a request's bytes when it comes.

    Bytes that the request's own URL left earlier are held until this request at most.
    """
    group = ["source_id", "content_hash"]
    held = best_before(placed, group, "seq", F.when(F.col("holds"), -F.col("until")), "_held", block_rows)
    until = F.greatest(-F.col("_held"), F.col("store_until"))
    return held.join(held_from_store, group, "left").withColumn("taken", F.coalesce(until > F.col("seq"), F.lit(False)))


def _unless_merged(taken: DataFrame, stored: DataFrame) -> DataFrame:
    """A page that shares its canonical URL with an earlier one is merged before bytes are compared."""
    group = ["source_id", "canonical_url"]
    in_store = stored.select(*group).withColumn("since", F.lit(_BEFORE_ALL))
    earliest = taken.select(*group, "since").unionByName(in_store).groupBy(*group).agg(F.min("since").alias("_earliest"))
    merged = F.coalesce(F.col("_earliest") < F.col("seq"), F.lit(False))
    return taken.join(earliest, group, "left").withColumn("taken", F.col("taken") & ~merged)


def _verdicts(placed: DataFrame, block_rows: int) -> DataFrame:
    latest = F.when(F.col("holds"), F.struct((-F.col("seq")).alias("at"), F.col("content_hash").alias("bytes")))
    seen = best_before(placed, KEY, "seq", latest, "_latest", block_rows)
    exists = F.coalesce(F.col("since") < F.col("seq"), F.lit(False))
    same = exists & (F.coalesce("_latest.bytes", "known_hash") == F.col("content_hash"))
    accepted = F.coalesce(F.col("since") <= F.col("seq"), F.lit(False))
    return seen.select(
        F.when(accepted, F.coalesce("known_id", "accepted.page_id")).otherwise(F.col("page_id")).alias("page_id"),
        *KEY,
        "content_hash",
        "seq",
        F.when(same, "unchanged").when(~F.col("passed"), "rejected").when(accepted, "stored").otherwise("deduped").alias("verdict"),
    )
