"""Secret scan with corpus-wide ownership: who else has this credential?

A credential from documentation is copied into many repositories of many owners; a live one
stays with its owner. So candidates are hashed, their distinct owners and repositories are
counted over the whole corpus, and each span is judged by the count. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.batches import stored
from brightloom.llm.spans import overlaps, with_matches, written

# The patterns of the kinds, in the order of their rank.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs of capitals and digits are maximal, so a short one can be left out by the pattern
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "token")
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000000|1234567|abcdef"


def scan(docs: DataFrame, owner: Column, repository: Column, id_column: str, text_column: str) -> DataFrame:
    """One narrow row for each document: its candidates of all kinds, with hashes in place of values."""
    text = docs.select(F.col(id_column).alias("doc_id"), owner.alias("owner"), repository.alias("repository"), F.col(text_column).alias("text"))
    found = with_matches(text, "assign", "text", ASSIGN, 2)
    for name, pattern in zip(KINDS[1:], (ACCESS, HEX, TOKEN)):
        found = with_matches(found, name, "text", pattern)
    found = found.withColumn("assign", F.filter("assign", lambda s: F.length(s["part"]) >= 6)).drop("text")
    base = F.concat("assign", "access", "hex")
    mixed = [r"[0-9]", r"[a-z]", r"[A-Z]"]
    found = found.withColumn("_base", base).withColumn(
        "token",
        F.filter(
            "token",
            lambda s: s["value"].rlike(mixed[0]) & s["value"].rlike(mixed[1]) & s["value"].rlike(mixed[2])
            & (F.size(F.array_distinct(F.split(s["value"], ""))) >= 12) & ~overlaps(s["start"], s["end"], F.col("_base")),
        ),
    )

    def tagged(name: str) -> Column:
        def one(s: Column) -> Column:
            value = F.coalesce(s["part"], s["value"])
            return F.struct(
                F.lit(name).alias("kind"), F.lit(KINDS.index(name)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"),
                F.unhex(F.md5(value)).alias("hash"), value.rlike(PLACEHOLDER).alias("placeholder"),
            )

        return F.transform(name, one)

    return found.select("doc_id", "owner", "repository", F.monotonically_increasing_id().alias("row"), F.concat(*map(tagged, KINDS)).alias("candidates"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repositories): distinct holders of each candidate; null is a holder like any other.

    Each step is a count that combines before its shuffle, so a value held by everybody is one
    row for each task.
    """
    once = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("_one"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def scan_secrets(
    docs: DataFrame, owner: Column, repository: Column, live_owners: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, spans) of every whole text.

    spans, by start and rank of kind: kind, start, end, owners, repositories and verdict: `live`
    if at most `live_owners` owners hold the value and it doesn't look like a placeholder, else
    `example`. The three base kinds are always given; a `token` (a long mixed word that meets no
    base span) only if it is live. A null text has no spans; null ids pass through; each of
    several equal rows gets the same spans, and together they count once; no rows give no rows.
    """
    found = stored(scan(docs, owner, repository, id_column, text_column))
    each = found.select("row", "owner", "repository", F.explode("candidates").alias("c")).select("row", "owner", "repository", "c.*")
    held = stored(ownership(each))
    live = (F.col("owners") <= live_owners) & ~F.col("placeholder")
    judged = each.join(held, "hash").withColumn("verdict", F.when(live, "live").otherwise("example"))
    judged = judged.filter("kind <> 'token' OR verdict = 'live'")
    span = F.struct("start", "rank", "end", "kind", "owners", held["repositories"], "verdict")
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,owners:bigint,repositories:bigint,verdict:string>>")
    return found.select("doc_id", "row").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def secret_digests(scanned: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans written out."""
    spans = F.col("spans")

    def count(field: str, value: str) -> Column:
        return F.size(F.filter(spans, lambda s: s[field] == value)).cast("bigint")

    return scanned.select(
        "doc_id",
        *[count("kind", kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(written(F.filter(spans, lambda s: s["kind"] != "token")), 256).alias("base_sha256"),
        written(spans).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"),
    )
