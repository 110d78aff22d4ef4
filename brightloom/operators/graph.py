"""The page graph: links, mentions of named pages, and pages that supersede others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import text as X
from brightloom.functions.shaping import let, unrolled
from brightloom.functions.urls import absolute_url
from brightloom.operators.ordered import BLOCK_ROWS, best_before
from brightloom.operators.pages import page_links

# Fixed values.
EVIDENCE_MAX_CHARS = 200
MIN_NAME_CHARS = 3
UNKNOWN_TIER = 2**31 - 1

# Words of a name that must match before its page is read for the whole name.
LEAD_WORDS = 4

EDGE_COLUMNS = ["src_page_id", "dst_page_id", "dst_url", "edge_type", "weight", "evidence"]


def absolute_links(pages: DataFrame) -> DataFrame:
    """Distinct absolute links of each page, with the text of the first one."""
    resolved = page_links(pages).withColumn("dst_url", absolute_url(F.col("href"), F.col("url")))
    return (
        resolved.filter(F.col("dst_url").isNotNull())
        .groupBy("page_id", "source_id", "dst_url")
        .agg(F.min_by("link_text", "ord").alias("link_text"))
    )


def resolve_links(links: DataFrame, known_pages: DataFrame) -> DataFrame:
    """Links with the page they lead to, if the same source has one under that URL."""
    targets = known_pages.select("source_id", F.col("url").alias("dst_url"), F.col("page_id").alias("dst_page_id"))
    return links.join(targets, ["source_id", "dst_url"], "left")


def link_edges(pages: DataFrame, known_pages: DataFrame, schemes: tuple[str, ...] | None = None) -> DataFrame:
    """`link` edges of pages; links of a page to itself are left out.

    Every resolvable reference counts, mail links and fragments included; `schemes` keeps
    only some.
    """
    links = absolute_links(pages)
    if schemes is not None:
        links = links.filter(F.substring_index("dst_url", ":", 1).isin(*schemes))
    evidence = F.substring(X.trim_all(F.col("link_text")), 1, EVIDENCE_MAX_CHARS)
    return (
        resolve_links(links, known_pages)
        .filter(F.col("dst_page_id").isNull() | (F.col("dst_page_id") != F.col("page_id")))
        .select(
            F.col("page_id").alias("src_page_id"),
            "dst_page_id",
            "dst_url",
            F.lit("link").alias("edge_type"),
            F.lit(1.0).alias("weight"),
            F.nullif(evidence, F.lit("")).alias("evidence"),
        )
    )


def _lead(words: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), length), " ")


def mention_edges(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """`entity_mention` edges: pages whose words contain an entity's whole name.

    `texts` is `(page_id, text)`, `entities` is `(normalized, kind, canonical_page_id)`. Both
    sides meet on the first words of the name, not on every text and name: a page lists
    each distinct run of one to four words once, and only the pairs that share one are
    compared in full. Pages do not mention themselves.
    """
    usable = entities.filter(F.col("canonical_page_id").isNotNull() & (F.length("normalized") >= MIN_NAME_CHARS))
    name_words = F.split("normalized", " ")
    named = usable.withColumn("_lead", _lead(name_words, F.least(F.size(name_words), F.lit(LEAD_WORDS)))).select(
        "normalized", "kind", "canonical_page_id", "_lead"
    )

    def runs(words: Column, length: int) -> Column:
        starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(length)), " ")), F.array().cast("array<string>"))

    # Shorter runs only matter for names that have no more words than that.
    lengths = [row[0] for row in named.select(F.size(F.split("_lead", " "))).distinct().collect()]
    normal = texts.select("page_id", X.normalize_name(F.col("text")).alias("_normal"))
    if not lengths:
        lengths = [1]
    all_runs = let(
        F.split(F.col("_normal"), " "), lambda words: F.array_distinct(F.concat(*[runs(words, n) for n in sorted(lengths)]))
    )
    candidates = (
        unrolled(normal, ["page_id"], all_runs, "_lead").select(F.col("page_id").alias("src_page_id"), "_lead")
        .join(named, "_lead")
        .filter(F.col("canonical_page_id") != F.col("src_page_id"))
        .drop("_lead")
    )
    checked = candidates.join(normal.withColumnRenamed("page_id", "src_page_id"), "src_page_id").filter(
        F.contains(F.concat(F.lit(" "), F.col("_normal"), F.lit(" ")), F.concat(F.lit(" "), F.col("normalized"), F.lit(" ")))
    )
    return checked.select(
        "src_page_id",
        F.col("canonical_page_id").alias("dst_page_id"),
        F.lit(None).cast("string").alias("dst_url"),
        F.lit("entity_mention").alias("edge_type"),
        F.lit(1.0).alias("weight"),
        F.lit(None).cast("string").alias("evidence"),
        F.col("normalized").alias("mentioned"),
        F.col("kind").alias("mentioned_kind"),
    )


def entity_decisions(pages: DataFrame, sources: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each page against the page its entity had when it arrived, in `seq` order.

    The entity of a page is its normalised title (its URL without one) and its page type.
    The lower source tier wins, an equal tier changes nothing. `outcome` is `first`, `won`,
    `lost` or `tied`; `other_page_id` is the page it met.
    """
    name = F.coalesce("title", "url")
    tiers = sources.select("source_id", "tier")
    named = (
        pages.join(tiers, "source_id", "left")
        .select(
            "page_id",
            "seq",
            F.coalesce("tier", F.lit(UNKNOWN_TIER)).alias("tier"),
            name.alias("name"),
            X.normalize_name(name).alias("normalized"),
            F.col("page_type").alias("kind"),
        )
        .filter(F.col("normalized") != "")
    )
    rank = F.struct("tier", "seq", "page_id")
    met = best_before(named, ["normalized", "kind"], "seq", rank, "_held", block_rows)
    outcome = (
        F.when(F.col("_held").isNull(), "first")
        .when(F.col("tier") < F.col("_held.tier"), "won")
        .when(F.col("tier") > F.col("_held.tier"), "lost")
        .otherwise("tied")
    )
    return met.withColumn("outcome", outcome).withColumn("other_page_id", F.col("_held.page_id")).drop("_held")


def registered_entities(decisions: DataFrame) -> DataFrame:
    """Entities with their canonical page.

    The name is that of the last page that was first or met another tier, even where it lost.
    """
    naming = F.when(F.col("outcome") != "tied", F.col("seq"))
    return decisions.groupBy("normalized", "kind").agg(
        F.max_by("name", naming).alias("name"),
        F.min_by("page_id", F.struct("tier", "seq")).alias("canonical_page_id"),
    )


def supersede_edges(decisions: DataFrame) -> DataFrame:
    """`supersedes` edges from the winner to the loser of every decided meeting."""
    won = F.col("outcome") == "won"
    return decisions.filter(F.col("outcome").isin("won", "lost")).select(
        F.when(won, F.col("page_id")).otherwise(F.col("other_page_id")).alias("src_page_id"),
        F.when(won, F.col("other_page_id")).otherwise(F.col("page_id")).alias("dst_page_id"),
        F.lit(None).cast("string").alias("dst_url"),
        F.lit("supersedes").alias("edge_type"),
        F.lit(1.0).alias("weight"),
        F.lit(None).cast("string").alias("evidence"),
    )


def deprecate_losers(pages: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pages with the losers of decided meetings marked `deprecated`."""
    losers = supersede_edges(decisions).select(F.col("dst_page_id").alias("page_id")).distinct()
    marked = pages.join(losers.withColumn("_lost", F.lit(True)), "page_id", "left")
    return marked.withColumn("lifecycle", F.when(F.col("_lost"), F.lit("deprecated")).otherwise(F.col("lifecycle"))).drop("_lost")


def relationship_edges(pages: DataFrame, known_pages: DataFrame, sources: DataFrame) -> DataFrame:
    """All edges of extracted pages: links, mentions of the snapshot's entities, supersedes."""
    decisions = entity_decisions(known_pages, sources)
    texts = pages.select("page_id", F.array_join(F.transform("blocks", lambda b: b["text"]), " ").alias("text"))
    mentions = mention_edges(texts, registered_entities(decisions)).select(*EDGE_COLUMNS)
    return link_edges(pages, known_pages).unionByName(mentions).unionByName(supersede_edges(decisions))


def insert_edges(current: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after inserting `new` in `seq` order; a (source, URL, type) that exists stays.

    Edges without a URL never collide with anything.
    """
    key = ["src_page_id", "dst_url", "edge_type"]
    rest = [c for c in new.columns if c not in key and c != "seq"]
    with_url = new.filter(F.col("dst_url").isNotNull())
    firsts = with_url.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("_first")).select(*key, "_first.*")
    fresh = firsts.join(current.filter(F.col("dst_url").isNotNull()).select(*key), key, "left_anti")
    without_url = new.filter(F.col("dst_url").isNull()).drop("seq")
    return current.unionByName(fresh).unionByName(without_url)
