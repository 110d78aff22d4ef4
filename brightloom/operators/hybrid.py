"""Hybrid search: two ranked arms, fused by reciprocal rank, guarded, boosted, expanded."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import scalars as S
from brightloom.operators.text_index import TextIndex, keyword_hits
from brightloom.operators.vector_search import nearest_vectors
from brightloom.session import cut_lineage

# Fixed values.
RRF_K = 60
CANDIDATE_FACTOR = 3
MAX_TOP_K = 50
DEFAULT_EDGE_TYPES = ("prerequisite", "see_also", "part_of")
MODES = ("hybrid", "semantic", "keyword")


@dataclass(frozen=True)
class SearchFilters:
    """Conditions on pages; None, or an empty list of types, sets no condition."""

    page_types: tuple[str, ...] | None = None
    tiers_max: int | None = None
    language: str | None = None
    lifecycle: str | None = None
    crawled_from: datetime | None = None

    def condition(self) -> Column:
        """All conditions on `page_type, source_tier, language, lifecycle, crawled_at`.

        A missing value fails a condition set on it.
        """
        checks = []
        if self.page_types:
            checks.append(F.col("page_type").isin(*self.page_types))
        if self.tiers_max is not None:
            checks.append(F.col("source_tier") <= self.tiers_max)
        if self.language is not None:
            checks.append(F.col("language") == self.language)
        if self.lifecycle is not None:
            checks.append(F.col("lifecycle") == self.lifecycle)
        if self.crawled_from is not None:
            checks.append(F.col("crawled_at") >= F.lit(self.crawled_from).cast("timestamp"))
        combined = F.lit(True)
        for check in checks:
            combined = combined & F.coalesce(check, F.lit(False))
        return combined

    def namespace(self) -> str | None:
        """The one page type asked for: it names a folder of the vector table."""
        return self.page_types[0] if self.page_types is not None and len(self.page_types) == 1 else None


@dataclass(frozen=True)
class SearchOptions:
    as_of: datetime
    top_k: int = 10
    mode: str = "hybrid"
    filters: SearchFilters = field(default_factory=SearchFilters)
    expand: bool = False
    edge_types: tuple[str, ...] = DEFAULT_EDGE_TYPES
    candidate_factor: int = CANDIDATE_FACTOR
    strict_ascii_terms: bool = False
    # Apply the filters to the keyword arm before it is cut to its candidates, not only to what the cut leaves.
    filter_before_cut: bool = False

    def __post_init__(self):
        if not 1 <= self.top_k <= MAX_TOP_K:
            raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


@dataclass(frozen=True)
class Corpus:
    """The tables a search reads; `edges` only matters when results are expanded."""

    chunks: DataFrame
    pages: DataFrame
    sources: DataFrame
    vectors: DataFrame
    text_index: TextIndex
    edges: DataFrame | None = None


def filter_vectors(vectors: DataFrame, filters: SearchFilters) -> DataFrame:
    """Vectors a search may return, by the metadata stored with them."""
    namespace = filters.namespace()
    if namespace is not None:
        vectors = vectors.filter(F.col("namespace") == namespace)
    return vectors.filter(filters.condition())


def fuse_ranks(arms: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of `(query_id, arm, chunk_id, rank, score)` rows.

    Every chunk is listed once with its fused score and its rank and score in each arm.
    """

    def of_arm(arm: str, column: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(column)))

    return arms.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fused"),
        of_arm("semantic", "score").alias("semantic"),
        of_arm("keyword", "score").alias("keyword"),
        of_arm("semantic", "rank").alias("semantic_rank"),
        of_arm("keyword", "rank").alias("keyword_rank"),
    )


def admitted_chunks(corpus: Corpus, filters: SearchFilters) -> DataFrame:
    """(chunk_id) of the chunks whose page meets the filters, by its live fields."""
    tiers = corpus.sources.select("source_id", F.col("tier").alias("source_tier"))
    pages = corpus.pages.join(tiers, "source_id", "left").withColumn("source_tier", F.coalesce("source_tier", F.lit(0)))
    return corpus.chunks.select("chunk_id", "page_id").join(pages.filter(filters.condition()).select("page_id"), "page_id", "left_semi").select("chunk_id")


def ranked_arms(queries: DataFrame, corpus: Corpus, options: SearchOptions) -> DataFrame:
    """Both arms of the search, as far as the mode asks for them, in one list."""
    wanted = options.top_k * options.candidate_factor
    arms = []
    if options.mode != "keyword":
        near = nearest_vectors(queries, filter_vectors(corpus.vectors, options.filters), wanted)
        arms.append(near.select("query_id", F.lit("semantic").alias("arm"), F.col("vector_id").alias("chunk_id"), "rank", "score"))
    if options.mode != "semantic":
        admitted = admitted_chunks(corpus, options.filters) if options.filter_before_cut else None
        hits = keyword_hits(queries, corpus.text_index, wanted, options.strict_ascii_terms, admitted)
        arms.append(hits.select(F.col("query_id").cast("string").alias("query_id"), F.lit("keyword").alias("arm"), "chunk_id", "rank", "score"))
    return arms[0] if len(arms) == 1 else arms[0].unionByName(arms[1])


def _described(hits: DataFrame, corpus: Corpus, options: SearchOptions) -> DataFrame:
    """Hits with their chunk, its page and the source's tier; hits without a page are dropped."""
    chunks = corpus.chunks.select("chunk_id", "page_id", "heading_path", S.snippet(F.col("text")).alias("snippet"))
    pages = corpus.pages.select(
        "page_id", "source_id", "url", "title", "page_type", "language", "lifecycle", "crawled_at"
    )
    tiers = corpus.sources.select("source_id", F.col("tier").alias("source_tier"))
    joined = hits.join(chunks, "chunk_id").join(pages, "page_id").join(tiers, "source_id", "left")
    joined = joined.withColumn("source_tier", F.coalesce("source_tier", F.lit(0)))
    return joined.withColumn("tier_boost", S.tier_boost(F.col("source_tier"))).withColumn(
        "freshness", S.freshness(F.col("crawled_at"), F.lit(options.as_of).cast("timestamp"))
    )


RESULT_COLUMNS = [
    "query_id", "position", "chunk_id", "page_id", "url", "title", "heading_path", "page_type", "source_tier",
    "snippet", "semantic", "keyword", "fused", "tier_boost", "freshness", "via",
]


def primary_results(fused: DataFrame, corpus: Corpus, options: SearchOptions) -> DataFrame:
    """Hydrate, guard with the same filters on live page fields, order by fused + tier, cut.

    Freshness is reported and does not order. Ties fall to the semantic, then the keyword
    rank, then the chunk id.
    """
    kept = _described(fused, corpus, options).filter(options.filters.condition())
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.round(F.col("fused") + F.col("tier_boost"), 12)),
        F.asc_nulls_last("semantic_rank"),
        F.asc_nulls_last("keyword_rank"),
        "chunk_id",
    )
    ranked = kept.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= options.top_k)
    return ranked.withColumn("via", F.lit("primary")).select(*RESULT_COLUMNS)


def expand_results(primary: DataFrame, corpus: Corpus, options: SearchOptions) -> DataFrame:
    """Pages one chosen edge away from the results, by their first chunk, after the results.

    Each page comes once, at the first result and edge leading to it; pages among the results
    and pages without chunks are left out. The search filters do not apply to them.
    """
    edges = corpus.edges.filter(F.col("dst_page_id").isNotNull() & F.col("edge_type").isin(*options.edge_types))
    from_results = primary.select("query_id", "position", F.col("page_id").alias("src_page_id"))
    # A page with several results is followed from its best one only.
    from_results = from_results.groupBy("query_id", "src_page_id").agg(F.min("position").alias("_parent"))
    already = primary.select("query_id", F.col("page_id").alias("dst_page_id")).distinct()
    reached = edges.join(from_results, "src_page_id").join(already, ["query_id", "dst_page_id"], "left_anti")
    order = ["_parent", "edge_type", F.desc("weight"), "edge_id"]
    first_way = Window.partitionBy("query_id", "dst_page_id").orderBy(*order)
    targets = cut_lineage(reached.withColumn("_way", F.row_number().over(first_way)).filter(F.col("_way") == 1))
    first_chunks = (
        corpus.chunks.join(targets.select(F.col("dst_page_id").alias("page_id")).distinct(), "page_id", "left_semi")
        .groupBy("page_id")
        .agg(F.min_by("chunk_id", "ord").alias("chunk_id"))
    )
    hits = targets.withColumnRenamed("dst_page_id", "_dst").join(
        first_chunks.withColumnRenamed("page_id", "_dst"), "_dst"
    ).drop("_dst")
    described = _described(hits, corpus, options)
    within_query = Window.partitionBy("query_id").orderBy(*order)
    found = primary.groupBy("query_id").agg(F.max("position").alias("_found"))
    numbered = described.withColumn("_nr", F.row_number().over(within_query)).join(found, "query_id")
    return (
        numbered.withColumn("position", F.col("_found") + F.col("_nr"))
        .withColumn("semantic", F.lit(None).cast("double"))
        .withColumn("keyword", F.lit(None).cast("double"))
        .withColumn("fused", F.lit(0.0))
        .withColumn("via", F.lit("relationship"))
        .select(*RESULT_COLUMNS)
    )


def hybrid_search(queries: DataFrame, corpus: Corpus, options: SearchOptions) -> DataFrame:
    """Ranked results for queries `(query_id, text, embedding)`, all queries in one plan."""
    # A few dozen rows per query. Once written their size is known, and the joins with the
    # chunk and page tables can send them to the tables instead of shuffling those.
    fused = cut_lineage(fuse_ranks(ranked_arms(queries, corpus, options)))
    primary = primary_results(fused, corpus, options)
    if not options.expand:
        return primary
    # A few rows per query that the expansion reads several times.
    primary = cut_lineage(primary)
    return primary.unionByName(expand_results(primary, corpus, options))
