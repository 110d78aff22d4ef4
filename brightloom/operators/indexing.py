"""The index job: from stored HTML to chunks, sections, markdown, vectors and edges."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.html import DropRules
from brightloom.operators import embed, graph
from brightloom.operators import pages as P
from brightloom.operators.upsert import replace_rows
from brightloom.session import cut_lineage


@dataclass(frozen=True)
class IndexedPages:
    """New rows of every table for the pages of one run."""

    page_ids: DataFrame
    chunks: DataFrame
    sections: DataFrame
    markdown: DataFrame
    vectors: DataFrame
    ledger: DataFrame
    edges: DataFrame


def index_pages(
    ready: DataFrame,
    known_pages: DataFrame,
    sources: DataFrame,
    source_rules: DataFrame,
    model: str,
    as_of: datetime,
    embedder: embed.Embedder = embed.hash_embedder,
    dims: int = embed.EMBEDDING_DIMS,
    drop_rules: DropRules = DropRules(),
) -> IndexedPages:
    """Index pages that have HTML; links and mentions resolve against the whole snapshot.

    The cleaned pages are written once and every table is derived from them, so the HTML is
    parsed a single time. Chunks are written too: they feed both the model and the index.
    """
    cleaned = cut_lineage(P.clean_pages(P.extract_pages(ready, drop_rules), source_rules))
    chunks = cut_lineage(P.chunk_pages(cleaned))
    vectors = embed.vector_rows(chunks, cleaned, sources, embedder, dims)
    ledger_input = chunks.join(cleaned.select("page_id", "page_type"), "page_id").select(
        "chunk_id", F.col("chunk_id").alias("vector_id"), F.col("page_type").alias("namespace")
    )
    return IndexedPages(
        page_ids=cleaned.select("page_id"),
        chunks=chunks,
        sections=P.page_sections(cleaned),
        markdown=P.page_markdown(cleaned),
        vectors=vectors,
        ledger=embed.embedding_ledger(ledger_input, model, F.lit(as_of).cast("timestamp")),
        edges=graph.relationship_edges(cleaned, known_pages, sources),
    )


def supersede(current: dict[str, DataFrame], indexed: IndexedPages) -> dict[str, DataFrame]:
    """The stored tables after a run: all old rows of its pages are gone, the new ones in."""
    old_chunks = current["chunks"].join(indexed.page_ids, "page_id", "left_semi").select("chunk_id")
    chunk_ids = old_chunks.unionByName(indexed.chunks.select("chunk_id"))
    edges = indexed.edges.withColumnRenamed("src_page_id", "page_id")
    old_edges = current["edges"].withColumnRenamed("src_page_id", "page_id")
    return {
        "chunks": replace_rows(current["chunks"], indexed.chunks, indexed.page_ids, "page_id"),
        "sections": replace_rows(current["sections"], indexed.sections, indexed.page_ids, "page_id"),
        "markdown": replace_rows(current["markdown"], indexed.markdown, indexed.page_ids, "page_id"),
        "vectors": replace_rows(current["vectors"], indexed.vectors, chunk_ids, "chunk_id"),
        "ledger": replace_rows(current["ledger"], indexed.ledger, chunk_ids, "chunk_id"),
        "edges": replace_rows(old_edges, edges, indexed.page_ids, "page_id").withColumnRenamed("page_id", "src_page_id"),
    }
