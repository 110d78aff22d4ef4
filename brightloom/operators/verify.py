"""Reconciliation of the stored tables, and corpus counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.operators.rules import pages_failing_validation
from brightloom.operators.text_index import TextIndex, index_differences


@dataclass(frozen=True)
class Store:
    """The tables of the document store."""

    sources: DataFrame
    pages: DataFrame
    sections: DataFrame
    chunks: DataFrame
    images: DataFrame
    chunk_images: DataFrame
    edges: DataFrame
    entities: DataFrame
    ledger: DataFrame
    rules: DataFrame
    rule_events: DataFrame
    text_index: TextIndex


def chunks_lacking_embedding(chunks: DataFrame, ledger: DataFrame, model: str) -> DataFrame:
    return chunks.select("chunk_id").join(ledger.filter(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")


def orphan_embeddings(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    return ledger.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def namespace_drift(chunks: DataFrame, pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows whose namespace is not the page type; a missing namespace counts as empty."""
    located = ledger.select("chunk_id", "namespace").join(chunks.select("chunk_id", "page_id"), "chunk_id")
    typed = located.join(pages.select("page_id", "page_type"), "page_id")
    return typed.filter(F.coalesce("namespace", F.lit("")) != F.col("page_type")).select("chunk_id")


def dangling_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    resolved = edges.filter(F.col("dst_page_id").isNotNull())
    return resolved.join(pages.select(F.col("page_id").alias("dst_page_id")), "dst_page_id", "left_anti").select("edge_id")


def dangling_chunk_images(chunk_images: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Links whose chunk or image is gone."""
    with_chunk = chunk_images.join(chunks.select("chunk_id", F.lit(True).alias("_chunk")), "chunk_id", "left")
    with_both = with_chunk.join(images.select("image_id", F.lit(True).alias("_image")), "image_id", "left")
    return with_both.filter(F.col("_chunk").isNull() | F.col("_image").isNull()).select("chunk_id", "image_id")


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def verify_report(store: Store, model: str) -> DataFrame:
    """One row: five drift counts, index consistency, failing pages and the verdict.

    Pages that failed validation are a matter of content and do not affect `ok`.
    """
    drift = {
        "chunks_lacking_embedding": chunks_lacking_embedding(store.chunks, store.ledger, model),
        "orphan_embeddings": orphan_embeddings(store.chunks, store.ledger),
        "namespace_drift": namespace_drift(store.chunks, store.pages, store.ledger),
        "dangling_edges": dangling_edges(store.edges, store.pages),
        "dangling_chunk_images": dangling_chunk_images(store.chunk_images, store.chunks, store.images),
    }
    spark = store.pages.sparkSession
    counted = spark.range(1).select(
        *[_row_count(df).alias(name) for name, df in drift.items()],
        (_row_count(index_differences(store.text_index, store.chunks)) == 0).alias("index_consistent"),
        _row_count(pages_failing_validation(store.rule_events)).alias("pages_with_validation_failures"),
    )
    ok = F.col("index_consistent")
    for name in drift:
        ok = ok & (F.col(name) == 0)
    return counted.withColumn("ok", ok)


def corpus_stats(store: Store) -> DataFrame:
    """One row with the number of rows of ten tables."""
    tables = {
        "sources": store.sources,
        "pages": store.pages,
        "sections": store.sections,
        "chunks": store.chunks,
        "images": store.images,
        "edges": store.edges,
        "entities": store.entities,
        "embeddings": store.ledger,
        "rules": store.rules,
        "rule_events": store.rule_events,
    }
    return store.pages.sparkSession.range(1).select(*[_row_count(df).alias(name) for name, df in tables.items()])


def pages_by_lifecycle(pages: DataFrame) -> DataFrame:
    return pages.groupBy("lifecycle").agg(F.count(F.lit(1)).alias("pages"))
