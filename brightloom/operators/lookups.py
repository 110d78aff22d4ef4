"""Bulk lookups, ordered listings and keyset pages over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import scalars as S


def by_key(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a table for a set of point or natural keys."""
    return table.join(wanted.select(*keys).distinct(), keys, "left_semi")


def in_caller_order(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows for `(key, pos)` in the caller's order; unknown keys are left out."""
    return table.join(wanted.select(key, "pos"), key).orderBy("pos")


def page_listing(table: DataFrame, page_ids: DataFrame, *order: str) -> DataFrame:
    """Rows of some pages (sections, chunks, images, rule events) in a given order."""
    return table.join(page_ids.select("page_id").distinct(), "page_id", "left_semi").orderBy("page_id", *order)


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("tier", "source_id")


def list_entities(entities: DataFrame) -> DataFrame:
    return entities.orderBy("kind", "normalized")


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy("phase", "priority", "rule_id")


def list_pages(pages: DataFrame) -> DataFrame:
    return pages.orderBy("page_id")


def keyset_page(pages: DataFrame, limit: int, after: str | None = None) -> DataFrame:
    """The next `limit` pages of every source by id, with the cursor of a full page."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    ahead = pages if after is None else pages.filter(F.col("page_id") > after)
    order = Window.partitionBy("source_id").orderBy("page_id")
    page = ahead.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    last = page.filter(F.col("position") == limit).select("source_id", F.col("page_id").alias("next_cursor"))
    return page.join(last, "source_id", "left")


def page_items(pages: DataFrame) -> DataFrame:
    """What a page list shows."""
    return pages.select("page_id", "url", "title", "page_type", "language", "lifecycle", "version", "updated_at")


def source_items(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", "name", "base_url", "tier", "license")


def page_details(pages: DataFrame, raw: DataFrame, markdown: DataFrame) -> DataFrame:
    """Pages with their stored HTML and markdown, where there is any, and their tags as a list."""
    return (
        pages.join(raw.select("page_id", "html"), "page_id", "left")
        .join(markdown.select("page_id", "markdown"), "page_id", "left")
        .withColumn("tags", S.parse_tags(F.col("tags")))
    )


def chunk_items(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Chunks with a flag telling whether any model has embedded them."""
    embedded = ledger.select("chunk_id").distinct().withColumn("has_embedding", F.lit(True))
    return chunks.join(embedded, "chunk_id", "left").withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False)))


def vector_ids_of_pages(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "page_id").join(ledger.select("chunk_id", "model", "vector_id"), "chunk_id").select(
        "page_id", "model", "vector_id"
    )


def images_of_chunks(chunk_images: DataFrame, images: DataFrame) -> DataFrame:
    return chunk_images.join(images, "image_id").orderBy("chunk_id", "url")
