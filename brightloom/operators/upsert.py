"""Writes as snapshots: the current table and a batch of changes give the next table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(changes: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of several changes to a key the last one."""
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_newest"))
    return newest.select(*keys, "_newest.*")


def keyed_upsert(current: DataFrame, changes: DataFrame, keys: list[str], refreshed: list[str]) -> DataFrame:
    """Insert new keys and refresh the named columns of known ones; the rest keeps its value.

    `changes` has one row per key, with the columns of `current`.
    """
    known = F.col("_is_current")
    left = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_old"), F.lit(True).alias("_is_current"))
    right = changes.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_new"), F.lit(True).alias("_is_change"))
    both = left.join(right, keys, "full")
    columns = []
    for name in current.columns:
        if name in keys:
            columns.append(F.col(name))
            continue
        old, new = F.col(f"_old.{name}"), F.col(f"_new.{name}")
        if name in refreshed:
            columns.append(F.when(F.col("_is_change"), new).otherwise(old).alias(name))
        else:
            columns.append(F.when(known, old).otherwise(new).alias(name))
    return both.select(*columns)


# What a new crawl of a page refreshes; id, crawl time and lifecycle stay as first written.
PAGE_REFRESHED = ["canonical_url", "title", "page_type", "summary", "language", "tags", "content_hash", "raw_key", "updated_at"]


def upsert_pages(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Pages after a crawl: by (source, URL), counting versions, unchanged bytes untouched."""
    keys = ["source_id", "url"]
    offered = [c for c in current.columns if c in changes.columns and c not in keys]
    left = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_old"), F.lit(True).alias("_known"))
    right = changes.select(*keys, F.struct(*offered).alias("_new"), F.lit(True).alias("_crawled"))
    both = left.join(right, keys, "full")
    is_new = F.col("_known").isNull()
    differs = F.col("_crawled").isNotNull() & ~F.col("_old.content_hash").eqNullSafe(F.col("_new.content_hash"))

    def after(name: str) -> Column:
        if name in keys:
            return F.col(name)
        old = F.col(f"_old.{name}")
        if name == "version":
            return F.when(is_new, F.lit(1)).when(differs, old + 1).otherwise(old)
        if name == "lifecycle":
            return F.when(is_new, F.lit("active")).otherwise(old)
        new = F.col(f"_new.{name}") if name in offered else F.lit(None)
        return F.when(is_new | differs if name in PAGE_REFRESHED else is_new, new).otherwise(old)

    return both.select(*[after(name).alias(name) for name in current.columns])


def upsert_sources(current: DataFrame, changes: DataFrame) -> DataFrame:
    return keyed_upsert(current, changes, ["source_id"], ["name", "base_url", "tier", "license"])


def upsert_entities(current: DataFrame, changes: DataFrame) -> DataFrame:
    return keyed_upsert(current, changes, ["normalized", "kind"], ["name", "canonical_page_id"])


def upsert_embedding_ledger(current: DataFrame, changes: DataFrame) -> DataFrame:
    return keyed_upsert(current, changes, ["chunk_id", "model"], ["vector_id", "namespace", "indexed_at"])


def upsert_images(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Images by (page, URL); unchanged bytes are left alone and a known size is kept."""
    keys = ["page_id", "url"]
    stored = current.select(*keys, F.col("content_hash").alias("_stored_hash"))
    changed = (
        changes.join(stored, keys, "left")
        .filter(~F.col("content_hash").eqNullSafe(F.col("_stored_hash")))
        .drop("_stored_hash")
    )
    return keyed_upsert(current, changed, keys, ["content_hash", "content_type", "alt_text"])


def link_chunk_images(current: DataFrame, new: DataFrame) -> DataFrame:
    """Chunk-image links with new ones added; known ones are ignored."""
    return current.unionByName(new.select(*current.columns)).dropDuplicates(["chunk_id", "image_id"])


def replace_rows(current: DataFrame, new: DataFrame, changed_ids: DataFrame, key: str) -> DataFrame:
    """Drop every current row of the changed owners, then add their new rows."""
    kept = current.join(changed_ids.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def delete_rows(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti")


def write_replacing(df: DataFrame, folder: str, partition: str) -> None:
    """Write a snapshot, replacing only the partitions that `df` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)


def raw_key(page_id: Column) -> Column:
    return F.concat(F.lit("pages/"), page_id, F.lit("/raw.html"))


def markdown_key(page_id: Column) -> Column:
    return F.concat(F.lit("pages/"), page_id, F.lit("/clean.md"))


def page_rows(decided: DataFrame, as_of: datetime) -> DataFrame:
    """Rows to upsert for the pages an ingest decided to store."""
    now = F.lit(as_of).cast("timestamp")
    return decided.filter(F.col("verdict") == "stored").select(
        "page_id", "source_id", "url", "canonical_url", "title", "page_type", "summary", "language", "tags",
        "content_hash", raw_key(F.col("page_id")).alias("raw_key"), now.alias("crawled_at"), now.alias("updated_at"),
    )
