"""Page, image and source input: contracts, the crawl frontier and joined scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import scalars as S
from brightloom.functions.text import strip_suffix
from brightloom.functions.urls import is_admissible, is_url

# What input may hold.
MAX_HTML_CHARS = 4_000_000
MAX_TITLE_CHARS = 500
MAX_TIER = 1000
IMAGE_CONTENT_TYPES = ("image/png", "image/jpeg", "image/webp", "image/gif")
MAX_IMAGE_CHARS = 20_000_000
MAX_ALT_CHARS = 2000


def check_rows(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add `violations`, the names of the checks a row does not meet; NULL does not meet one."""
    faults = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*faults)))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and the quarantine with its reasons."""
    clean = F.size("violations") == 0
    return checked.filter(clean).drop("violations"), checked.filter(~clean)


def _optional(column: str, ok: Column) -> Column:
    return F.col(column).isNull() | ok


def check_page_requests(requests: DataFrame, page_types: list[str]) -> DataFrame:
    return check_rows(
        requests,
        {
            "source_id": F.length("source_id") >= 1,
            "url": is_url(F.col("url")),
            "html": F.length("html").between(1, MAX_HTML_CHARS),
            "title": _optional("title", F.length("title") <= MAX_TITLE_CHARS),
            "page_type": _optional("page_type", F.col("page_type").isin(page_types)),
            "language": _optional("language", F.length("language").between(2, 10)),
        },
    )


def check_image_requests(requests: DataFrame) -> DataFrame:
    """Image input with the hash of the decoded bytes; text that is not base64 is a violation."""
    checked = check_rows(
        requests,
        {
            "page_id": F.length("page_id") >= 1,
            "url": is_url(F.col("url")),
            "content_type": F.col("content_type").isin(*IMAGE_CONTENT_TYPES),
            "data_base64": F.length("data_base64").between(1, MAX_IMAGE_CHARS) & S.decode_base64(F.col("data_base64")).isNotNull(),
            "alt_text": _optional("alt_text", F.length("alt_text") <= MAX_ALT_CHARS),
            "width": _optional("width", F.col("width") > 0),
            "height": _optional("height", F.col("height") > 0),
        },
    )
    return checked.withColumn("content_hash", S.bytes_hash(F.col("data_base64")))


def check_source_requests(requests: DataFrame) -> DataFrame:
    return check_rows(
        requests,
        {
            "source_id": F.length("source_id").between(1, 64),
            "name": F.length("name").between(1, 200),
            "base_url": is_url(F.col("base_url")),
            "tier": F.col("tier").between(1, MAX_TIER),
            "license": _optional("license", F.length("license") <= 200),
        },
    )


def crawl_frontier(
    urls: DataFrame, catalogue: DataFrame, excluded_prefixes: list[str], limit: int | None = None, verdicts: DataFrame | None = None
) -> DataFrame:
    """Sitemap URLs a crawl may fetch, with their source; `limit` caps one crawl.

    `verdicts` holds `(url, allowed)` answers of the sites' own crawling rules.
    """
    excluded = F.array(*[F.lit(p) for p in excluded_prefixes]).cast("array<string>")
    matched = urls.join(catalogue.select("source_id", "base_url", "path_prefixes"), "source_id").filter(
        is_admissible(F.col("url"), F.col("base_url"), F.col("path_prefixes"), excluded)
    )
    if verdicts is not None:
        refused = verdicts.filter(~F.col("allowed")).select("url")
        matched = matched.join(refused, "url", "left_anti")
    found = matched.select("source_id", "url").distinct()
    return found if limit is None else found.orderBy("url").limit(limit)


def source_registrations(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("source_id", "name", "base_url", "tier", "license")


def page_requests(crawled: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Crawled `(source_id, url, html, title)` as ingest requests.

    Titles lose their source's suffix and count only when something is left of them. A
    suffix pattern is a value of the source's catalogue row and comes with its page type, so the
    catalogue may hold any number of them. Pages of unknown sources are left out.
    """
    entries = catalogue.select("source_id", F.col("default_page_type").alias("page_type"), F.col("title_suffix").alias("_suffix"))
    title = F.nullif(strip_suffix(F.col("title"), F.col("_suffix")), F.lit(""))
    return crawled.join(entries, "source_id").withColumn("title", title).drop("_suffix")


def indexable_pages(pages: DataFrame, raw: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages ready to be indexed with HTML and tier, and the others with the reason.

    Reasons: `page_not_stored` without a stored key, `source_missing`, `raw_missing`.
    """
    joined = (
        pages.join(sources.select("source_id", F.col("tier").alias("source_tier")), "source_id", "left")
        .join(raw.select("page_id", "html"), "page_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("raw_key").isNull(), "page_not_stored")
            .when(F.col("source_tier").isNull(), "source_missing")
            .when(F.col("html").isNull(), "raw_missing"),
        )
    )
    return joined.filter(F.col("reason").isNull()).drop("reason"), joined.filter(F.col("reason").isNotNull()).select(
        "page_id", "reason"
    )
