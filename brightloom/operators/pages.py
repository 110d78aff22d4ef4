"""Pages as rows: extraction, cleaning, chunking, markdown. One row per page, no shuffle.

The lists of a page (headings, blocks, links, images) stay arrays of its row until the last
step, so a whole crawl is extracted, cleaned and chunked where it was read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import scalars as S
from brightloom.functions.html import DropRules, scan_html
from brightloom.functions.packing import packed
from brightloom.functions.shaping import let, unrolled

# Fixed values.
PATH_SEPARATOR = " > "
LINK_DENSITY_LIMIT = 0.5
DENSITY_TAGS = ("li", "dd")
CHUNK_MAX_CHARS = 1200
CHUNK_OVERLAP_CHARS = 150

BLOCKS_TYPE = "array<struct<heading_path:string,text:string>>"
SECTIONS_TYPE = "array<struct<ord:int,level:int,heading:string,anchor:string,heading_path:string>>"


def extract_pages(pages: DataFrame, rules: DropRules = DropRules()) -> DataFrame:
    """Replace the `html` of pages by `html_title, sections, blocks, links, images`."""
    scanned = pages.withColumn("_scan", scan_html(F.col("html"), rules))
    with_sections = scanned.withColumn("sections", _with_paths(F.col("_scan.headings")))
    return (
        with_sections.withColumn("blocks", _content_blocks(F.col("_scan.blocks"), F.col("sections")))
        .withColumn("html_title", F.col("_scan.title"))
        .withColumn("links", F.col("_scan.links"))
        .withColumn("images", F.col("_scan.images"))
        .drop("_scan", "html")
    )


def _with_paths(headings: Column) -> Column:
    """Headings with their breadcrumb: each one closes those of its own level and deeper."""
    start = F.struct(
        F.array().cast("array<struct<level:int,heading:string>>").alias("trail"),
        F.array().cast(SECTIONS_TYPE).alias("done"),
    )

    def enter(state: Column, heading: Column) -> Column:
        above = F.filter(state["trail"], lambda t: t["level"] < heading["level"])
        trail = F.concat(above, F.array(F.struct(heading["level"].alias("level"), heading["heading"].alias("heading"))))
        path = F.array_join(F.transform(trail, lambda t: t["heading"]), PATH_SEPARATOR)
        section = F.struct(
            F.size(state["done"]).alias("ord"),
            heading["level"].alias("level"),
            heading["heading"].alias("heading"),
            heading["anchor"].alias("anchor"),
            path.alias("heading_path"),
        )
        return F.struct(trail.alias("trail"), F.concat(state["done"], F.array(section)).alias("done"))

    return F.aggregate(headings, start, enter, lambda state: state["done"])


def _content_blocks(blocks: Column, sections: Column) -> Column:
    """Blocks with text, without list items that are mostly link, under their heading path."""

    def is_content(block: Column) -> Column:
        dense = (
            block["tag"].isin(*DENSITY_TAGS)
            & (block["raw_chars"] > 0)
            & (block["link_chars"] / block["raw_chars"] > LINK_DENSITY_LIMIT)
        )
        return (block["text"] != "") & ~dense

    def placed(paths: Column) -> Column:
        def place(block: Column) -> Column:
            path = F.when(block["headings_before"] > 0, F.get(paths, block["headings_before"] - 1))
            return F.struct(path.alias("heading_path"), block["text"].alias("text"))

        return F.transform(F.filter(blocks, is_content), place)

    return let(F.transform(sections, lambda s: s["heading_path"]), placed)


def _path_has_marker(heading_path: Column, markers: Column) -> Column:
    segments = F.split(F.lower(heading_path), PATH_SEPARATOR)
    hit = F.exists(markers, lambda m: F.exists(segments, lambda s: F.contains(s, F.lower(m))))
    return F.coalesce(hit, F.lit(False))


def _before_first(items: Column, matches: Callable[[Column], Column]) -> Column:
    """Items up to, and without, the first match."""

    def cut(xs: Column) -> Column:
        first = F.array_min(F.filter(F.transform(xs, lambda x, i: F.when(matches(x), i)), lambda i: i.isNotNull()))
        return let(first, lambda at: F.when(at.isNotNull(), F.slice(xs, F.lit(1), at)).otherwise(xs))

    return let(items, cut)


def clean_pages(pages: DataFrame, source_rules: DataFrame) -> DataFrame:
    """Apply each source's cleaning to `sections` and `blocks`; other columns are untouched.

    `source_rules` holds per `source_id` the arrays `truncate_after` (heading markers that cut
    off the rest of the page), `drop_sections` (markers of sections left out) and
    `drop_blocks` (patterns of blocks left out), applied in that order.
    """
    none = F.array().cast("array<string>")
    joined = pages.join(source_rules.select("source_id", "truncate_after", "drop_sections", "drop_blocks"), "source_id", "left")
    cut, dropped, patterns = (F.coalesce(F.col(c), none) for c in ("truncate_after", "drop_sections", "drop_blocks"))

    blocks = _before_first(F.col("blocks"), lambda b: _path_has_marker(b["heading_path"], cut))
    sections = _before_first(
        F.col("sections"), lambda s: F.exists(cut, lambda m: F.contains(F.lower(s["heading"]), F.lower(m)))
    )
    blocks = F.filter(blocks, lambda b: ~_path_has_marker(b["heading_path"], dropped))
    sections = F.filter(sections, lambda s: ~_path_has_marker(s["heading_path"], dropped))
    blocks = F.filter(blocks, lambda b: ~F.exists(patterns, lambda p: F.rlike(b["text"], p)))
    return (
        joined.withColumn("blocks", blocks)
        .withColumn("sections", sections)
        .drop("truncate_after", "drop_sections", "drop_blocks")
    )


def check_chunk_options(max_chars: int, overlap_chars: int) -> None:
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    if not 0 <= overlap_chars < max_chars:
        raise ValueError("overlap_chars must be at least 0 and below max_chars")


def chunk_texts(blocks: Column, max_chars: int = CHUNK_MAX_CHARS, overlap_chars: int = CHUNK_OVERLAP_CHARS) -> Column:
    """Pack a page's blocks into chunks `array<struct<heading_path, text>>` in reading order.

    Neighbouring blocks under one heading path are packed together up to `max_chars`, and
    each chunk starts with the end of the one before it as far as that fits. Longer blocks
    are cut into overlapping pieces of their own. Nothing is carried over to another path.
    """
    check_chunk_options(max_chars, overlap_chars)
    return packed(blocks, max_chars, overlap_chars)


def chunk_pages(
    pages: DataFrame, max_chars: int = CHUNK_MAX_CHARS, overlap_chars: int = CHUNK_OVERLAP_CHARS
) -> DataFrame:
    """One row per chunk; its id is the page's id and its position in the page."""
    exploded = unrolled(pages, ["page_id"], chunk_texts(F.col("blocks"), max_chars, overlap_chars), "_chunk", "ord")
    text = F.col("_chunk.text")
    return exploded.select(
        F.concat_ws(":", F.col("page_id"), F.col("ord").cast("string")).alias("chunk_id"),
        "page_id",
        "ord",
        F.col("_chunk.heading_path").alias("heading_path"),
        text.alias("text"),
        S.text_hash(text).alias("content_hash"),
        S.token_estimate(text).alias("token_count"),
    )


def markdown(title: Column, blocks: Column) -> Column:
    """Cleaned text of a page: title, a heading wherever the path changes, blocks."""

    def with_headings(all_blocks: Column) -> Column:
        def with_heading(block: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(all_blocks, i - 1)["heading_path"])
            heads = block["heading_path"].isNotNull() & ~block["heading_path"].eqNullSafe(before)
            head = F.when(heads, F.concat(F.lit("## "), block["heading_path"]))
            return F.array_compact(F.array(head, block["text"]))

        return F.flatten(F.transform(all_blocks, with_heading))

    parts = let(blocks, with_headings)
    titled = F.when(title.isNotNull(), F.concat(F.array(F.concat(F.lit("# "), title)), parts)).otherwise(parts)
    return F.array_join(titled, "\n\n")


def page_markdown(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", markdown(F.col("html_title"), F.col("blocks")).alias("markdown"))


def page_sections(pages: DataFrame) -> DataFrame:
    """Heading rows; cleaning leaves gaps in `ord` rather than moving later headings up."""
    return unrolled(pages, ["page_id"], F.col("sections"), "_section").select(
        F.concat(F.col("page_id"), F.lit(":sec:"), F.col("_section.ord").cast("string")).alias("section_id"), "page_id", "_section.*"
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    return unrolled(pages, ["page_id"], F.col("blocks"), "_block", "ord").select("page_id", "ord", "_block.*")


def page_links(pages: DataFrame) -> DataFrame:
    return unrolled(pages, ["page_id", "source_id", "url"], F.col("links"), "_link", "ord").select(
        "page_id", "source_id", "url", "ord", "_link.href", F.col("_link.text").alias("link_text")
    )


def page_images(pages: DataFrame) -> DataFrame:
    return unrolled(pages, ["page_id"], F.col("images"), "_image", "ord").select("page_id", "ord", "_image.*")
