"""Packing a page's text blocks into chunks, as offsets into the joined text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from brightloom.functions.text import WHITESPACE_CHARS

GAP = "\n\n"

CHUNKS_TYPE = "array<struct<heading_path:string,text:string>>"
_ARROW_CHUNKS = pa.list_(pa.struct([("heading_path", pa.string()), ("text", pa.string())]))


def windows(lengths: list[int], max_chars: int, overlap_chars: int, narrow) -> Iterator[tuple[int, int]]:
    """Bounds of the chunks of blocks that are joined by gaps.

    A block that does not fit into a chunk is cut by itself into windows `max_chars` wide that
    overlap. Otherwise a chunk takes all blocks that end within `max_chars` of its start, found
    by binary search in the running sum of lengths. It starts at most `overlap_chars` before its
    first block, within the chunk before it and where its first block still fits. `narrow` takes
    the bounds of a stretch to those of its text without outer white space.
    """
    stops = list(accumulate(lengths, lambda stop, length: stop + len(GAP) + length))
    step = max(1, max_chars - overlap_chars)
    block, earliest = 0, None
    while block < len(stops):
        first = stops[block] - lengths[block]
        if lengths[block] > max_chars:
            cuts = range(first, stops[block] - max_chars + step, step)
            found = [narrow(cut, min(cut + max_chars, stops[block])) for cut in cuts]
            block += 1
        else:
            begin, fits_from = first, stops[block] - max_chars
            if earliest is not None and fits_from + len(GAP) <= first and fits_from < first - len(GAP):
                begin = max(earliest, fits_from)
            block = bisect_right(stops, begin + max_chars)
            found = [narrow(begin, stops[block - 1])]
        for begin, end in found:
            if begin < end:
                yield begin, end
                earliest = max(begin, end - overlap_chars) if overlap_chars else None


def pack(blocks: list[tuple[str | None, str | None]], max_chars: int, overlap_chars: int) -> list[dict]:
    """Chunks of `(heading_path, text)` blocks in order; white space around a text does not count."""
    trimmed = ((path, text.strip(WHITESPACE_CHARS)) for path, text in blocks if text is not None)
    chunks = []
    for path, members in groupby((block for block in trimmed if block[1]), key=lambda block: block[0]):
        texts = [text for _, text in members]
        joined = GAP.join(texts)

        def narrow(begin: int, end: int, joined: str = joined) -> tuple[int, int]:
            bare = joined[begin:end].lstrip(WHITESPACE_CHARS)
            begin = end - len(bare)
            return begin, begin + len(bare.rstrip(WHITESPACE_CHARS))

        bounds = windows([len(text) for text in texts], max_chars, overlap_chars, narrow)
        chunks += ({"heading_path": path, "text": joined[begin:end]} for begin, end in bounds)
    return chunks


def packed(blocks: Column, max_chars: int, overlap_chars: int) -> Column:
    """Chunks of each row's array of blocks; NULL for NULL. Linear in the length of the texts."""

    def pack_rows(rows: pa.Array) -> pa.Array:
        members = rows.values
        paths, texts = members.field("heading_path").to_pylist(), members.field("text").to_pylist()
        bounds, given = rows.offsets.to_pylist(), rows.is_valid().to_pylist()
        chunks = [
            pack(list(zip(paths[begin:end], texts[begin:end])), max_chars, overlap_chars) if known else None
            for begin, end, known in zip(bounds, bounds[1:], given)
        ]
        return pa.array(chunks, type=_ARROW_CHUNKS)

    pack_rows.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(pack_rows, CHUNKS_TYPE)(blocks)
