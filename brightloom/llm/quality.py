"""Quality rules: bands of zstandard ratios for whole texts and for fixed chunks.

Repetitive text compresses too well, random bytes hardly at all. Short texts compress badly
whatever they say, so each length has limits of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from brightloom.llm.batches import per_row

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, whole_ratio double, n_chunks bigint, n_bad_chunks bigint, verdict string, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size over size.

    whole: (least bytes, lowest ratio, highest ratio); the last band whose least size the text
    reaches applies, and a text below the first has none. chunk_bytes: size of the chunks;
    what is left at the end of a text is no chunk. chunk_low, chunk_high: limits of one chunk.
    bad_share: a text with a larger share of chunks out of their limits is rejected.
    """

    whole: tuple[tuple[int, float, float], ...] = field(
        default=((64, 0.40, 1.30), (128, 0.35, 1.05), (256, 0.30, 0.90), (512, 0.30, 0.85), (1024, 0.28, 0.75), (4096, 0.25, 0.70), (16384, 0.22, 0.65))
    )
    chunk_bytes: int = 2048
    chunk_low: float = 0.20
    chunk_high: float = 0.75
    bad_share: float = 0.25
    level: int = 3

    def limits(self, size: int) -> tuple[float, float] | None:
        found = [band for band in self.whole if band[0] <= size]
        return found[-1][1:] if found else None


def repeated_windows(words: list[bytes], length: int) -> int:
    """Words that stand in a window of `length` words found twice or more; exact, by ranks of doubled windows."""
    n = len(words)
    if n <= length:
        return 0
    number = {word: i for i, word in enumerate(dict.fromkeys(words))}
    if len(number) == n:
        return 0
    single = np.fromiter(map(number.__getitem__, words), np.int64, n)
    ranks, size, kinds = single, 1, len(number)
    while size < length:
        step = min(size, length - size)
        tail = ranks if step == size else single  # the tail is as long as what it is a rank of
        step = size if step == size else 1
        joined = ranks[: n - size - step + 1] * np.int64(kinds + 1) + tail[size : n - step + 1]
        ranks = np.unique(joined, return_inverse=True)[1]
        kinds, size = max(int(ranks.max()) + 1, len(number)), size + step
    twice = np.bincount(ranks)[ranks] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    data = text.encode()
    words = data.split()  # bytes split at the six ASCII blanks, and at nothing else
    seen: set[bytes] = set()
    doubled = 0
    for line in data.split(b"\n"):
        if line in seen:
            doubled += bool(line.split())
        else:
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        doubled,
        repeated_windows(words, 5),
    )


def ratios(data: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, int, int]:
    """Ratio of the whole text, number of chunks, number of chunks out of their limits."""
    if not data:
        return None, 0, 0
    size, bad = bands.chunk_bytes, 0
    for start in range(0, len(data) - size + 1, size):
        ratio = len(packer.compress(data[start : start + size])) / size
        bad += not bands.chunk_low <= ratio <= bands.chunk_high
    return len(packer.compress(data)) / len(data), len(data) // size, bad


def compression_bands(docs: DataFrame, bands: Bands = Bands(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and compression verdict of every whole text; one pass, no shuffle.

    verdict: `base` (fewer than 10 words, or over a fifth of them in repeated 5-word windows),
    `repetitive` or `incompressible` (the whole text is out of its band), `chunks` (too many
    chunks are), else `kept`. A null text has no words and fails; a null id stays null;
    repeated rows are judged one by one; other columns are not looked at; no rows give no rows.
    """

    def judge(ident, text):
        text = text or ""
        n_words, word_chars, n_symbols, n_dup, n_repeat = counts(text)
        failed = n_words < 10 or 100 * n_repeat > 20 * n_words
        data = text.encode()
        whole, chunks, bad = ratios(data, bands, zstandard.ZstdCompressor(level=bands.level))
        limits = bands.limits(len(data))
        if failed:
            verdict = "base"
        elif limits and whole < limits[0]:
            verdict = "repetitive"
        elif limits and whole > limits[1]:
            verdict = "incompressible"
        elif bad > bands.bad_share * chunks:
            verdict = "chunks"
        else:
            verdict = "kept"
        return ident, n_words, word_chars, n_symbols, n_dup, n_repeat, failed, whole, chunks, bad, verdict, verdict == "kept"

    return per_row(docs, [id_column, text_column], SCHEMA, judge)
