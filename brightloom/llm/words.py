"""Words of many texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts looked at together hold about so many bytes; a longer text stands alone.
GROUP_BYTES = 4 << 20


def grouped(texts: list[bytes | None], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `limit` bytes each."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text or b"") > limit:
            yield first, at
            first, size = at, 0
        size += len(text or b"")
    if first < len(texts):
        yield first, len(texts)


def split_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, one after the other, and where each text's words start (and the last end).

    Bytes are split at the six white space characters of ASCII and at nothing else.
    """
    words = [(text or b"").split() for text in texts]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=starts[1:])
    return list(chain.from_iterable(words)), starts


def coded(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, and the different words by number."""
    found = pa.array(words, pa.large_binary()).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def id_and_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(_id, _text) with the text as bytes; no other column, whatever its name, goes along."""
    return docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").cast("binary").alias("_text"))
