"""Vectors for texts: a pluggable model, a deterministic default, and vector rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EMBEDDING_DIMS = 768
EMBEDDING_BATCH = 100
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193
STREAM_STEP, MIX_ONE, MIX_TWO = 0x9E3779B9, 0x21F0AAAD, 0x735A2D97

# UTF-16 units of each text that are hashed side by side.
STRETCH = 4096

Embedder = Callable[[Sequence[str]], np.ndarray]


def text_seeds(texts: Sequence[str]) -> np.ndarray:
    """32-bit FNV-1a over the UTF-16 units of each text, all texts of the batch side by side, a stretch at a time."""
    units = [np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2") for text in texts]
    lengths = np.array([len(u) for u in units])
    longest_first = np.argsort(-lengths, kind="stable")
    ordered = [units[row] for row in longest_first]
    falling = -lengths[longest_first]
    state = np.full(len(units), FNV_OFFSET, dtype=np.uint32)
    prime = np.uint32(FNV_PRIME)
    for start in range(0, int(lengths.max(initial=0)), STRETCH):
        count = int(np.searchsorted(falling, -start, side="left"))  # texts longer than `start`
        table = np.zeros((min(STRETCH, -int(falling[0]) - start), count), dtype=np.uint32)
        for column, row in enumerate(ordered[:count]):
            part = row[start : start + STRETCH]
            table[: len(part), column] = part
        still_open = np.searchsorted(falling, -np.arange(start, start + len(table)), side="left")
        for at in np.split(np.arange(len(table)), np.flatnonzero(np.diff(still_open)) + 1):
            # As many texts are open all along this part of the stretch.
            some = state[: still_open[at[0]]]
            for units_here in table[at[0] : at[-1] + 1, : len(some)]:
                np.bitwise_xor(some, units_here, out=some)
                np.multiply(some, prime, out=some)
    seeds = np.empty_like(state)
    seeds[longest_first] = state
    return seeds


def hash_embedder(texts: Sequence[str], dims: int = EMBEDDING_DIMS) -> np.ndarray:
    """Unit vectors drawn from a stream seeded by each text: same text, same vector."""
    steps = (np.arange(1, dims + 1, dtype=np.uint64) * STREAM_STEP).astype(np.uint32)
    z = text_seeds(texts)[:, None] + steps[None, :]
    z = (z ^ (z >> np.uint32(16))) * np.uint32(MIX_ONE)
    z = (z ^ (z >> np.uint32(15))) * np.uint32(MIX_TWO)
    z = z ^ (z >> np.uint32(15))
    raw = z.astype(np.float64) / 0xFFFFFFFF * 2.0 - 1.0
    norms = np.linalg.norm(raw, axis=1, keepdims=True)
    return raw / np.where(norms == 0, 1.0, norms)


def embedding(text: Column, embedder: Embedder = hash_embedder, dims: int = EMBEDDING_DIMS, batch: int = EMBEDDING_BATCH) -> Column:
    """One vector per text as `array<float>`; a model that returns another shape fails the job."""

    def embed(texts: pa.Array) -> pa.Array:
        values = ["" if t is None else t for t in texts.to_pylist()]
        blocks = []
        for start in range(0, len(values), batch):
            part = values[start : start + batch]
            vectors = np.asarray(embedder(part))
            if vectors.shape != (len(part), dims):
                raise ValueError(f"embedder returned shape {vectors.shape} for {len(part)} texts of {dims} dimensions")
            blocks.append(vectors.astype(np.float32))
        flat = np.concatenate(blocks).ravel() if blocks else np.zeros(0, dtype=np.float32)
        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * dims)
        return pa.ListArray.from_arrays(offsets, pa.array(flat, type=pa.float32()))

    embed.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(embed, "array<float>")(text)


def embed_text(heading_path: Column, text: Column) -> Column:
    """What is embedded for a chunk: its heading path, when it has one, above its text."""
    return F.concat_ws("\n", heading_path, text)


def vector_rows(
    chunks: DataFrame, pages: DataFrame, sources: DataFrame, embedder: Embedder = hash_embedder, dims: int = EMBEDDING_DIMS
) -> DataFrame:
    """Vector rows with the metadata searches filter on; the namespace is the page type."""
    described = pages.join(sources.select("source_id", "tier"), "source_id").select(
        "page_id", "url", "source_id", F.col("tier").alias("source_tier"), "page_type", "lifecycle", "language", "crawled_at"
    )
    return chunks.join(described, "page_id").select(
        F.col("chunk_id").alias("vector_id"),
        embedding(embed_text(F.col("heading_path"), F.col("text")), embedder, dims).alias("embedding"),
        F.col("page_type").alias("namespace"),
        "page_id",
        "chunk_id",
        "url",
        "source_id",
        "source_tier",
        "page_type",
        "lifecycle",
        "language",
        "crawled_at",
        "heading_path",
    )


def embedding_ledger(vectors: DataFrame, model: str, indexed_at: Column) -> DataFrame:
    """Which chunk has which vector under which model."""
    return vectors.select(
        "chunk_id", F.lit(model).alias("model"), "vector_id", "namespace", indexed_at.alias("indexed_at")
    )


def write_vectors(vectors: DataFrame, folder: str) -> None:
    """One folder per namespace, so a search in one namespace reads only that."""
    vectors.write.mode("overwrite").partitionBy("namespace").parquet(folder)
