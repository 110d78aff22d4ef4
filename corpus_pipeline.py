"""The corpus pipeline: quality, near copies, leaked benchmarks, personal data, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.batches import stored
from brightloom.llm.decontamination import without_leaks
from brightloom.llm.pieces import encode_pieces
from brightloom.llm.pii import sanitise
from brightloom.llm.resampling import draw, sampled
from brightloom.llm.simhash import one_of_each
from brightloom.session import ensure_settings


def good_texts(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Texts that importance resampling draws for the labelled good ones."""
    return sampled(draw(docs, spark.read.parquet(f"{root}/labels.parquet")))


def without_copies(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Documents that hold no item of the benchmark, verbatim or edited."""
    return without_leaks(docs, spark.read.parquet(f"{root}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    return sanitise(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """The ids of every text, with their number; `n_decoded` counts the code points of the text they decode to."""
    coded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.length("decoded").cast("bigint").alias("n_decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_texts),
    ("SimHash near-dedup", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("SentencePiece encoding and decoding", as_pieces),
]

# Learnt weights, fingerprints and encodings are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, root: str) -> DataFrame:
    """All stages over the documents, each over the written table of the one before."""
    docs = ensure_settings(spark).read.parquet(f"{root}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, root))
    return STAGES[-1][1](spark, docs, root)
