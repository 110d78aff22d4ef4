"""The inverted index as tables, and keyword search over it with BM25."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.functions import text as X
from brightloom.functions.shaping import unrolled
from brightloom.session import cut_lineage

# BM25 parameters and the weight of a term that most chunks contain.
BM25_K1 = 1.2
BM25_B = 0.75
MIN_IDF = 1e-6


@dataclass(frozen=True)
class TextIndex:
    """`postings(term, chunk_id, tf)` and `lengths(chunk_id, terms)`; `counted`, if there, is the table of
    `count_words` both come from, in which the words of some chunks are found without those of the rest.
    """

    postings: DataFrame
    lengths: DataFrame
    counted: DataFrame | None = None


def count_words(chunks: DataFrame) -> DataFrame:
    """(chunk_id, terms, words): each chunk's text and heading path as one bag of words, in one row.

    Written once, this table serves as both tables of an index; `terms` is read without the words.
    """
    return chunks.select("chunk_id", _bag(X.spaced_words(_indexed_text())).alias("_bag")).select("chunk_id", "_bag.terms", "_bag.words")


def _postings(counted: DataFrame) -> DataFrame:
    rows = unrolled(counted, ["chunk_id"], F.col("words"), "_posting")
    return rows.select("_posting.term", "chunk_id", "_posting.tf")


def index_of(counted: DataFrame) -> TextIndex:
    """The index over `count_words`, or over its written table."""
    return TextIndex(_postings(counted), counted.select("chunk_id", "terms"), counted)


def build_index(chunks: DataFrame) -> TextIndex:
    """Index the text and the heading path of chunks as one bag of words."""
    return index_of(count_words(chunks))


def _indexed_text() -> Column:
    return F.concat_ws(" ", F.col("text"), F.col("heading_path"))


BAG_TYPE = "struct<terms:int,words:array<struct<term:string,tf:bigint>>>"
_ASCII_WORDS = re.compile("[a-z0-9]+")


def _bag(spaced: Column) -> Column:
    """Number of words of each text of `spaced_words`, and its distinct words with their counts, in order of appearance.

    All words of a chunk are in one row, so they are counted there: nothing has to be shuffled for it.
    """

    def count(texts: pa.Array) -> pa.Array:
        terms, tf, sizes, stops = [], [], [], [0]
        for text in texts.to_pylist():
            found = _ASCII_WORDS.findall(text) if text.isascii() else text.split()
            counts = Counter(found)
            terms += counts.keys()
            tf += counts.values()
            sizes.append(len(found))
            stops.append(len(terms))
        words = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.int64())], ["term", "tf"])
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), words)], ["terms", "words"]
        )

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, BAG_TYPE)(spaced)


def write_index(index: TextIndex, folder: str) -> None:
    """Write the index so that a search for some words reads only the files that hold them.

    Ranges of (term, chunk) also split a word found in a third of all chunks over many files.
    """
    ranged = index.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")
    ranged.write.mode("overwrite").parquet(f"{folder}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")


def read_index(spark: SparkSession, folder: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"))


def replace_in_index(index: TextIndex, changed_pages: DataFrame, new_chunks: DataFrame) -> TextIndex:
    """The index after all chunks of some pages were replaced by `new_chunks`."""
    fresh = build_index(new_chunks)

    def kept(table: DataFrame) -> DataFrame:
        page = F.regexp_replace("chunk_id", ":[0-9]+$", "")
        return table.withColumn("page_id", page).join(changed_pages.select("page_id"), "page_id", "left_anti").drop("page_id")

    return TextIndex(
        kept(index.postings).unionByName(fresh.postings), kept(index.lengths).unionByName(fresh.lengths)
    )


def index_differences(index: TextIndex, chunks: DataFrame) -> DataFrame:
    """Postings that the index and a fresh build of it disagree on; none when consistent.

    Words of the chunks and stored postings meet in one aggregate by posting: nothing is sorted,
    and words are counted on both sides of its shuffle. A posting stored more than once is one
    row with the sum of its counts, and never agrees.
    """
    tf = F.col("tf").cast("long")
    stored = index.postings.select("term", "chunk_id", F.lit(1).alias("_stored"), tf.alias("tf"), F.lit(None).cast("long").alias("expected_tf"))
    words = unrolled(chunks, ["chunk_id"], X.index_tokens(_indexed_text()), "term")
    fresh = words.select("term", "chunk_id", F.lit(None).cast("int").alias("_stored"), F.lit(None).cast("long").alias("tf"), F.lit(1).cast("long").alias("expected_tf"))
    both = stored.unionByName(fresh).groupBy("term", "chunk_id").agg(
        F.count("_stored").alias("_stored"), F.sum("tf").alias("tf"), F.sum("expected_tf").alias("expected_tf")
    )
    return both.filter((F.col("_stored") > 1) | ~F.col("tf").eqNullSafe(F.col("expected_tf"))).drop("_stored")


def keyword_hits(
    queries: DataFrame, index: TextIndex, k: int, strict_ascii: bool = False, admitted: DataFrame | None = None
) -> DataFrame:
    """The `k` best chunks holding *all* terms of a query, by BM25, lower is better.

    The rarest term of a query names its candidates, so a term found in a third of all
    chunks is looked up in the candidates' words and never listed in full unless every term of the
    query is that common. A query without terms finds nothing.
    Only chunks of `admitted(chunk_id)`, if given, are candidates; scores are those of the whole index.
    """
    terms = (
        unrolled(queries, ["query_id"], X.query_tokens(F.col("text"), strict_ascii), "term")
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("repeats"))
    )
    # Only postings of words somebody asked for are counted.
    asked = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    frequency = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # Terms and candidates are written, so that their size is known: unless they are many, they are sent to
    # the postings, and no posting is shuffled.
    weighed = cut_lineage(terms.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))))
    rarest = weighed.groupBy("query_id").agg(
        F.min_by("term", F.struct("df", "term")).alias("term"), F.min("df").alias("_least"), F.count(F.lit(1)).alias("n_terms")
    )
    n_chunks = index.lengths.agg(F.count(F.lit(1))).scalar()
    mean_terms = index.lengths.agg(F.avg("terms")).scalar()

    named = rarest.filter(F.col("_least") > 0).join(index.postings, "term").select("query_id", "chunk_id", "n_terms")
    if admitted is not None:
        named = named.join(admitted, "chunk_id", "left_semi")
    candidates = cut_lineage(named)
    looked_up = candidates.select("chunk_id").distinct()
    if index.counted is None:
        postings = index.postings.join(looked_up, "chunk_id", "left_semi")
    else:
        postings = _postings(index.counted.join(looked_up, "chunk_id", "left_semi"))
    wanted = candidates.join(index.lengths, "chunk_id").join(postings, "chunk_id")
    found = wanted.join(weighed.select("query_id", "term", "repeats", "df"), ["query_id", "term"])
    idf = F.ln((n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(MIN_IDF)).otherwise(idf)
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("terms") / mean_terms)
    weight = F.col("repeats") * idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)
    scored = (
        found.groupBy("query_id", "chunk_id", "n_terms")
        .agg(F.count(F.lit(1)).alias("_found"), (-F.sum(weight)).alias("score"))
        .filter(F.col("_found") == F.col("n_terms"))
    )
    # Equal scores must not be told apart by the order in which terms were summed.
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9), "chunk_id")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "chunk_id", "score", "rank")
    )
