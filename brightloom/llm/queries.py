"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.decontamination import find_leaks
from brightloom.llm.jaccard import similar_groups
from brightloom.llm.main_text import extract, fit_weights
from brightloom.llm.pii import find_personal_data, personal_digests
from brightloom.llm.periodic import periodic_runs, run_digests
from brightloom.llm.pieces import encode_pieces, piece_digests
from brightloom.llm.quality import compression_bands
from brightloom.llm.repeats import remove_repeats
from brightloom.llm.resampling import draw, weigh
from brightloom.llm.secrets import scan_secrets, secret_digests
from brightloom.llm.simhash import near_duplicates
from brightloom.llm.spelling import count_words, spelling_variants
from brightloom.llm.warc import build_index, keyed, look_up, read_records, write_archives
from brightloom.functions.shaping import let
from brightloom.session import ensure_settings

PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return ensure_settings(spark).read.parquet(f"{root}/{name}.parquet")


@query
def op1_compression_bands(spark: SparkSession, root: str) -> DataFrame:
    """Counts of every document and whether its compression lies within the bands."""
    return compression_bands(read(spark, root, "documents"))


@query
def op2_secrets(spark: SparkSession, root: str) -> DataFrame:
    """Secrets of every document, told apart by who holds them: a source is an owner, its texts in one language a repository."""
    docs = read(spark, root, "documents")
    return secret_digests(scan_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang")))


@query
def op3_simhash(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprint and group of near copies of every document."""
    found = near_duplicates(read(spark, root, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query
def op4_warc(spark: SparkSession, root: str) -> DataFrame:
    """Every page written to archives, found again by its URL's key in the index, and read back."""
    pages = read(spark, root, "pages")
    folder, captures = write_archives(pages)
    return read_records(folder, look_up(build_index(captures), keyed(pages)), payloads=False).drop("url", "payload")


@query
def op5_main_text(spark: SparkSession, root: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, root, "pages")
    return extract(pages, fit_weights(pages)).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op6_repeats(spark: SparkSession, root: str) -> DataFrame:
    """What is left of every document without its repeated 100-byte passages."""
    spans = F.col("spans")
    return remove_repeats(read(spark, root, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate(spans, F.lit(0).cast("bigint"), lambda total, x: total + x["end"] - x["start"]).alias("n_removed"),
        F.size(spans).cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op7_personal_data(spark: SparkSession, root: str) -> DataFrame:
    """Personal data of every document, and the words that give it away."""
    return personal_digests(find_personal_data(read(spark, root, "documents")))


@query
def op8_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Every document encoded with the 32k vocabulary and decoded again, as digests."""
    return piece_digests(encode_pieces(read(spark, root, "documents"), PIECES, decoded=True))


@query
def op9_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark items that documents hold, verbatim or edited."""
    return find_leaks(read(spark, root, "documents"), read(spark, root, "benchmark"))


@query
def op10_resampling(spark: SparkSession, root: str) -> DataFrame:
    """Importance of every document for the labelled good text, and whether it is sampled."""
    return weigh(draw(read(spark, root, "documents"), read(spark, root, "labels"), keep=["doc_id"]))


@query
def op11_jaccard(spark: SparkSession, root: str) -> DataFrame:
    """Number of different shingles and group of similar texts of every document."""
    return similar_groups(read(spark, root, "documents"))


def worn(ident: int | None, word: str) -> str:
    """The word, for one of 31 pairs of document and word without one of its code points."""
    if ident is None:
        return word
    code = zlib.crc32(f"{ident}:{word}".encode())
    if code % 31:
        return word
    gone = code % len(word)
    return word[:gone] + word[gone + 1 :]


@query
def op12_spelling(spark: SparkSession, root: str) -> DataFrame:
    """Every word of the documents, some of which are misspelt on purpose, with the form it is a variant of."""
    return spelling_variants(count_words(read(spark, root, "documents"), changed=worn))


def looped(text: Column, ident: Column) -> Column:
    """The text, for one of ten documents with all words from some place on as the first of them repeated."""
    code = F.crc32(ident.cast("string").cast("binary"))
    turn = F.floor(code / F.lit(10))

    def put(words: Column) -> Column:
        n = F.size(words)
        start = turn % n
        period = 1 + F.floor((n - start) / (3 + turn % 8))
        places = F.sequence(F.lit(0).cast("bigint"), n - F.lit(1).cast("bigint"))
        again = let(F.struct(start.alias("a"), period.alias("p")), lambda x: F.transform(places, lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))))
        return F.when(n > 0, F.array_join(again, " ")).otherwise(text)

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.when((code % 10 == 0) & text.isNotNull(), let(words, put)).otherwise(text)


@query
def op13_periodic(spark: SparkSession, root: str) -> DataFrame:
    """Periodic runs of every document, some of which are made to repeat themselves."""
    docs = read(spark, root, "documents")
    return run_digests(periodic_runs(docs.withColumn("text", looped(F.col("text"), F.col("doc_id")))))
