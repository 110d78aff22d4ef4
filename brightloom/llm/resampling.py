"""Quality by importance resampling: how much likelier is a text under a target than under the corpus?

Two generative models of hashed n-grams are counted, one from labelled good texts, one from
all texts; a third, from labelled toxic texts, takes out toxic ones. A text's weight is the ratio of its probabilities; sampling without replacement in
proportion to weights is done by adding Gumbel noise and taking the largest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brightloom.llm.batches import stored


@dataclass(frozen=True)
class Resampling:
    """buckets: hash buckets of n-grams, a power of two, half of them for pairs of words; the models are
    as large as this, whatever the corpus.

    labelled: labelled rows used at most, those with the smallest hashed ids. z, support: the
    logarithm of an n-gram's ratio is shrunken by half if its share differs by so many standard
    deviations, and again if so many different labelled texts of the kind it speaks for have it;
    others hardly count, and would let a long text outweigh what is wrong with it. temperature: of
    the sampling; weights are divided by it. strongest: n-grams of a text that its toxic weight
    sums. clean: what it costs to lose a clean labelled text, against keeping a toxic one.
    """

    buckets: int = 1 << 19
    labelled: int = 20_000
    z: float = 5.0
    support: float = 4.0
    temperature: float = 0.2
    strongest: int = 4
    clean: float = 5.0


RUN = re.compile(r"(.)\1+", re.S)
WORD_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def shape_of(word: str) -> str:
    """The kinds of characters of a word, each run once: `Word,` is `Xx,`, `ABC!!` is `X!`."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return RUN.sub(r"\1", kinds)


class Grams:
    """Hash buckets of the n-grams of texts: words, shapes of words, pairs of neighbouring shapes; pairs of neighbouring words in a half of their own."""

    def __init__(self, buckets: int, remembered: int = 300_000):
        self.half = buckets // 2
        self.shift = np.uint64(64 - self.half.bit_length() + 1)
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _word(self, word: str) -> bytes:
        if len(self.known) >= self.remembered:
            self.known.clear()
        plain = xxhash.xxh64_digest("w" + word.lower().strip(WORD_EDGES), 1)
        self.known[word] = found = plain + xxhash.xxh64_digest("s" + shape_of(word), 1)
        return found

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        packed = b"".join([known.get(w) or self._word(w) for w in words])
        word, shape = np.frombuffer(packed, ">u8").astype(np.uint64).reshape(-1, 2).T
        pair = (shape[:-1] * np.uint64(3) + shape[1:]) * np.uint64(0x9E3779B97F4A7C15) + (word[:-1] == word[1:]).astype(np.uint64)
        pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        both = (word[:-1] * np.uint64(3) + word[1:]) * np.uint64(0x9E3779B97F4A7C15)
        both = (both ^ (both >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        found = (np.concatenate([word, shape, pair, both]) >> self.shift).astype(np.int64)
        found[len(found) - len(both) :] += self.half
        return found


# What is known of a labelled text: its quality and toxicity, -1 if that is not labelled.
Sample = dict[int, tuple[int, int]]


def is_good(known: tuple[int, int]) -> bool:
    """Of quality and not toxic."""
    return known[0] == 1 and known[1] != 1


def labelled_rows(docs: DataFrame, labels: DataFrame, rule: Resampling, id_column: str, text_column: str) -> Sample:
    """doc_id -> quality and toxicity, for a bounded number of labelled rows, one for each text."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.coalesce("quality", "toxic").isNotNull())
    marks = [F.coalesce(F.col(c), F.lit(-1)).cast("int").alias(c) for c in ("quality", "toxic")]
    rows = known.select(F.col("doc_id").cast("bigint"), *marks).orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(rule.labelled).toArrow()
    if not rows.num_rows:
        return {}
    sample = F.broadcast(docs.sparkSession.createDataFrame(rows))  # at most rule.labelled rows
    hashed = F.md5(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("text")
    texts = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), hashed).join(sample, "doc_id")
    first = texts.groupBy("text").agg(F.min(F.struct("doc_id", "quality", "toxic")).alias("first")).select("first.*").toArrow().to_pydict()
    found: Sample = {}
    for ident, quality, toxic in sorted(zip(first["doc_id"], first["quality"], first["toxic"])):
        found.setdefault(ident, (quality, toxic))
    return found


KINDS = ("corpus", "target", "good", "bad", "toxic", "clean")


def count_models(docs: DataFrame, sample: Sample, rule: Resampling, id_column: str, text_column: str) -> DataFrame:
    """Counts of every bucket over all texts and over the good ones of the sample, and the numbers of good
    texts, bad ones (of low quality), toxic and clean ones of the sample that have it. Each task adds up its own."""
    known = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(rule.buckets), np.zeros((len(KINDS), rule.buckets), np.int64)
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        size = 0

        def add_up() -> None:
            for kind, found in held.items():
                if found:
                    total[kind] += np.bincount(np.concatenate(found), minlength=rule.buckets)
                    found.clear()

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = grams(text.as_py() or "")
                held[0].append(found)
                size += len(found)
                mark = known.value.get(ident)
                if mark is not None:
                    only = np.unique(found)
                    for kind, holds in zip((2, 3, 4, 5), (is_good(mark), mark[0] == 0, mark[1] == 1, mark[1] == 0)):
                        if holds:
                            total[kind, only] += 1
                    if is_good(mark):
                        held[1].append(found)
                if size > 2_000_000:
                    add_up()
                    size = 0
        add_up()
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some.astype(np.int32), *total[:, some])], ["bucket", *KINDS])

    texts = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"))
    counts = texts.mapInArrow(run, "bucket int, " + ", ".join(f"{kind} bigint" for kind in KINDS))
    counts = stored(counts.groupBy("bucket").agg(*[F.sum(kind).alias(kind) for kind in KINDS]))
    known.unpersist()
    return counts


def log_ratios(counts: DataFrame, sample: Sample, rule: Resampling) -> Column:
    """Shrunken logarithm of target share over corpus share, from the sums of a bucket.

    It is no larger than that of good over bad labelled texts, and 0 where the two disagree, as a
    text copied a thousand times has much weight in the corpus.
    """
    corpus, target = F.col("corpus"), F.col("target")
    all_corpus, all_target = counts.agg(F.sum(corpus), F.sum(target)).first()
    if not all_corpus or not all_target:
        return F.lit(0.0)
    expected = corpus * F.lit(all_target / all_corpus)
    ratio = F.log((target + 0.5) / (expected + 0.5))
    n_good, n_bad = sum(map(is_good, sample.values())), sum(q == 0 for q, _ in sample.values())
    labelled = F.log((F.col("good") + 0.5) / F.lit(n_good + 1)) - F.log((F.col("bad") + 0.5) / F.lit(n_bad + 1))
    agreed = F.when(ratio * labelled > 0, F.signum(ratio) * F.least(F.abs(ratio), F.abs(labelled))).otherwise(0.0)
    square, texts = (target - expected) * (target - expected) / (expected + 1), F.when(ratio < 0, F.col("bad")).otherwise(F.col("good"))
    return agreed * square / (square + rule.z**2) * texts * texts / (texts * texts + rule.support**2)


@dataclass(frozen=True)
class Ratios:
    """What a task has to know: the log ratio of each bucket, and its labelled toxic and clean texts."""

    ratios: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: int
    n_clean: int

    def harm(self, rule: Resampling, own_toxic: int, own_clean: int) -> np.ndarray:
        """Shrunken logarithm of the share of toxic texts over that of all labelled texts, 0 if below 1;
        without the counts of a text's own, if that is labelled."""
        a, b = self.n_toxic - own_toxic, self.n_clean - own_clean
        if a < 1 or b < 1:
            return np.zeros(len(self.toxic), np.float32)
        toxic, clean = np.maximum(self.toxic - own_toxic, 0), np.maximum(self.clean - own_clean, 0)
        expected = (toxic + clean) * (a / (a + b))
        square = (toxic - expected) ** 2 / (expected + 1)
        found = np.log((toxic + 0.5) / (expected + 0.5)) * square / (square + rule.z**2) * toxic**2 / (toxic**2 + rule.support**2)
        return np.maximum(found, 0).astype(np.float32)


def read_ratios(counts: DataFrame, sample: Sample, rule: Resampling) -> Ratios:
    """The ratios of all buckets, a few MB whatever the corpus: `rule.buckets` numbers of each sort."""
    rows = counts.select("bucket", log_ratios(counts, sample, rule).cast("float").alias("ratio"), F.col("toxic").cast("int"), F.col("clean").cast("int")).toArrow()
    place, full = rows["bucket"].to_numpy(), []
    for name, kind in (("ratio", np.float32), ("toxic", np.int32), ("clean", np.int32)):
        full.append(np.zeros(rule.buckets, kind))
        full[-1][place] = rows[name].to_numpy()
    return Ratios(*full, *(sum(t == kind for _, t in sample.values()) for kind in (1, 0)))


def gumbel(ident: int | None, text: str) -> float:
    """Standard Gumbel noise that depends on the row's id and text alone."""
    u = (xxhash.xxh64_intdigest(text.encode(), (ident or 0) & (2**64 - 1)) + 0.5) / 2**64
    return float(-np.log(-np.log(u)))


def scored(docs: DataFrame, known: Ratios, sample: Sample, rule: Resampling, id_column: str, text_column: str, keep: list[str]) -> DataFrame:
    """(row, weight, key, toxic, apart) of every row, with `row` its columns `keep`: toxic weights as any text has
    them, and `apart` those of labelled texts without what they add themselves."""
    shared = docs.sparkSession.sparkContext.broadcast((known, {i: 1 if t == 1 else 2 for i, (_, t) in sample.items() if t >= 0}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, (ratios, row_of) = Grams(rule.buckets), shared.value
        harms = [ratios.harm(rule, *own) for own in ((0, 0), (1, 0), (0, 1))]

        def strongest(found: np.ndarray, harm: np.ndarray) -> float:
            strong = harm[np.unique(found[harm[found] > 0])]
            return float(np.sort(strong)[-rule.strongest :].sum(dtype=np.float64))

        for batch in batches:
            idents, rows = batch.column(1).to_pylist(), []
            for ident, text in zip(idents, batch.column(2)):
                text = text.as_py() or ""
                found = grams(text)
                weight = float(ratios.ratios[found].sum(dtype=np.float64))
                toxic, own = strongest(found, harms[0]), row_of.get(ident, 0)
                rows.append((weight, weight / rule.temperature + gumbel(ident, text), toxic, strongest(found, harms[own]) if own else toxic))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(4)]], ["row", "weight", "key", "toxic", "apart"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"))
    schema = StructType([rows.schema["row"], *[StructField(name, DoubleType()) for name in ("weight", "key", "toxic", "apart")]])
    written = stored(rows.mapInArrow(run, schema))
    shared.unpersist()
    return written


def best_cut(good: np.ndarray, bad: np.ndarray, worth: float = 1.0, margin: bool = True) -> float:
    """The weight that parts good from bad labelled texts best (the mean of both hit rates, that of the good counted `worth` times).

    With `margin` it lies midway to the next lower weight, as unlabelled good texts weigh a little less than labelled ones.
    """
    if not len(good) or not len(bad):
        return float("-inf")
    values = np.unique(np.r_[good, bad])
    kept = 1 - np.searchsorted(np.sort(good), values) / len(good)
    gone = np.searchsorted(np.sort(bad), values) / len(bad)
    best = int(np.argmax(worth * kept + gone))
    return float((values[best] + values[max(0, best - 1)]) / 2 if margin else values[best])


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096, at_end: int = 10_000) -> float:
    """The k-th largest value, by ever finer histograms; no sort and nothing unbounded on the driver."""
    low, high, total = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= total:
        return float("-inf")
    if k < 1:
        return float("inf")
    inside = values.select(F.col(column).alias("v"))
    while low < high:
        width = (high - low) / bins
        place = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / width)).cast("int")
        found = inside.filter(F.col("v").between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        for row in sorted(found.collect(), reverse=True):
            if row.n >= k:
                break
            k -= row.n
        if row.n <= at_end:
            rest = inside.filter(F.col("v").between(row.a, row.b)).collect()
            return sorted((x.v for x in rest), reverse=True)[k - 1]
        low, high = row.a, row.b
    return low


@dataclass(frozen=True)
class Draw:
    """The scored rows, the weights from which texts are out or in, the size of the sample, and the key of its last text."""

    rows: DataFrame
    toxic_cut: float
    cut: float
    size: int
    last_key: float

    def kept(self) -> Column:
        return (F.col("key") >= self.last_key) & (F.col("toxic") < self.toxic_cut)


def draw(
    docs: DataFrame, labels: DataFrame, rule: Resampling = Resampling(), id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None
) -> Draw:
    """Count both models, weigh all rows once, write them, and draw the sample from what is written.

    keep: the columns that go along, all of them by default; the id has to be one.

    Toxic texts are out first, by a weight of their own. The sample is as large as the number of
    others that weigh no less than the weight that parts the labelled texts best. Without labels of both kinds every text is sampled.

    A null text is empty and weighs 0, as does a text whose n-grams are all unremarkable; null ids
    pass through; equal rows get equal keys, and texts with the last sampled key are all kept; labels that
    are null or have no id count as none, the first of several of an id's counts by quality, then toxicity;
    columns may have any names; no rows give no rows.
    """
    sample = labelled_rows(docs, labels, rule, id_column, text_column)
    known = read_ratios(count_models(docs, sample, rule, id_column, text_column), sample, rule)
    rows = scored(docs, known, sample, rule, id_column, text_column, keep or docs.columns)
    marked = docs.sparkSession.createDataFrame(pa.table({"ident": pa.array(list(sample), pa.int64()), **{k: pa.array([m[j] for m in sample.values()], pa.int32()) for j, k in enumerate(("quality", "toxic_label"))}}))
    seen = rows.select(F.col("row")[id_column].alias("ident"), "weight", "apart").join(F.broadcast(marked), "ident")  # at most rule.labelled rows
    seen = seen.groupBy("ident", "quality", "toxic_label").agg(F.min("weight").alias("weight"), F.max("apart").alias("harm")).toArrow()
    quality, toxic, weight, harm = (seen[c].to_numpy() for c in ("quality", "toxic_label", "weight", "harm"))
    cut = best_cut(weight[(quality == 1) & (toxic != 1)], weight[quality == 0])
    # Turned round: the clean weigh less.
    toxic_cut = float(np.nextafter(-best_cut(-harm[toxic == 0], -harm[toxic == 1], rule.clean, margin=False), np.inf))
    fine = rows.filter(F.col("toxic") < toxic_cut).select("weight", "key")
    size = fine.filter(F.col("weight") >= cut).count()
    return Draw(rows, toxic_cut, cut, size, kth_largest(fine, "key", size))


def weigh(drawn: Draw, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, log_weight, sample_key, kept) of every row that was weighed."""
    return drawn.rows.select(F.col("row")[id_column].alias("doc_id"), F.col("weight").alias("log_weight"), F.col("key").alias("sample_key"), drawn.kept().alias("kept"))


def sampled(drawn: Draw) -> DataFrame:
    """The rows that were sampled, with their columns."""
    return drawn.rows.filter(drawn.kept()).select("row.*")
