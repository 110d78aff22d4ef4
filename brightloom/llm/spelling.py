"""Spelling variants: words one edit apart from a far more frequent word.

Words meet in blocks: of two words one edit apart, the shorter L code points long, either the first
L // 2 code points are equal or the last L - L // 2. A block is indexed by bit sets, one for each
place and letter, with a bit for each word. A word is looked up with a few operations on whole sets
for each of its letters, which carry the words without an error so far and those with one (a letter
replaced, too many or missing: the same index read at the place, one before and one behind).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.batches import stored
from brightloom.llm.words import id_and_text


@dataclass(frozen=True)
class Spelling:
    """letters: code points and occurrences: how often, that a word has at least. ratio: how many times as
    frequent as a word its form is. block: words of a block that are indexed together; a larger block
    is cut into pieces, and each pair of pieces goes to a task of its own. counted: different words
    that a counting task holds before it hands its counts on.
    """

    letters: int = 7
    occurrences: int = 2
    ratio: int = 10
    block: int = 4096
    counted: int = 200_000


RUN = re.compile("[a-zÀ-ÿ]+")


def count_words(
    docs: DataFrame,
    rule: Spelling = Spelling(),
    changed: Callable[[object, str], str] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, over all whole texts.

    Words are the longest stretches of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.
    `changed(id, word)` may give another word for all occurrences in a row. Tasks add up their own
    words and hand counts on, so a frequent word comes as one row of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return rows

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = RUN.findall((text.as_py() or b"").lower().decode())
                if changed is None:
                    total.update(words)
                else:
                    for word, n in Counter(words).items():
                        total[changed(ident, word)] += n
                if len(total) > rule.counted:
                    yield handed_on()
        yield handed_on()

    rows = id_and_text(docs, id_column, text_column).mapInArrow(run, "word string, n bigint")
    rows = rows.filter(F.char_length("word") >= rule.letters)
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rule.occurrences)


class PositionIndex:
    """Bit sets over some words of `short` or `short + 1` letters, for each place and letter."""

    def __init__(self, words: list[str], short: int):
        self.short, self.all = short, (1 << len(words)) - 1
        self.sets: dict[tuple[int, str], int] = {}
        self.shorter = 0
        places: dict[tuple[int, str], list[int]] = {}
        for bit, word in enumerate(words):
            if len(word) == short:
                self.shorter |= 1 << bit
            for key in enumerate(word):
                places.setdefault(key, []).append(bit)
        room = len(words) // 8 + 1
        for key, bits in places.items():
            packed = bytearray(room)
            for bit in bits:
                packed[bit >> 3] |= 1 << (bit & 7)
            self.sets[key] = int.from_bytes(packed, "little")

    def near(self, word: str, side: bool) -> int:
        """The words one edit from `word`, where one of the two is `short` long: those with its first
        `short // 2` letters if `side` is false, else those without."""
        held, half = self.sets.get, self.short // 2
        exact, start = self.all, 0
        if len(word) == self.short:
            replaced = missing = 0
            for i, letter in enumerate(word):
                here = held((i, letter), 0)
                replaced = (replaced & here) | (exact & ~here)
                missing = (missing | exact) & held((i + 1, letter), 0)
                exact &= here
                if i + 1 == half:
                    start = exact
            found = (replaced & self.shorter) | ((missing | exact) & ~self.shorter)
        else:
            extra = 0
            for i, letter in enumerate(word):
                extra = (extra & held((i - 1, letter), 0)) | exact
                exact &= held((i, letter), 0)
                if i + 1 == half:
                    start = exact
            found = extra & self.shorter
        return found & ~start if side else found & start


def near_in_block(short: int, side: bool, pieces: tuple[int, int], rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, number of near words, n of the most frequent, that word) within a block, or between two pieces of one."""
    first, second = pieces
    ways = [(first, first)] if first == second else [(first, second), (second, first)]
    for indexed, asked in ways:
        # The most frequent word has the lowest bit; of equal ones the smallest.
        known = sorted(((-n, word) for at, word, n in rows if at == indexed))
        index = PositionIndex([word for _, word in known], short)
        for at, word, _ in rows:
            if at == asked and (found := index.near(word, side)):
                n, best = known[(found & -found).bit_length() - 1]
                yield word, found.bit_count(), -n, best


def near_words(words: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """(word, n_near, form, form_n) of the words of `words(word, n)` that have a near word.

    `form` is the most frequent near word if it is frequent enough, else null. Each pair is found in one block from either side, and only sums and
    the best are handed on: no row is made for a pair. A block that holds more than `rule.block`
    words is cut into pieces by hash, each word with a piece for each pair of pieces.
    """
    size = F.char_length("word")
    shorts = F.filter(F.array(size, size - 1), lambda x: x >= rule.letters)
    rows = words.select("word", "n", F.explode(shorts).alias("short"))
    half = F.shiftright("short", 1)
    sides = F.array(
        F.struct(F.lit(False).alias("side"), F.substring("word", F.lit(1), half).alias("part")),
        F.struct(F.lit(True).alias("side"), F.expr("right(word, short - shiftright(short, 1))").alias("part")),
    )
    rows = rows.select("word", "n", "short", F.inline(sides))
    block = ["short", "side", "part"]
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    large = F.ceil(F.col("size") / F.lit(rule.block)).cast("int")
    rows = rows.join(sizes.select(*block, large.alias("pieces")), block)
    own = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    rows = rows.withColumn("at", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select(*block, F.least("at", "other").alias("first"), F.greatest("at", "other").alias("second"), "at", "word", "n")
    cell = [*block, "first", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, current, held = ["word", "n_near", "best_n", "best"], None, []

        def found() -> list[tuple[str, int, int, str]]:
            return list(near_in_block(current[0], current[1], current[3:], held)) if len(held) > 1 else []

        for batch in batches:
            out = []
            for *key, at, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                key = tuple(key)
                if key != current:
                    out += found()
                    current, held = key, []
                held.append((at, word, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
        if out := found():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)

    met = rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("form"))).alias("best")
    totals = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return totals.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def spelling_variants(words: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `words(word, n)`.

    Two words are near if one inserted, deleted or replaced code point makes one into the other. A
    word's form is its most frequent near word (of equally frequent ones the smallest in code-point
    order), if that is `rule.ratio` times as frequent, else null; root is the last word that forms
    lead to, the word itself if it has none. n_near is 0 without near words.

    Words are to be different; null, too short and too rare ones are left out; no words give no rows.
    """
    words = stored(words.filter((F.char_length("word") >= rule.letters) & (F.col("n") >= rule.occurrences)).select("word", F.col("n").cast("bigint").alias("n")))
    joined = words.join(near_words(words, rule), "word", "left")
    enough = F.col("form_n") >= rule.ratio * F.col("n")
    known = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")
        )
    )
    # A form is ten times as frequent, so chains are short; each round doubles the steps taken.
    roots = stored(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(beyond, "root", "left_semi").isEmpty():
            break
        roots = stored(roots.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
