"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK random walk writes a text of n words as one of 3n: it repeats or passes on a word as a
shared random bit of place and word says. Two texts at a small edit distance fall into step
again after each edit, so their walks are at a small Hamming distance, and a few sampled places
of the walks often agree. Many repeats make it likely that one of them does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Factors of the hash of a run of words; its upper bits mark which runs occur in items at all.
ODD = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MARK = np.uint64(42)
EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())


@dataclass(frozen=True)
class Leaks:
    """similarity: 1 - edit distance / words of the item, counted in words, at least.
    least_words: shorter items are not looked for. walks, samples, places: embeddings, samples from
    each, and places in a sample. slice_words: words of items handled in one pass over the
    documents; more items take more passes.
    """

    similarity: float = 0.8
    least_words: int = 5
    walks: int = 8
    samples: int = 8
    places: int = 3
    slice_words: int = 1_000_000

    def edits(self, n: int) -> int:
        return int(round((1 - self.similarity) * n, 9))

    def seed(self, n: int) -> int:
        """Words in a row that are left of n words after the allowed edits, wherever these are."""
        k = self.edits(n)
        return -(-(n - k) // (k + 1))


class Vocabulary(dict):
    """Number of a word of the items; others are -1. Case and marks at the ends of a word don't count."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.cores: dict[bytes, int] = {}
        self.limit = limit

    def learn(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.cores.setdefault(w.strip(EDGES), len(self.cores)) for w in words], np.int64)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = self.cores.get(word.strip(EDGES), -1)
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def walk(windows: np.ndarray, seed: int) -> np.ndarray:
    """CGK embeddings of rows of word numbers (one length): an array three times as wide."""
    rows, n = windows.shape
    words = np.full((rows, n + 1), -2, np.int64)  # a walk that is through stays on the last column
    words[:, :n] = windows
    chance = mixed(words.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)).ravel()
    words = words.ravel()
    at, out = np.arange(rows) * (n + 1), np.empty((3 * n, rows), np.int64)
    last = at + n
    factors = np.random.default_rng([seed, 3]).integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for j in range(3 * n):
        out[j] = words[at]
        at += ((chance[at] * factors[j]) >> np.uint64(63)).view(np.int64)
        np.minimum(at, last, out=at)
    return out.T


def signatures(windows: np.ndarray, rule: Leaks) -> np.ndarray:
    """Hashes of the sampled places of every walk: a row of walks * samples for each window."""
    n, found = windows.shape[1], []
    for seed in range(rule.walks):
        walked = walk(windows, seed)
        places = np.random.default_rng([seed, n]).integers(0, 3 * n, (rule.samples, rule.places))
        for sample in places:
            value = np.zeros(len(windows), np.uint64)
            for place in sample:
                value = mixed(value * np.uint64(31) + walked[:, place].astype(np.uint64) + np.uint64(7))
            found.append(value)
    return np.stack(found, axis=1)


def best_matches(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, start, end) of the stretch of each row of `texts` at the least edit distance to that row of `items`; the first, longest such.

    Rows of `texts` may be filled up behind with numbers that no item has. A cell holds distance and start in one number.
    """
    rows, width = texts.shape
    place = np.arange(width + 1, dtype=np.int64)
    one = np.int64(1 << 32)
    above = np.broadcast_to(place, (rows, width + 1)).copy()
    for i in range(items.shape[1]):
        row = above + one
        row[:, 0] = (i + 1) * one
        np.minimum(row[:, 1:], above[:, :-1] + (texts != items[:, i, None]) * one, out=row[:, 1:])
        row -= place * one
        above = np.minimum.accumulate(row, axis=1) + place * one
    end = np.argmin(above >> 32, axis=1)
    best = above[np.arange(rows), end]
    return best >> 32, best & (one - 1), end


class Items:
    """Items of one slice, their seeds and their signatures."""

    def __init__(self, rows: list[tuple[int, str]], rule: Leaks):
        self.rule, self.vocabulary = rule, Vocabulary()
        self.ids, self.words = [], []
        for ident, text in rows:
            words = words_of(text)
            if len(words) >= rule.least_words:
                self.ids.append(ident)
                self.words.append(self.vocabulary.learn(words))
        self.q = min((rule.seed(len(w)) for w in self.words), default=1)
        hashes, item, offset = [], [], []
        for i, words in enumerate(self.words):
            codes = self.codes(words, np.arange(max(0, len(words) - self.q + 1)))
            hashes.append(codes)
            item.append(np.full(len(codes), i))
            offset.append(np.arange(len(codes)))
        self.hashes = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.marked = np.zeros(1 << 64 - int(MARK), bool)
        self.marked[self.hashes >> MARK] = True
        self.item, self.offset = (np.concatenate([*x, np.zeros(0, np.int64)])[order] for x in (item, offset))
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.of_size = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        self.sizes, self.rank = sizes, np.zeros(len(sizes), np.int64)
        self.stacked, self.signed = {}, {}
        for n, some in self.of_size.items():
            self.rank[some] = np.arange(len(some))
            self.stacked[n] = np.stack([self.words[i] for i in some])
            self.signed[n] = signatures(self.stacked[n], rule)

    def codes(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A hash of the q words from each place."""
        value = np.zeros(len(at), np.uint64)
        for j in range(self.q):
            value += words[at + j].view(np.uint64) * ODD[j % len(ODD)]
        return value ^ (value >> np.uint64(31))

    def seeds(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, entry in `hashes`) for every run of q words that `words` and an item share."""
        known = words >= 0
        runs = known[: max(0, len(words) - self.q + 1)].copy()
        for j in range(1, self.q):
            runs &= known[j : len(runs) + j]
        at = np.flatnonzero(runs)
        codes = self.codes(words, at)
        some = self.marked[codes >> MARK]
        at, codes = at[some], codes[some]
        low = np.searchsorted(self.hashes, codes, "left")
        count = np.searchsorted(self.hashes, codes, "right") - low
        entry = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), entry

    def found(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item id, start, end, distance) of the best stretch for every item it holds; places count words.

        Windows of all texts that have one length are embedded, and verified, together.
        """
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        if self.words:
            raw = list(map(words_of, texts))
            base = np.cumsum([0, *(len(x) + 1 for x in raw)])  # a -1 after each text
            words = np.full(base[-1], -1, np.int64)
            for x, low in zip(raw, base.tolist()):
                words[low : low + len(x)] = np.fromiter(map(self.vocabulary.__getitem__, x), np.int64, len(x))
            place, entry = self.seeds(words)
            doc = np.searchsorted(base, place, "right") - 1
            item, start = self.item[entry], place - base[doc] - self.offset[entry]
            order = np.lexsort((start, item, doc))
            doc, item, start = doc[order], item[order], start[order]
            new = np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(start) != 0)][: len(doc)]
            doc, item, start = doc[new], item[new], start[new]
            for n in self.of_size:
                chosen = np.flatnonzero(self.sizes[item] == n)
                step = max(1, 500_000 // n)
                for first in range(0, len(chosen), step):
                    some = chosen[first : first + step]
                    self._verify(n, words, base, doc[some], item[some], start[some], best)
        return [[(self.ids[i], a, b, d) for i, (d, a, b) in sorted(x.items())] for x in best]

    def _verify(self, n: int, words: np.ndarray, base: np.ndarray, doc: np.ndarray, item: np.ndarray, start: np.ndarray, best: list) -> None:
        """Take up the matches among windows of n words that share a signature with their item."""

        def cut(low: np.ndarray, width: int, doc: np.ndarray, filler: int) -> np.ndarray:
            place = low[:, None] + np.arange(width)
            size = (base[doc + 1] - base[doc] - 1)[:, None]
            inside = (place >= 0) & (place < size)
            return np.where(inside, words[np.clip(place + base[doc][:, None], 0, len(words) - 1)], filler)

        alike = (signatures(cut(start, n, doc, -1), self.rule) == self.signed[n][self.rank[item]]).any(1)
        doc, item, start = doc[alike], item[alike], start[alike]
        k = self.rule.edits(n)
        low = np.maximum(0, start - k)
        for first in range(0, len(doc), max(1, 500_000 // n)):
            s = slice(first, first + max(1, 500_000 // n))
            text = cut(low[s], n + 2 * k, doc[s], -3)
            distance, a, b = best_matches(self.stacked[n][self.rank[item[s]]], text)
            for at, i, x, d, y, z in zip(doc[s].tolist(), item[s].tolist(), low[s].tolist(), distance.tolist(), a.tolist(), b.tolist()):
                if d <= k:
                    best[at][i] = min(best[at].get(i, (n, 0, 0)), (d, x + y, x + z))


def found_in(items: Items, texts: pa.Array, most: int = 8_000_000) -> Iterator[list[tuple[int, int, int, int]]]:
    """What `items.found` says of each text, asked for about `most` characters at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= most:
            yield from items.found(held)
            held, size = [], 0
    yield from items.found(held)


def item_slices(benchmark: DataFrame, rule: Leaks, id_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    """Items in slices of at most about `slice_words` words, by a hash of their text; each is sure to fit the driver."""
    items = benchmark.filter(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    slices = int(-(-words // rule.slice_words))
    for i in range(slices):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == i) if slices > 1 else items
        yield sorted((row.id, row.text) for row in part.collect())


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rule: Leaks = Leaks(), id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id"
) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance, item_words): the best stretch for every item a document holds.

    Each document is compared with all items, in passes over slices of these; nothing is
    shuffled. Windows of an item's size are laid where document and item share as many words
    in a row as the allowed edits must leave somewhere, so no leak is without such a window;
    windows that share a signature with the item are verified exactly. Null texts hold nothing,
    null items and items below `least_words` are not looked for; a null doc_id stays null;
    repeated rows of documents give a row each, repeated items one; empty tables give no rows.
    """
    found = None
    schema = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, distance bigint, item_words bigint"
    for rows in item_slices(benchmark, rule, item_column, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows, rule))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            size = {ident: len(words) for ident, words in zip(items.ids, items.words)}
            for batch in batches:
                out = []
                for ident, matches in zip(batch.column(0).to_pylist(), found_in(items, batch.column(1))):
                    out += [(ident, *match, size[match[0]]) for match in matches]
                columns = zip(*out) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], [p.split()[0] for p in schema.split(", ")])

        part = docs.select(id_column, text_column).mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, rule: Leaks = Leaks(), text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """The rows of `docs` that hold no item, with their columns; one pass for each slice of items, no shuffle.

    Null and empty texts hold no item and stay, as do repeated rows; null or empty items are in no
    text; columns may have any names; no rows give no rows, no items leave all rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_column}`").alias("text"))
    for items in item_slices(benchmark, rule, item_column, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(Items(items, rule))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not matches for matches in found_in(shared.value, batch.column("text"))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("row.*")
