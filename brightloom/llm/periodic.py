"""Stretches of a text that repeat themselves: maximal runs of words with a smallest period.

A dictionary of basic factors names the stretches of 1, 2, 4, 8 ... words so that two stretches of a
text have one name just if they are equal. For each length the next occurrence of every stretch is
looked up. Within twice the length, next occurrences at one distance p form arithmetic progressions,
and neighbouring starts with one p make up a repetition with period p.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.words import coded, grouped, id_and_text, split_words


@dataclass(frozen=True)
class Runs:
    """length: words that a run has at least. repeats: periods that it has at least, three or more."""

    length: int = 24
    repeats: int = 3

    def __post_init__(self):
        if self.repeats < 3:
            raise ValueError("a run holds its period three times at least")


def in_order(first: np.ndarray, second: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """An order of `places` (ascending) by the two names, then by place."""
    bits = max(1, int(size).bit_length())
    if 3 * bits > 63:
        return np.lexsort((second, first))
    rows = np.arange(len(places), dtype=np.int64)
    key = (first << (2 * bits)) | (second << bits) | rows
    key.sort()
    return key & ((1 << bits) - 1)


def find_runs(codes: np.ndarray, starts: np.ndarray, rule: Runs = Runs()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of the texts whose words are `codes[starts[k]:starts[k + 1]]`.

    A run of period q shows at the one length 2^k with 2^(k-1) < q <= 2^k, as it is longer than q + 2^k words: a stretch as long as a
    smallest period comes again after q words and not before, so all starts but the last q + 2^k - 1
    of the run have the next occurrence at q, the words around them do not, and the progression ends
    just where the run does. The same run, proposed at a shorter length, would be a duplicate, and
    is not looked at there. Starts whose stretch never comes again in the text are dropped for good,
    so most texts are done after a few lengths.
    """
    n, size = len(codes), 1
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ends = np.repeat(starts[1:], np.diff(starts))
    longest = int(np.diff(starts).max())
    places = np.arange(n, dtype=np.int64)
    first, second = codes, text_of
    found = []
    while len(places) and size <= longest:
        order = in_order(first, second, places, max(n, len(starts)))
        a, b, at = first[order], second[order], places[order]
        again = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (text_of[at[1:]] == text_of[at[:-1]])
        gap = at[1:] - at[:-1]
        near = again & (gap <= size) & (2 * gap > size)
        if near.any():
            start, period = at[:-1][near], gap[near]
            row = np.argsort(start)
            start, period = start[row], period[row]
            head = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (period[1:] != period[:-1])])
            tail = np.r_[head[1:], len(start)] - 1
            begin, step = start[head], period[head]
            length = start[tail] - begin + size + step
            some = (length >= rule.length) & (length >= rule.repeats * step)
            if some.any():
                found.append((begin[some], length[some], step[some]))
        # Names for the stretches that come again; the next stretches are two of these side by side.
        held = np.r_[again, False] | np.r_[False, again]
        names = np.full(n, -1, np.int64)
        names[at[held]] = np.cumsum(np.r_[True, ~again])[held]
        places = np.sort(at[held])
        places = places[places + 2 * size <= ends[places]]
        places = places[names[places + size] >= 0]
        first, second = names[places], names[places + size]
        size *= 2
    if not found:
        return none, none, none
    begin, length, step = (np.concatenate(x) for x in zip(*found))
    row = np.lexsort((step, begin))
    return begin[row], length[row], step[row]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, rule: Runs = Runs(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every whole text, in its own row; nothing is shuffled.

    runs: start (number of its first word), length and period of each maximal run, by start, then
    period; overlapping runs of different periods all count. collapsed: the words, joined by one
    space, without those that some run holds behind its first period.

    A null or blank text has no words, no runs and an empty `collapsed`; null and repeated ids get a
    row for each of theirs; no rows give no rows; other columns, whatever their names, are not looked
    at. Texts are taken some megabytes at a time, a longer one alone, with some 100 bytes of memory a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in grouped(texts):
                words, starts = split_words(texts[first:last])
                codes, _ = coded(words)
                begin, length, period = find_runs(codes, starts, rule)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, begin + period, 1)
                np.add.at(change, begin + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                part = np.searchsorted(begin, starts)
                texts_left = []
                for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    some = words[a:b] if part[k] == part[k + 1] else compress(words[a:b], kept[a:b].tolist())
                    texts_left.append(b" ".join(some))
                begin = begin - starts[np.searchsorted(starts, begin, "right") - 1]
                rows = pa.StructArray.from_arrays([pa.array(x) for x in (begin, length, period)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(np.diff(starts)),
                        pa.ListArray.from_arrays(pa.array(part, pa.int32()), rows),
                        pa.array(texts_left, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = id_and_text(docs, id_column, text_column)
    ident = rows.schema["_id"].dataType.simpleString()
    schema = f"doc_id {ident}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(run, schema)


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the one that holds its period most often, and digests of all runs and of what is left.

    Equal numbers of periods are told apart by start, then period; without runs these are null.
    """
    best = F.aggregate(
        "runs",
        F.get("runs", F.lit(0)),
        lambda top, x: F.when(x["length"] * top["period"] > top["length"] * x["period"], x).otherwise(top),
    )
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    digests = found.select("doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return digests.select(
        "doc_id",
        "n_words",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
