"""Repeated passages: suffixes are ordered only through their first `length` bytes.

Ordering every suffix of a corpus would shuffle it a dozen times over. Here the passes go
from coarse digits to fine ones, and after each pass only suffixes that still share their
digit with another go on:

1. an anchor in the middle of the window: of the 8-byte grams there, the one with the least
   hash. Equal windows have their anchor at the same offset, and an anchor serves some thirty
   neighbouring windows, so this digit, the bytes around the anchor, is written once for all;
2. the whole stretch that the windows of one anchor cover: equal stretches are settled at once;
3. the window itself, all `length` bytes, only where stretches of one anchor differ.

Groups that are equal after the last pass are exactly the repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.batches import stored

GRAM = 8
# Bytes that are worked on at once, and the bits that hold a place among them.
PLACE_BITS = 22
BLOCK = 1 << PLACE_BITS


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Windows:
    """Windows of `length` bytes; an anchor keeps `margin` bytes of the window on either side."""

    length: int = 100
    margin: int = 16

    def __post_init__(self):
        if not 1 <= self.choices < 4096 or self.margin < 0:
            raise ValueError("the window has no room for an anchor")

    @property
    def choices(self) -> int:
        """Grams an anchor is chosen from."""
        return self.length - 2 * self.margin - GRAM + 1

    @property
    def around(self) -> int:
        """Bytes that all windows of an anchor have in common."""
        return 2 * self.margin + GRAM


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    two = data[:-1].astype(np.uint64) | (data[1:].astype(np.uint64) << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return four[:-4] | (four[4:] << np.uint64(32))


def runs(data: np.ndarray, ends: np.ndarray, shape: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, digit of the bytes around) of texts that lie one after another.

    data: at most BLOCK bytes; ends: where each text ends in it.
    """
    nothing = np.zeros(0, np.int64)
    if len(data) < shape.length:
        return nothing, nothing, nothing, nothing.astype(np.uint64)
    eight = grams(data)
    places = np.uint64(BLOCK - 1)
    least = (mix(eight) & ~places) | np.arange(len(eight), dtype=np.uint64)
    size = 1
    while size * 2 <= shape.choices:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = shape.choices - size
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    # least[g]: the anchor among the grams from g on; a window from p on chooses from p + margin on
    n = len(data) - shape.length + 1
    anchor = (least[shape.margin : shape.margin + n] & places).astype(np.int64)
    inside = np.ones(n, bool)
    for end in ends[:-1]:
        inside[max(0, end - shape.length + 1) : end] = False
    window = np.flatnonzero(inside)
    if not len(window):
        return nothing, nothing, nothing, nothing.astype(np.uint64)
    anchor = anchor[window]
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(window) != 1)) + 1
    first, last = np.r_[0, new], np.r_[new, len(window)] - 1
    anchor = anchor[first]
    return anchor, window[first], window[last], digit(eight, anchor - shape.margin, shape.around)


def digit(eight: np.ndarray, start: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of `size` bytes from each start on."""
    value = np.full(len(start), seed, np.uint64)
    for step in [*range(0, size - GRAM + 1, GRAM), *([size - GRAM] if size % GRAM else [])]:
        value = mix(value * np.uint64(0x2545F4914F6CDD1D) + eight[start + step])
    return value


def blocks(texts: Iterable[bytes], shape: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts one after another in blocks: (bytes, where each ends, number of the text, place of its first byte in the text).

    A text larger than a block is given in pieces that overlap, so that no window is lost.
    """
    held: list[bytes] = []
    numbers, bases, size = [], [], 0

    def block():
        ends = np.cumsum([len(x) for x in held])
        return np.frombuffer(b"".join(held), np.uint8), ends, np.array(numbers), np.array(bases)

    for number, text in enumerate(texts):
        if len(text) < shape.length:
            continue
        base = 0
        while True:
            piece = text[base : base + BLOCK]
            if size + len(piece) > BLOCK:
                yield block()
                held, numbers, bases, size = [], [], [], 0
            held.append(piece)
            numbers.append(number)
            bases.append(base)
            size += len(piece)
            if base + BLOCK >= len(text):
                break
            base += BLOCK - shape.length + 1
    if held:
        yield block()


ANCHOR = "digit bigint, stretch bigint, doc bigint, tag bigint, place bigint"


def anchors(texts: DataFrame, shape: Windows) -> DataFrame:
    """First pass: a row for each anchor of each text.

    digit: the bytes around the anchor; stretch: all bytes its windows cover; place: where the
    anchor is, with the numbers of windows' starts before it packed below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = (x.as_buffer().to_pybytes() for x in batch.column(2).cast(pa.binary()))
            for data, ends, numbers, bases in blocks(texts, shape):
                anchor, first, last, around = runs(data, ends, shape)
                if not len(anchor):
                    continue
                stretch = stretches(grams(data), first, last, anchor, shape)
                of = np.searchsorted(ends, anchor, "right")
                start = np.r_[0, ends[:-1]][of]
                row = numbers[of]
                place = pack(anchor - start + bases[of], anchor - first, anchor - last)
                columns = [around.view(np.int64), stretch.view(np.int64), docs[row], tags[row], place]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["digit", "stretch", "doc", "tag", "place"])

    return texts.select("doc", "tag", "text").mapInArrow(run, ANCHOR)


def pack(anchor: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    return (anchor.astype(np.int64) << 24) | (far << 12) | near


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, last window."""
    anchor = place >> 24
    return anchor, anchor - ((place >> 12) & 0xFFF), anchor - (place & 0xFFF)


def stretches(eight: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, shape: Windows) -> np.ndarray:
    """64-bit hash of all bytes from the first window's start to the last one's end, and of the anchor's offset."""
    value = mix((anchor - first).astype(np.uint64) + np.uint64(1))
    end = last + shape.length - GRAM
    for step in range(0, shape.choices - 1 + shape.length, GRAM):
        at = first + step
        more = at < end + GRAM
        at = np.minimum(at, end)  # the last gram may overlap the one before
        value[more] = mix(value[more] * np.uint64(0x2545F4914F6CDD1D) + eight[at[more]])
    return value


def later_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk rows sorted by digit, stretch and place; keeps one row of the group and of the class in memory.

    Yields (rows that come after another row of their digit and stretch; first rows of stretches
    whose digit has another stretch), as arrays of the five columns. Repeats of a first row are
    neither.
    """
    head = lead = None  # first row of the digit, first row of the stretch
    told = True  # whether the head has been given out already
    for batch in batches:
        rows = np.stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
        if not rows.shape[1]:
            continue
        kept = [x.reshape(5, 1) for x in (head, lead) if x is not None]
        old = len(kept)
        rows = np.concatenate([*kept, rows], axis=1)
        new_digit = np.r_[True, rows[0, 1:] != rows[0, :-1]]
        new_stretch = new_digit | np.r_[True, rows[1, 1:] != rows[1, :-1]]
        index = np.arange(rows.shape[1])
        first = np.maximum.accumulate(np.where(new_stretch, index, 0))
        later = ~new_stretch & (rows[2:] != rows[2:, first]).any(0)
        later[:old] = False
        digit_first = np.maximum.accumulate(np.where(new_digit, index, 0))
        second = new_stretch & ~new_digit
        if old == 2:
            second[1] = False  # given out when it was met
        mixed = np.unique(digit_first[second])
        if told and old:
            mixed = mixed[mixed != 0]
        yield rows[:, later], rows[:, np.r_[mixed, np.flatnonzero(second)].astype(np.int64)]
        told = (told and bool(old) and digit_first[-1] == 0) or digit_first[-1] in digit_first[second]
        head, lead = rows[:, digit_first[-1]].copy(), rows[:, first[-1]].copy()


def _batch(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)


def settle(rows: DataFrame) -> DataFrame:
    """Second pass: `later` runs are repeats as a whole; the other rows are stretches to be looked at window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for later, mixed in later_ones(batches):
            for part, flag in ((later, True), (mixed, False)):
                if part.shape[1]:
                    batch = _batch(part, ["digit", "stretch", "doc", "tag", "place"])
                    yield batch.append_column("later", pa.array(np.full(part.shape[1], flag)))

    order = ["digit", "stretch", "doc", "tag", "place"]
    return rows.repartition("digit").sortWithinPartitions(*order).mapInArrow(run, ANCHOR + ", later boolean")


def contexts(texts: DataFrame, open_runs: DataFrame, shape: Windows) -> DataFrame:
    """The bytes of the stretches that are still open, cut from the texts."""
    wanted = open_runs.groupBy("doc", "tag").agg(F.collect_list(F.struct("digit", "place", "crowded")).alias("open"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digit", "crowded", "doc", "tag", "first", "bytes"]
        for batch in batches:
            out: list[tuple] = []
            for doc, tag, text, found in zip(*(column.to_pylist() for column in batch.columns)):
                if not found:
                    continue
                data = text.encode()
                _, first, last = unpack(np.array([x["place"] for x in found], np.int64))
                out += [(x["digit"], x["crowded"], doc, tag, a, data[a : b + shape.length]) for x, a, b in zip(found, first.tolist(), last.tolist())]
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    schema = "digit bigint, crowded boolean, doc bigint, tag bigint, first bigint, bytes binary"
    return texts.join(wanted, ["doc", "tag"], "left").select("doc", "tag", "text", "open").mapInArrow(run, schema)


def windows_of(batch: pa.RecordBatch, shape: Windows) -> np.ndarray:
    """Two hashes, document, tag and start of each window of a batch of contexts, one column each."""
    doc, tag, first = (batch.column(name).to_numpy() for name in ("doc", "tag", "first"))
    texts = batch.column("bytes").to_pylist()
    size = np.array([len(x) for x in texts])
    eight = grams(np.frombuffer(b"".join(texts), np.uint8))
    each = size - shape.length + 1
    owner = np.repeat(np.arange(len(texts)), each)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = (np.cumsum(size) - size)[owner] + offset
    hashes = [digit(eight, start, shape.length, seed).view(np.int64) for seed in (1, 2)]
    return np.stack([*hashes, doc[owner], tag[owner], first[owner] + offset])


def later_windows(rows: np.ndarray) -> pa.RecordBatch | None:
    """Runs of windows that come after an equal one; all windows of a digit must be there."""
    rows = rows[:, np.lexsort(rows[::-1])]
    index = np.arange(rows.shape[1])
    new = np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)]
    first = np.maximum.accumulate(np.where(new, index, 0))
    rows = rows[2:, (rows[2:] != rows[2:, first]).any(0)]
    if not rows.shape[1]:
        return None
    rows = rows[:, np.lexsort(rows[::-1])]
    cut = np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0) | (np.diff(rows[2]) > 1)]
    starts = np.flatnonzero(cut)
    stops = np.r_[starts[1:], rows.shape[1]] - 1
    return _batch(np.stack([*rows[:, starts], rows[2, stops]]), ["doc", "tag", "first", "last"])


RUNS = "doc bigint, tag bigint, first bigint, last bigint"
# Windows compared in one task for one digit; a digit with more stretches has its windows shuffled.
TASK_STRETCHES = 50_000


def settle_windows(found: DataFrame, shape: Windows) -> DataFrame:
    """Third pass: runs of windows that come after an equal one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last = 0, None
        for batch in batches:
            digits = batch.column("digit").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(digits)) + 1, len(digits)]
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if digits[start] != last and size >= 4096:
                    out = later_windows(np.concatenate(held, axis=1))
                    held, size = [], 0
                    if out is not None:
                        yield out
                held.append(windows_of(batch.slice(start, end - start), shape))
                size, last = size + end - start, digits[start]
        if held and (out := later_windows(np.concatenate(held, axis=1))) is not None:
            yield out

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch(windows_of(batch, shape), ["digit", "stretch", "doc", "tag", "place"])

    near = found.filter("not crowded").repartition("digit").sortWithinPartitions("digit").mapInArrow(run, RUNS)
    crowd = settle(found.filter("crowded").mapInArrow(spread, ANCHOR)).filter("later")
    return near.union(crowd.select("doc", "tag", F.col("place").alias("first"), F.col("place").alias("last")))


NO_ID = (1 << 63) - 1


def remove_repeats(
    docs: DataFrame, shape: Windows = Windows(), id_column: str = "doc_id", text_column: str = "text", task_stretches: int = TASK_STRETCHES
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every whole text, in UTF-8 bytes.

    A byte goes if a window of `shape.length` bytes that covers it also starts earlier: in a
    document with a smaller id, or in the same one further to the front. Windows are judged on
    the input. spans: the runs that go, end exclusive; kept: what stays, as bytes, which may
    break a character. A null text is empty; a null id comes after all others; rows with the same
    id and text count as one document and get the same result each; rows with the same id and
    other texts come in the order of their hash; other columns are not looked at; no rows give
    no rows. Windows are compared by hashes of 128 bits.
    """
    texts = docs.select(
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce(text_column, F.lit(""))).alias("tag"),
        F.coalesce(text_column, F.lit("")).alias("text"),
    )
    settled = stored(settle(anchors(texts, shape)))
    still = settled.filter("not later")
    crowds = still.groupBy("digit").agg((F.count(F.lit(1)) > task_stretches).alias("crowded")).filter("crowded")
    still = still.join(crowds, "digit", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    found = contexts(texts, still, shape)
    whole = settled.filter("later").select(
        "doc", "tag", F.expr("(place >> 24) - ((place >> 12) & 4095) AS first"), F.expr("(place >> 24) - (place & 4095) AS last")
    )
    gone = whole.union(settle_windows(found, shape)).groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return texts.join(gone, ["doc", "tag"], "left").select("doc", "text", "runs").mapInArrow(
        lambda batches: cut_out(batches, shape.length), "doc_id bigint, n_bytes bigint, spans array<struct<start bigint, end bigint>>, kept binary"
    )


def cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Join the runs of windows to spans of bytes and take these out."""
    for batch in batches:
        out: list[tuple] = []
        for doc, text, found in zip(*(column.to_pylist() for column in batch.columns)):
            data, spans = text.encode(), []
            for first, last in sorted((x["first"], x["last"]) for x in found or ()):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last + length)
                else:
                    spans.append([first, last + length])
            edges = [0, *(x for span in spans for x in span), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((None if doc == NO_ID else doc, len(data), [{"start": a, "end": b} for a, b in spans], kept))
        names = ["doc_id", "n_bytes", "spans", "kept"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = zip(*out) if out else [()] * 4
        kinds = [pa.int64(), pa.int64(), span, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, kinds)], names)
