"""Near duplicates by fingerprints: SimHash and a self-join of their binary trie.

The trie is the sorted list of fingerprints: a node is a range with a common prefix. Node
pairs are walked down together; each level adds a differing bit or none, and a pair beyond the
error budget is dropped with all that hangs below it.

To share the walk out, note that two fingerprints with at most `budget` differing bits agree
in at least one of `budget + 1` blocks of bits. So each fingerprint is turned once for each
block, which becomes the top of the trie and must agree; what agrees meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.llm.batches import per_row, stored
from brightloom.llm.components import components
from brightloom.llm.jaccard import Jaccard, links_in_clusters, lone_grams

BITS = 64
# Fingerprints of one block value that are walked in one task; more are dealt into parts, and
# each pair of parts is a task of its own.
PART_ROWS = 50_000
FRONTIER = 200_000


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half the hashes of the word shingles.

    Words are parted by ASCII blanks and lower-cased in A-Z; repeats count; fewer words than a
    shingle make one shingle; no words give zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashed = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), np.uint64, n)
    total = np.zeros(BITS, np.int64)
    for start in range(0, n, 65536):
        bits = np.unpackbits(hashed[start : start + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint bigint) of every whole text; no shuffle. A null text has no words."""
    columns = "doc_id bigint, fingerprint bigint"
    return per_row(docs, [id_column, text_column], columns, lambda ident, text: (ident, _signed(simhash(text, shingle))))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def walk_pairs(keys: np.ndarray, top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of sorted distinct `keys` that agree in the first `top` bits and differ in 1..budget others."""
    if len(keys) < 2:
        return
    heads = keys >> np.uint64(BITS - top) if top else np.zeros(len(keys), np.uint64)
    cuts = np.flatnonzero(np.diff(heads)) + 1
    low, high = np.r_[0, cuts], np.r_[cuts, len(keys)]
    keep = high - low > 1
    low, high = low[keep], high[keep]
    todo = [(top, low, high, low, high, np.zeros(len(low), np.int8))]
    while todo:
        depth, al, ah, bl, bh, used = todo.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            todo += [(depth, *(x[s] for x in (al, ah, bl, bh, used))) for s in (slice(None, half), slice(half, None))]
            continue
        small = (ah - al) * (bh - bl) <= 64
        if depth == BITS:
            small[:] = True
        if small.any():
            yield from _leaves(keys, al[small], ah[small], bl[small], bh[small], budget)
            al, ah, bl, bh, used = (x[~small] for x in (al, ah, bl, bh, used))
        if not len(al):
            continue
        middle_a, middle_b = _middle(keys, al, ah, depth), _middle(keys, bl, bh, depth)
        same = (al == bl) & (ah == bh)
        branches = [
            (al, middle_a, bl, middle_b, used, None),
            (middle_a, ah, middle_b, bh, used, None),
            (al, middle_a, middle_b, bh, used + 1, None),
            (middle_a, ah, bl, middle_b, used + 1, ~same),  # for a node with itself the mirror of the one before
        ]
        below = []
        for a0, a1, b0, b1, spent, also in branches:
            alive = (a1 > a0) & (b1 > b0) & (spent <= budget)
            if also is not None:
                alive &= also
            alive &= ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))  # one key with itself
            below.append([x[alive] for x in (a0, a1, b0, b1, spent)])
        todo.append((depth + 1, *(np.concatenate(x) for x in zip(*below))))


def _middle(keys: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """First index of each range whose bit at `depth` is set."""
    bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
    first = (keys[low] & ~(bit | (bit - np.uint64(1)))) | bit
    return np.clip(np.searchsorted(keys, first), low, high)


def _leaves(keys, al, ah, bl, bh, budget):
    """Compare the keys of small node pairs one by one, at most 64 for each node pair."""
    sizes = (ah - al) * (bh - bl)
    owner = np.repeat(np.arange(len(al)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = (bh - bl)[owner]
    i, j = al[owner] + offset // width, bl[owner] + offset % width
    near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i != j)
    i, j = i[near], j[near]
    yield np.minimum(i, j), np.maximum(i, j)


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links (i, j): each is the smallest index its node hangs together with."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above
    return label


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index each of n nodes hangs together with; pairs are taken up as they come."""
    label = np.arange(n)
    for i, j in pairs:
        label = merge(label, i, j)
    return label


def links_within(prints: DataFrame, budget: int = 3, part_rows: int = PART_ROWS) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within `budget` bits, directly or by way of others.

    Every link of two fingerprints is found; a task then keeps only a chain through those that
    hang together in it, so the result has fewer rows than the fingerprints have blocks.
    """
    blocks = budget + 1
    width = BITS // blocks
    distinct = prints.select("fingerprint").distinct()
    turned = distinct.select("fingerprint", F.explode(F.array(*[F.lit(i) for i in range(blocks)])).alias("block")).withColumn(
        "head", F.expr(f"shiftrightunsigned(fingerprint, {BITS} - (block + 1) * {width})").bitwiseAND(F.lit((1 << width) - 1))
    )
    crowded = turned.groupBy("block", "head").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts")).filter("parts > 1")
    dealt = turned.join(crowded, ["block", "head"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts"))
    placed = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = placed.select("fingerprint", "block", "head", F.least("part", "other").alias("part"), F.greatest("part", "other").alias("other"))

    def chains(prints: list[np.ndarray], block: int) -> pa.RecordBatch:
        raw = np.concatenate(prints).view(np.uint64)
        turn = np.uint64(block * width)
        keys = np.sort((raw << turn) | (raw >> np.uint64(BITS - int(turn)))) if block else np.sort(raw)
        label = joined(len(keys), walk_pairs(keys, width, budget))
        order = np.argsort(label, kind="stable")
        inner = label[order][1:] == label[order][:-1]
        back = ((keys >> turn) | (keys << np.uint64(BITS - int(turn)))) if block else keys
        back = back.view(np.int64)[order]
        return pa.RecordBatch.from_pydict({"a": back[:-1][inner], "b": back[1:][inner]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last = 0, None  # last: block, head, part, other of the rows held at the end
        for batch in batches:
            value, *keys = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            keys = np.stack(keys, axis=1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(value)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                unit = tuple(keys[start])
                if last is not None and unit != last and (unit[0] != last[0] or unit[1] == last[1] or size >= 65536):
                    yield chains(held, last[0])
                    held, size = [], 0
                held.append(value[start:end])
                size, last = size + end - start, unit
        if held:
            yield chains(held, last[0])

    keys = ["block", "head", "part", "other"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, budget: int = 3, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document, linked at `budget` or fewer differing bits.

    component_id is the smallest doc_id that can be reached. Documents without words share the
    fingerprint zero and are linked like any others; rows that share an id keep a row each; a
    null id counts for nothing in the smallest id, which is null if there is no other; other
    columns are not looked at; no rows give no rows.
    """
    prints = stored(fingerprints(docs, shingle, id_column, text_column))
    firsts = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(links_within(firsts, budget)).withColumnRenamed("node", "fingerprint")
    grouped = firsts.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = stored(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = stored(grouped.join(smallest, "root").select("fingerprint", "component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


# Near copies by similarity. Texts that share four fifths of their shingles differ in about
# 15 of 100 bits, too many for one fingerprint. So a wide one is made: parts of it are the keys
# of several tries. Pairs found in any of these are compared by their sets of shingles.


@dataclass(frozen=True)
class Copies:
    """similarity: Jaccard similarity of the sets of word shingles from which texts are copies.
    tries: parts of `key_bits` bits that are joined within `budget` bits. By calculation a pair at
    similarity 0.8 is missed by all sixteen with a chance of 0.00006, or of 0.01 if it has but five
    shingles. bits: of the whole fingerprint, which only spares pairs that are far apart the exact
    comparison. nearest: partners with which each text is compared before the rest.
    """

    similarity: float = 0.8
    shingle: int = 5
    bits: int = 512
    tries: int = 16
    key_bits: int = 32
    budget: int = 4
    nearest: int = 3

    def share(self) -> float:
        """Share of bits that texts of equal size at `similarity` differ in on average; of other sizes, in fewer."""
        return float(np.arccos(2 * self.similarity / (1 + self.similarity)) / np.pi)

    def distance(self) -> int:
        """Bits that texts of equal size at `similarity` differ in on average."""
        return round(self.bits * self.share())

    def farthest(self) -> int:
        """Differing bits, five standard deviations above the mean, from which texts are not compared."""
        return int(np.ceil(self.bits * self.share() + 5 * np.sqrt(self.bits * self.share() * (1 - self.share()))))


def shingles(text: str | None, rule: Copies) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than a shingle make one, no words none."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - rule.shingle + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + rule.shingle]), 42) for i in range(n)), np.uint64, n))


def wide_simhash(hashed: np.ndarray, rule: Copies) -> bytes:
    """Fingerprint of `rule.bits` bits over a set of shingles; the empty set gives zeros."""
    seeds = np.arange(1, rule.bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(rule.bits, np.int64)
    for start in range(0, len(hashed), 255):  # so many bits still add up in a byte
        x = hashed[start : start + 255, None] ^ seeds
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashed)).tobytes()


def _product(a0, a1, b0, b1, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with i in a range of `a` and j in the range of `b` at its place, about `most` at a time."""
    length = (b1 - b0).astype(np.int64)
    owner = np.repeat(np.arange(len(a0)), a1 - a0)  # one row for each i
    first = np.arange(len(owner)) - np.repeat(np.cumsum(a1 - a0) - (a1 - a0), a1 - a0) + a0[owner]
    ends = np.cumsum(length[owner])
    start = 0
    while start < len(owner):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)))
        n = length[owner[start:stop]]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(first[start:stop], n), np.repeat(b0[owner[start:stop]], n) + offset
        start = stop


def met_pairs(keys: np.ndarray, label: np.ndarray, top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of nodes sorted by `keys` whose keys agree or are within `budget` bits.

    Ranges of equal keys that have one label throughout are left out, so a crowd of copies that
    hang together costs little more than its size.
    """
    only, first, count = np.unique(keys, return_index=True, return_counts=True)
    last = first + count
    low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
    many = low < high
    for i, j in _product(first[many], last[many], first[many], last[many]):
        yield i[i < j], j[i < j]
    for a, b in walk_pairs(only, top, budget):
        apart = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        a, b = a[apart], b[apart]
        yield from _product(first[a], last[a], first[b], last[b])


def copy_links(nodes: DataFrame, rule: Copies = Copies(), part_rows: int = PART_ROWS) -> DataFrame:
    """Candidate pairs (a, b, distance), a < b, of `nodes(node, wide)` whose fingerprints are near.

    wide: the fingerprint and the number of shingles in eight bytes. Each task gives a chain
    through the nodes that hang together in it. A node is shuffled once for each block of each trie,
    with its fingerprint alone, of which its key is a part.
    """
    farthest = rule.farthest()
    blocks = rule.budget + 1
    width, bytes_each = rule.key_bits // blocks, rule.key_bits // 8

    def keys_of(raw: np.ndarray, turn: int) -> np.ndarray:
        """Keys of one turn, a block of a trie: the trie's part of the fingerprints, turned so that the block is at the top."""
        trie, block = divmod(turn, blocks)
        key = raw[:, trie * bytes_each : (trie + 1) * bytes_each].copy().view(">u4").ravel().astype(np.uint64)
        by = np.uint64(block * width)
        return ((key << by) | (key >> (np.uint64(rule.key_bits) - by))) & np.uint64((1 << rule.key_bits) - 1)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, wide = batch.columns
            raw = np.frombuffer(b"".join(wide.to_pylist()), np.uint8).reshape(len(node), -1)
            for turn in range(rule.tries * blocks):
                head = (keys_of(raw, turn) >> np.uint64(rule.key_bits - width)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([node, wide, pa.array((turn << width) + head)], ["node", "wide", "unit"])

    rows = nodes.select("node", "wide").mapInArrow(turned, "node bigint, wide binary, unit bigint")
    # There are no more units than blocks of tries have values, so these are few whatever the input, and are sent to the rows.
    crowded = rows.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts")).filter("parts > 1")
    dealt = rows.join(F.broadcast(crowded), "unit", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = placed.select("node", "wide", "unit", F.least("part", "other").alias("part"), F.greatest("part", "other").alias("other"))

    def pairs(held: list[tuple[np.ndarray, ...]], turn: int) -> Iterator[pa.RecordBatch]:
        node, wide = (np.concatenate(x) for x in zip(*held))
        key = keys_of(wide.view(np.uint8), turn) << np.uint64(BITS - rule.key_bits)
        order = np.argsort(key, kind="stable")
        node, key, wide = node[order], key[order], wide[order]
        size = wide[:, -1].astype(np.float64)

        def far(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.bitwise_count(wide[i, :-1] ^ wide[j, :-1]).sum(1, dtype=np.int64)

        def near(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            apart = np.minimum(size[i], size[j]) >= rule.similarity * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[apart], j[apart]
            close = far(i, j) <= farthest
            return i[close], j[close]

        def rows(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            a, b = node[i], node[j]
            return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": far(i, j)})

        label = np.arange(len(key))
        for start in range(0, len(key), 1 << 18):  # neighbours first: they join most of what is alike
            i = np.arange(start, min(start + (1 << 18), len(key) - 1))
            label = merge(label, *near(label, i, i + 1))
        for i, j in met_pairs(key, label, width, rule.budget):
            label = merge(label, *near(label, i, j))
        at = np.argsort(label, kind="stable")
        inner = label[at][1:] == label[at][:-1]
        yield rows(at[:-1][inner], at[1:][inner])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, last = 0, None  # last: unit, part, other of the rows held at the end
        for batch in batches:
            node, *unit = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("node", "unit", "part", "other"))
            wide = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint64).reshape(len(node), -1)
            unit = np.stack(unit, axis=1)
            cuts = np.r_[0, np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1, len(node)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                here = tuple(unit[start])
                # Small units of one turn go together: their keys differ at the top, so they stay apart.
                if last is not None and here != last and (here[0] >> width != last[0] >> width or here[0] == last[0] or size >= 65536):
                    yield from pairs(held, int(last[0] >> width))
                    held, size = [], 0
                held.append((node[start:end], wide[start:end]))
                size, last = size + end - start, here
        if held:
            yield from pairs(held, int(last[0] >> width))

    keys = ["unit", "part", "other"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint, distance bigint")


def similar(pairs: DataFrame, sets: DataFrame, rule: Copies) -> DataFrame:
    """The pairs (a, b) whose sets of shingles, from `sets(node, grams)`, have a Jaccard similarity of `rule.similarity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for one, other in zip(batch.column(2), batch.column(3)):
                one, other = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, other))
                shared = len(np.intersect1d(one, other, assume_unique=True))
                alike.append(shared >= rule.similarity * (len(one) + len(other) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    joined = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("one")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("other")), "b")
    return joined.select("a", "b", "one", "other").mapInArrow(run, "a bigint, b bigint")


def exact_links(keyed: DataFrame, nodes: DataFrame, rule: Copies) -> DataFrame:
    """Links (a, b) that join all `nodes(node, at, wide)` that are copies, directly or by way of others.

    First each node is compared with its nearest candidates, which joins most of what is alike.
    All candidates of a node hang together in one cluster; what does not link yet is told
    apart there by its differences from the cluster's best linked node, so that no pairs are made of the
    near copies of one text. keyed: texts as `_at`, `_text`; only those of candidates are read into sets.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingles(text.as_py(), rule).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], ["node", "grams"])

    met = stored(copy_links(nodes, rule).distinct())
    ends = stored(met.select(F.col("a").alias("node")).union(met.select("b")).distinct())
    some = stored(nodes.join(ends, "node", "leftsemi"))
    texts = keyed.join(some.select("node", F.col("at").alias("_at")), "_at").select("node", "_text")
    sets = stored(texts.mapInArrow(read, "node bigint, grams binary").groupBy("node").agg(F.first("grams").alias("grams")))
    place = F.row_number().over(Window.partitionBy("b").orderBy("distance", "a"))
    links = stored(similar(met.withColumn("_place", place).filter(F.col("_place") <= rule.nearest), sets, rule))
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    label = components(links).select("node", F.col("root").alias("label"))
    clusters = components(met).withColumnRenamed("root", "cluster").join(label, "node", "left").join(degree, "node", "left")
    clusters = stored(clusters.select("node", "cluster", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree")))
    hub = F.min(F.struct(-F.col("degree"), "node"))["node"].alias("hub")
    apart = clusters.groupBy("cluster").agg(hub, F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    named = sets.withColumnRenamed("node", "name")
    size = F.floor(F.octet_length("grams") / 8).cast("bigint").alias("size")
    members = stored(clusters.join(apart, "cluster").withColumnRenamed("node", "name").join(named.select("name", size), "name").select("name", "size", "label", "cluster", "hub"))
    asked = stored(named.join(members, "name", "left_semi"))
    exact = Jaccard(words=rule.shingle, least=round(rule.similarity * 10_000), of=10_000)
    certain, close = links_in_clusters(members, asked, stored(lone_grams(asked)), exact)
    return links.union(certain).union(stored(similar(close, sets, rule)))


def one_of_each(docs: DataFrame, rule: Copies = Copies(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` without near copies: of each group that hangs together the row with the smallest id stays.

    Rows that agree in id and text are one group anyway. A null id is larger than all others; null
    and empty texts have no words and are copies of each other; columns may have any names; no rows give no rows. Texts are
    shuffled to meet the keys of the rows that stay, and those of candidates to be compared.
    """
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.coalesce(F.col("_text"), F.lit("")))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, same = [], []
            for text in batch.column(2):
                hashed = shingles(text.as_py(), rule)
                wide.append(wide_simhash(hashed, rule) + np.uint64(len(hashed)).tobytes())
                same.append(xxhash.xxh3_128_digest(hashed.tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(wide, pa.binary()), pa.array(same, pa.binary())], ["_id", "_at", "wide", "same"])

    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text")).select(F.col("_id").cast("long"), key.alias("_at"), "_text")
    prints = stored(rows.mapInArrow(sign, "_id bigint, _at binary, wide binary, same binary"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_at").alias("at"))
    nodes = prints.groupBy("same").agg(F.min(order).alias("first"), F.first("wide").alias("wide")).drop("same")
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = components(exact_links(rows, nodes.select("node", "first.at", "wide"), rule))
    grouped = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    repeated = prints.groupBy("_at").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    stays = stored(grouped.select("first.at").withColumnRenamed("at", "_at").join(repeated, "_at", "left"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text")).select("row", key.alias("_at"))
    found = keyed.join(stays.filter("_rows is null").select("_at"), "_at", "leftsemi")
    twice = stays.filter("_rows is not null").select("_at")
    if twice.isEmpty():
        return found.select("row.*")
    again = keyed.join(twice, "_at", "leftsemi").groupBy("_at").agg(F.first("row").alias("row"))
    return found.select("row.*").union(again.select("row.*"))
