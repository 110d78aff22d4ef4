"""Texts whose sets of word n-grams have a high Jaccard similarity: an exact join by pigeonhole.

Hashing deals the universe of n-grams out to segments, as many as the sizes in a band call for. Two sets
that are alike differ in few n-grams, so in most segments not at all and in some by one. A set looks up
its segments in an index of all sets' segments and of their neighbourhoods with one n-gram left out; it may
leave out a few, and leaves out those that would cost most. What meets is compared exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.llm.batches import stored
from brightloom.llm.components import components
from brightloom.llm.words import coded, grouped, id_and_text, split_words


@dataclass(frozen=True)
class Jaccard:
    """words: of an n-gram. of, least: two sets link if of * intersection >= least * union.

    band: the largest size of a band over the smallest (at least of / least, so that sets that link
    lie in one band or in neighbouring ones). spare: segments that any set may leave out, as a share
    of those it needs, 2 at least. neighbours: one of so many segments is also indexed with each of
    its n-grams left out. nearest, alike: in the first comparison a set meets so many of the sets it shares most segments
    with, if that is one of `alike` segments at least; this decides only how soon a link is found.
    """

    words: int = 4
    least: int = 85
    of: int = 100
    band: float = 1.4
    spare: float = 0.125
    neighbours: int = 32
    nearest: int = 2
    alike: int = 8

    def differing(self, size: int) -> int:
        """N-grams by which a set of this size and a larger one that links with it differ at most."""
        return size * (self.of - self.least) // self.least

    @cached_property
    def bands(self) -> list[int]:
        """The largest size of each band."""
        tops, low = [], 1
        while low < 1 << 31:
            tops.append(max(low * self.of // self.least, int(low * self.band)))
            low = tops[-1] + 1
        return tops

    def segments(self, band: int) -> int:
        needed = self.differing(self.bands[band])
        return needed + 1 + max(2, int(needed * self.spare))

    def both_ways(self, band: int) -> int:
        """Segments that are also indexed with one n-gram left out."""
        return max(1, self.segments(band) // self.neighbours)


MIX, STEP, BAND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], rule: Jaccard) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's different word n-grams, A-Z in lower case; of all its words if they are fewer; none without words."""
    words, starts = split_words([text and text.lower() for text in texts])
    codes, different = coded(words)
    hashed = np.fromiter((xxhash.xxh64_intdigest(word) for word in different), np.uint64, len(different))[codes]
    rolled = np.zeros(max(0, len(words) - rule.words + 1), np.uint64)
    for k in range(rule.words):
        rolled = mixed(rolled + hashed[k : len(rolled) + k])
    for first, last in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if last - first >= rule.words:
            yield np.unique(rolled[first : last - rule.words + 1])
        elif last > first:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(words[first:last]), 1)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def name_of(grams: np.ndarray) -> int:
    """A number for the set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), len(grams))).view(np.int64))


EXACT, LEFT_OUT = 0, 1
PLAIN = "tag & 3 = 2"  # in the own band, nothing left out


def segment_rows(grams: np.ndarray, rule: Jaccard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signature, tag) of the set's segments in its own band, and in the one below if sets of that band may link with it.

    tag: segment * 4, plus 2 in the own band, plus 1 with an n-gram left out.
    """
    size = len(grams)
    own = bisect_right(rule.bands, size - 1)
    spread, value = mixed(grams) >> np.uint64(32), mixed(grams + BAND)
    for band in (own, own - 1):
        if band < 0 or (band < own and size * rule.least > rule.bands[band] * rule.of):
            continue
        count = rule.segments(band)
        place = (spread * np.uint64(count)) >> np.uint64(32)
        total = np.zeros(count, np.uint64)
        np.add.at(total, place, value)
        salt = np.arange(1, count + 1, dtype=np.uint64) * MIX + np.uint64((band + 1) * int(BAND) & (2**64 - 1))
        mark = 2 if band == own else 0
        yield mixed(total + salt), np.arange(count, dtype=np.int64) * 4 + mark
        some = np.flatnonzero(place < np.uint64(rule.both_ways(band)))
        at = place[some]
        yield mixed(total[at] - value[some] + salt[at]), at.astype(np.int64) * 4 + (mark + LEFT_OUT)


def named_sets(docs: DataFrame, rule: Jaccard, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, at, n_shingles, name, segments, both_ways) of every row: `at` finds the row again, `name` is
    its set's, null without words; the last two are numbers of segments in the set's band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(2).to_pylist(), []
            for first, last in grouped(texts):
                for grams in shingle_sets(texts[first:last], rule):
                    band = bisect_right(rule.bands, len(grams) - 1)
                    rows.append((len(grams), name_of(grams) if len(grams) else None, rule.segments(band), rule.both_ways(band)))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "at", "n_shingles", "name", "segments", "both_ways"])

    rows = id_and_text(docs, id_column, text_column).select("_id", row_key().alias("_at"), "_text")
    ident = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {ident}, at bigint, n_shingles bigint, name bigint, segments bigint, both_ways bigint")


def row_key() -> Column:
    return F.xxhash64("_id", "_text")


def shared_segments(docs: DataFrame, rule: Jaccard, id_column: str, text_column: str) -> DataFrame:
    """(sig, name, size, tag) of all segments that different sets have.

    Each task hands a set on once, however many copies of it there are. One shuffle by signature; a
    signature has at most one row of each set, and sets have many, so no task gets a large part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in grouped(texts):
                sigs, tags, names, sizes, counts = [], [], [], [], []
                for grams in shingle_sets(texts[first:last], rule):
                    name = name_of(grams)
                    if not rule.differing(len(grams)) or name in seen:  # such a small set links with its copies alone
                        continue
                    seen.add(name)
                    before = len(sigs)
                    for sig, tag in segment_rows(grams, rule):
                        sigs.append(sig)
                        tags.append(tag)
                    names.append(name)
                    sizes.append(len(grams))
                    counts.append(sum(map(len, sigs[before:])))
                if sigs:
                    columns = [np.concatenate(sigs).view(np.int64), np.repeat(np.array(names, np.int64), counts), np.repeat(np.array(sizes, np.int64), counts), np.concatenate(tags)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sig", "name", "size", "tag"])

    rows = id_and_text(docs, id_column, text_column).mapInArrow(run, "sig bigint, name bigint, size bigint, tag bigint")
    same = Window.partitionBy("sig")
    found = rows.withColumn("least", F.min("name").over(same)).withColumn("most", F.max("name").over(same))
    return found.filter("least < most").drop("least", "most").distinct()


def read_sets(docs: DataFrame, sizes: DataFrame, names: DataFrame, rule: Jaccard, id_column: str, text_column: str) -> DataFrame:
    """(name, grams) of `names(name)`, read again from one row of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, last in grouped(texts):
                found = [(name_of(grams), grams.tobytes()) for grams in shingle_sets(texts[first:last], rule)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["name", "grams"])

    at = sizes.join(names, "name", "left_semi").select(F.col("at").alias("_at"))
    rows = id_and_text(docs, id_column, text_column).select("_text", row_key().alias("_at"))
    return rows.join(at, "_at", "left_semi").select("_text").mapInArrow(run, "name bigint, grams binary").groupBy("name").agg(F.first("grams").alias("grams"))


def linked(pairs: DataFrame, sets: DataFrame, rule: Jaccard) -> DataFrame:
    """The pairs (a, b) of names whose sets, from `sets(name, grams)`, link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3)):
                one, other = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, other))
                shared = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(rule.of * shared >= rule.least * (len(one) + len(other) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("name").alias("a"), F.col("grams").alias("one")), "a")
    joined = joined.join(sets.select(F.col("name").alias("b"), F.col("grams").alias("other")), "b")
    return joined.select("a", "b", "one", "other").mapInArrow(run, "a bigint, b bigint")


def lone_segments(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(name, segments, alone) of each set with shared segments: how many it has, and how many that no other has."""
    plain = shared.filter(PLAIN).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(plain, "name").select("name", "segments", (F.col("segments") - F.col("n")).alias("alone"))


def likely_pairs(shared: DataFrame, alone: DataFrame, rule: Jaccard) -> DataFrame:
    """(a, b) of each set b with the hubs that it shares most segments with.

    The hub of a segment is the set that has it and the fewest segments alone; among copies with
    edits that is the original, or the least edited one.
    """
    hub = F.min(F.struct("alone", "name")).over(Window.partitionBy("sig"))["name"]
    counts = shared.filter(PLAIN).join(alone, "name").withColumn("hub", hub).filter("hub <> name").groupBy("name", "hub", "segments").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "hub"))
    counts = counts.filter(F.col("n") * rule.alike >= F.col("segments")).withColumn("place", place)
    return counts.filter(F.col("place") <= rule.nearest).select(F.col("hub").alias("a"), F.col("name").alias("b"))


def cheapest_lookups(placed: DataFrame, sizes: DataFrame, rule: Jaccard) -> tuple[DataFrame, DataFrame]:
    """Lookups (sig, exact, name, label, size) that find all links between components, and the index rows
    (likewise) that they meet: `exact` says which rows of the index a lookup is for.

    A set may look up each of its `segments`, and each of `both_ways` with one n-gram left out on either
    side. It differs from a larger set that it links with in at most `differing` n-grams, so if of
    all these lookups it leaves out no more than there are beyond `differing + 1`, one still
    finds the other. A lookup costs the sets of other components that it meets; those that cost
    most are left out. Most meet none, cost nothing, and are no rows here.
    """
    exact, own = F.col("tag") % 2 == EXACT, F.col("tag").bitwiseAND(F.lit(2)).cast("boolean")
    segment = F.shiftright("tag", 2)
    count = lambda kind, *by: F.sum(kind.cast("long")).over(Window.partitionBy(*by))
    rows = placed.withColumn("plain", count(exact, "sig") - count(exact, "sig", "label")).withColumn("less", count(~exact, "sig") - count(~exact, "sig", "label"))
    rows = stored(rows.filter("plain + less > 0").withColumn("segment", segment).withColumn("exact", exact).withColumn("own", own))
    asking = rows.filter("own").join(sizes.select("name", "segments", "both_ways"), "name")
    plain = asking.filter("exact AND plain > 0").select("name", "segment", F.lit(True).alias("plainly"), F.col("plain").alias("cost"))
    # With one left out a lookup costs no less than without, so it is left out first.
    neighbours = asking.filter(F.col("segment") < F.col("both_ways")).groupBy("name", "segment")
    neighbours = neighbours.agg(
        F.greatest(F.sum(F.when(F.col("exact"), F.col("less")).otherwise(F.col("plain"))), F.max(F.when(F.col("exact"), F.col("plain")).otherwise(0))).alias("cost")
    )
    ways = plain.unionByName(neighbours.select("name", "segment", F.lit(False).alias("plainly"), "cost")).filter("cost > 0")
    differing = F.expr(f"n_shingles * {rule.of - rule.least} div {rule.least}")
    spare = sizes.select("name", (F.col("segments") + F.col("both_ways") - differing - 1).alias("spare"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("cost"), "plainly", "segment"))
    taken = ways.withColumn("place", place).join(spare, "name").filter("place > spare").select("name", "segment", "plainly")
    asked = rows.filter("own").join(taken, ["name", "segment"]).filter("exact OR NOT plainly")
    asked = stored(asked.select("sig", (F.col("exact") & F.col("plainly") | ~F.col("exact")).alias("exact"), "name", "label", "size"))
    met = rows.join(asked.select("sig", "exact").distinct(), ["sig", "exact"]).select("sig", "exact", "name", "label", "size")
    return asked, met


def lone_grams(sets: DataFrame) -> DataFrame:
    """(name, lone): how many n-grams of each of `sets(name, grams)` no other of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, grams in zip(batch.column(0), batch.column(1)):
                found = pa.Array.from_buffers(pa.int64(), len(grams.as_buffer()) // 8, [None, grams.as_buffer()])
                yield pa.RecordBatch.from_arrays([found, pa.repeat(name, len(found))], ["gram", "name"])

    rows = sets.select("name", "grams").mapInArrow(run, "gram bigint, name bigint")
    held = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).filter("n = 1")
    return held.groupBy("name").agg(F.count(F.lit(1)).alias("lone"))


def may_link(rule: Jaccard) -> Column:
    """Whether rows (name, label, size, shareable) and (a, label_a, size_a, shareable_a) of different
    components, the second the smaller, may link: the intersection has to be `least / (least + of)` of both sizes together."""
    both, least = rule.of + rule.least, rule.least
    apart = (F.col("label") != F.col("label_a")) & (F.struct("size_a", "a") < F.struct("size", "name"))
    return apart & (F.col("size") * least <= F.col("size_a") * rule.of) & (both * F.least("shareable", "shareable_a") >= least * (F.col("size") + F.col("size_a")))


def with_shareable(rows: DataFrame, lone: DataFrame, rule: Jaccard) -> DataFrame:
    """The rows (name, size, ...) with the number of their n-grams that some other set has, without those that have too few to link at all."""
    rows = rows.join(lone, "name", "left").withColumn("shareable", F.col("size") - F.coalesce("lone", F.lit(0))).drop("lone")
    return rows.filter(rule.of * F.col("shareable") >= rule.least * F.col("size"))


def as_smaller(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({name: f"{name}_a" for name in ("label", "size", "shareable", "place", "differ")} | {"name": "a"})


def candidate_pairs(asked: DataFrame, met: DataFrame, lone: DataFrame, rule: Jaccard) -> DataFrame:
    """(a, b) of different components that meet in a lookup and may link."""
    one = with_shareable(asked, lone, rule).filter((rule.of + rule.least) * F.col("shareable") >= 2 * rule.least * F.col("size"))
    pairs = as_smaller(one).join(with_shareable(met, lone, rule), ["sig", "exact"]).filter(may_link(rule))
    return pairs.select("a", F.col("name").alias("b")).distinct()


def links_in_clusters(members: DataFrame, grams: DataFrame, lone: DataFrame, rule: Jaccard) -> tuple[DataFrame, DataFrame]:
    """Links and candidates (a, b) that join all linked `members(name, size, label, cluster, hub)` of a cluster.

    Two sets differ by as much as their differences from the hub do. Those of one label hang
    together already. If the differences from the hub are small enough together, the sets link in any case; the set with
    least to spare is then a link's end for all of these. Otherwise the differences have an n-gram in common
    if the sets link, and one of the rarest `differing + 1` of either. Behind the first they have in
    common, in order of rarity, both have to hold enough for all they need; few unlinked pairs do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [np.setxor1d(*(np.frombuffer(x.as_buffer(), np.int64) for x in pair), assume_unique=True) for pair in zip(batch.column(5), batch.column(6))]
            ends = pa.array(np.cumsum([0, *map(len, apart)]), pa.int32())
            rows = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(apart) if apart else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], rows], ["name", "size", "label", "cluster", "shareable", "apart"])

    hubs = grams.select(F.col("name").alias("hub"), F.col("grams").alias("hub_grams"))
    rows = with_shareable(members, lone, rule).join(grams, "name").join(hubs, "hub")
    rows = rows.select("name", "size", "label", "cluster", "shareable", "grams", "hub_grams")
    rows = stored(rows.mapInArrow(run, "name bigint, size bigint, label bigint, cluster bigint, shareable bigint, apart array<bigint>"))
    over = ((rule.of + rule.least) * F.size("apart") - (rule.of - rule.least) * F.col("size")).alias("over")
    nearest = rows.groupBy("cluster").agg(F.min(F.struct(over, "name")).alias("best"))
    certain = rows.select("name", "cluster", over).join(nearest, "cluster").filter("name <> best.name AND over + best.over <= 0").select(F.col("best.name").alias("a"), F.col("name").alias("b"))
    each = rows.select("name", "size", "label", "cluster", "shareable", F.size("apart").alias("differ"), F.explode("apart").alias("gram"))
    each = each.join(each.groupBy("cluster", "gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["cluster", "gram"], "left")
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.coalesce("n", F.lit(1)), "gram"))
    first = each.withColumn("place", place).filter(F.expr(f"place <= 1 + size * {rule.of - rule.least} div {rule.least} AND n > 1"))
    first = stored(first.select("cluster", "gram", "name", "size", "label", "shareable", "differ", "place"))
    both, fewer = rule.of + rule.least, rule.of - rule.least
    common = 1 + F.least(F.col("differ") - F.col("place"), F.col("differ_a") - F.col("place_a"))
    enough = 2 * both * common >= both * (F.col("differ") + F.col("differ_a")) - fewer * (F.col("size") + F.col("size_a"))
    pairs = as_smaller(first).join(first, ["cluster", "gram"]).filter(may_link(rule) & enough)
    return certain, pairs.select("a", F.col("name").alias("b")).distinct()


def similar_groups(docs: DataFrame, rule: Jaccard = Jaccard(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the number of different n-grams of every whole text, and the smallest id
    that it hangs together with by links, itself included.

    Texts with equal sets are one from the start (sets are told apart by size and a 64-bit hash, as n-grams are). Each set
    is first compared with the hubs it shares most segments with, which joins most of what is
    alike. Sets around a hub that did not link are told apart by what they differ in from it; all others by
    the candidate pairs that the pigeonhole gives. So no pairs are made within a group of copies, few within one of near copies, and no link between groups is lost.

    A null or blank text has no n-grams, links with nothing and is its own component; rows with a null id
    hang together like others but give no component its id (null if there is no other); equal rows
    get equal results; no rows give no rows; other columns are not looked at.
    """
    sets = stored(named_sets(docs, rule, id_column, text_column))
    first = [F.first(c).alias(c) for c in ("n_shingles", "segments", "both_ways")]
    sizes = stored(sets.filter("name IS NOT NULL").groupBy("name").agg(*first, F.min("doc_id").alias("first"), F.min("at").alias("at")))
    shared = stored(shared_segments(docs, rule, id_column, text_column))

    def read(*names: DataFrame) -> DataFrame:
        wanted = names[0].union(names[1]).distinct()
        return stored(read_sets(docs, sizes, wanted, rule, id_column, text_column))

    def groups(links: DataFrame, name: str) -> DataFrame:
        return components(links).select(F.col("node").alias("name"), F.col("root").alias(name))

    alone = stored(lone_segments(shared, sizes))
    likely = stored(likely_pairs(shared, alone, rule))
    links = stored(linked(likely, read(likely.select(F.col("a").alias("name")), likely.select("b")), rule))
    clusters = stored(
        groups(likely, "cluster").join(groups(links, "label"), "name", "left").join(alone, "name").join(sizes.select("name", F.col("n_shingles").alias("size")), "name")
        .select("name", "size", "alone", "cluster", F.coalesce("label", "name").alias("label"))
    )
    mixed_ones = clusters.groupBy("cluster").agg(F.min(F.struct("alone", "name"))["name"].alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    members = stored(clusters.join(mixed_ones, "cluster").select("name", "size", "label", "cluster", "hub"))
    placed = shared.join(clusters.select("name", "cluster"), "name", "left").select("sig", "name", "size", "tag", F.coalesce("cluster", "name").alias("label"))
    asked, met = cheapest_lookups(placed, sizes, rule)
    met = stored(met)
    grams = read(members.select("name").union(asked.select("name")), met.select("name"))
    lone = stored(lone_grams(grams))
    certain, close = links_in_clusters(members, grams, lone, rule)
    pairs = close.union(candidate_pairs(asked, met, lone, rule))
    roots = groups(links.union(certain).union(stored(linked(pairs, grams, rule))), "root")
    label = F.coalesce("root", "name").alias("label")
    named = sizes.join(roots, "name", "left").select("name", "first", label)
    heads = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = stored(named.join(heads, "label").select("name", "component_id"))
    return sets.join(named, "name", "left").select("doc_id", "n_shingles", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
