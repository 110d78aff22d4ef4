"""The Jaccard join against brute force."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from brightloom.llm import queries
from brightloom.llm.jaccard import Jaccard, candidate_pairs, cheapest_lookups, lone_grams, named_sets, read_sets, segment_rows, shared_segments, shingle_sets, similar_groups
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=4):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def alike(a, b, least=85, of=100):
    return bool(a) and bool(b) and of * len(a & b) >= least * len(a | b)


def brute(rows, least=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if alike(sets[i], sets[j], least):
            root[find(i)] = find(j)
    groups = {}
    for i, (ident, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(ident)
    first = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((ident, len(s), first[find(i)]) for i, ((ident, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], ["new" + str(rng.random())], [words[at], "more" + str(rng.random())]])
    return words


def corpus(seed):
    """Chains of edits around the threshold, a passage in many texts, short texts, copies, odd rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice("river stone cloud paper green letter window garden".split()) + str(rng.randint(0, 60))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(14):
        base = [word() for _ in range(rng.choice([4, 6, 9, 12, 20, 40, 120, 300]))]
        for _ in range(6):
            texts.append(" ".join(base))
            base = edited(rng, base, max(0, round(len(base) * rng.choice([0, 0.01, 0.018, 0.02, 0.022, 0.03]))))
    for _ in range(30):
        texts.append(" ".join([word() for _ in range(rng.randint(0, 60))] + passage + [word() for _ in range(rng.randint(0, 8))]))
    texts += ["", None, " \n", "a b", "A B", "a b c d", "a b c d e", "X " * 500, "x " * 700, "é É a\x1cb", "q" * 200_000]
    rng.shuffle(texts)
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, rows[5][1]), (None, "alone in the world we are"), (7, rows[9][1]), (8, rows[11][1])]


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = corpus(seed)
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_jaccard(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("rule", [Jaccard(least=70, spare=0, neighbours=2), Jaccard(least=80, band=2.0, neighbours=1)])
def test_other_rules_equal_brute_force(spark, rule):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in similar_groups(docs, rule).collect()), key=str) == brute(rows, rule.least)


@pytest.mark.parametrize("rule", [Jaccard(), Jaccard(least=70, spare=0, neighbours=2)])
def test_pigeonhole_alone_finds_every_link(spark, rule):
    """No set is joined beforehand, so every link has to come from the lookups that are left."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus(4)) if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = named_sets(docs, rule, "doc_id", "text")
    sizes = sets.filter("name is not null").groupBy("name").agg(*[F.first(c).alias(c) for c in ("n_shingles", "segments", "both_ways", "at")])
    placed = shared_segments(docs, rule, "doc_id", "text").withColumn("label", F.col("name"))
    asked, met = cheapest_lookups(placed, sizes, rule)
    lone = lone_grams(read_sets(docs, sizes, asked.select("name").union(met.select("name")).distinct(), rule, "doc_id", "text"))
    found = {frozenset(r) for r in candidate_pairs(asked, met, lone, rule).collect()}
    names = {r.doc_id: r.name for r in sets.collect()}
    grams = {i: shingles(t) for i, t in rows}
    links = {frozenset((names[i], names[j])) for i, j in itertools.combinations(grams, 2) if names[i] != names[j] and alike(grams[i], grams[j], rule.least)}
    assert links and links <= found


def test_crowd_around_a_hub(spark):
    """Hundreds of edited copies of one text, the original among them or not, many just below the threshold."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 40)}x{i % 50}" for i in range(150)]
    for first in (0, 1):
        rows = [(i, " ".join(edited(rng, base, first + i % 5))) for i in range(160)]
        got = similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        want = brute(rows)
        assert sorted((tuple(r) for r in got), key=str) == want and 10 < len({r[2] for r in want}) < 150


def test_segments_differ_no_more_than_sets():
    """Equal segments have equal signatures, and one n-gram more or less meets in the neighbourhood."""
    rule = Jaccard(neighbours=1)
    one, more = shingle_sets([b" ".join(b"w%d" % i for i in range(n)) for n in (200, 201)], rule)
    plain, near = ({tag // 4: set() for _, tags in segment_rows(one, rule) for tag in tags.tolist()} for _ in range(2))
    index = []
    for grams in (one, more):
        index.append([dict(), dict()])
        for sigs, tags in segment_rows(grams, rule):
            for sig, tag in zip(sigs.tolist(), tags.tolist()):
                if tag & 2:
                    index[-1][tag & 1].setdefault(tag // 4, set()).add(sig)
    differ = [k for k in index[0][0] if index[0][0][k] != index[1][0][k]]
    assert len(differ) == 1 and index[0][0][differ[0]] <= index[1][1][differ[0]]


def test_names_and_empty_tables(spark):
    names = ["name", "size", "a.b", "tag", "text", "doc_id", "label"]
    docs = spark.createDataFrame([(1, 2, 5, 3, "one two three four five", 9, 4)], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    assert [tuple(r) for r in similar_groups(docs).collect()] == [(9, 2, 9)]
    assert [tuple(r) for r in similar_groups(docs, id_column="a.b").collect()] == [(5, 2, 5)]
    assert similar_groups(docs.limit(0)).count() == 0
