"""Periodic runs and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import queries
from brightloom.llm.periodic import Runs, find_runs, periodic_runs
from brightloom.llm.spelling import Spelling, count_words, near_words, spelling_variants
from brightloom.llm.words import coded, grouped, split_words


def brute_runs(words, least=24, repeats=3):
    """Every maximal run, by trying all periods from the smallest."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                if not any(s <= i and i + (j + q - i) <= s + size and q % p == 0 for (s, size), p in found.items()):
                    found[(i, j + q - i)] = q
            i = max(j, i + 1)
    return sorted((s, size, q) for (s, size), q in found.items())


def loops(rng):
    words = []
    for _ in range(rng.randint(0, 4)):
        block = [rng.choice("ab" if rng.random() < 0.5 else "abcdefghij") for _ in range(rng.randint(1, 30))]
        words += block * rng.randint(1, 8) + block[: rng.randint(0, len(block))]
        words += [str(rng.random()) for _ in range(rng.randint(0, 10))]
    return words


def test_runs_are_all_runs():
    rng = random.Random(1)
    texts = [loops(rng) for _ in range(400)] + [[], ["a"], ["a"] * 24, ["a"] * 23, list("ab") * 500, [str(i % 300) for i in range(2000)]]
    words, starts = split_words([" ".join(w).encode() for w in texts])
    for rule in (Runs(), Runs(6, 4)):
        begin, length, period = find_runs(coded(words)[0], starts, rule)
        for k, text in enumerate(texts):
            inside = (begin >= starts[k]) & (begin < starts[k + 1])
            got = list(zip((begin[inside] - starts[k]).tolist(), length[inside].tolist(), period[inside].tolist()))
            assert got == brute_runs(text, rule.length, rule.repeats), text


def test_wide_names_are_sorted_alike(monkeypatch):
    from brightloom.llm import periodic

    words, starts = split_words([" ".join(loops(random.Random(k))).encode() for k in range(50)])
    plain = find_runs(coded(words)[0], starts)
    narrow = periodic.in_order
    monkeypatch.setattr(periodic, "in_order", lambda a, b, places, size: narrow(a, b, places, 1 << 40))
    for x, y in zip(plain, find_runs(coded(words)[0], starts)):
        assert np.array_equal(x, y)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def looped(ident, text):
    """The words of a document as the query sees them."""
    words, code = re.findall("[^\x20\x09-\x0d]+", text or ""), zlib.crc32(str(ident).encode())
    n, g = len(words), code // 10
    if ident is None or code % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(ident, text):
    words = looped(ident, text)
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (
        ident, len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def written(spark, folder, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    frame.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "\n", "\x0b ", "  "]).join(loops(rng))) for i in range(150)]
    rows += [(i, " ".join(rng.choice("abcdef") + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 300)))) for i in range(150, 260)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "a b\x1cc " * 40), (None, "a b " * 30), (4, "x y z " * 9), (4, "x y z " * 9), (305, "w " * 3000), (306, "x" * 300_000)]
    got = sorted((tuple(r) for r in queries.op13_periodic(spark, written(spark, tmp_path, rows)).collect()), key=str)
    assert got == sorted((digests(i, t) for i, t in rows), key=str)
    assert sum(r[2] > 0 for r in got) > 40


def test_periodic_names_and_empty_tables(spark):
    names = ["runs", "collapsed", "a.b", "doc_id", "text", "n_words"]
    docs = spark.createDataFrame([(1, 2, 3, 7, "a b " * 20, 5)], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    row = periodic_runs(docs).first()
    assert (row.doc_id, row.n_words, row.collapsed) == (7, 40, "a b") and [tuple(r) for r in row.runs] == [(0, 40, 2)]
    assert periodic_runs(docs.withColumnRenamed("doc_id", "x.id"), id_column="x.id").count() == 1
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Runs(10, 2)


def test_groups_of_texts_hold_all():
    texts = [b"x" * n for n in (0, 5, 9, 30, 0, 2, 2)] + [None]
    ranges = list(grouped(texts, 10))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(8)) and len(ranges) > 2
    assert list(grouped([])) == []


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, letters=7, least=2, ratio=10):
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(rows)


def variants_of(rng, base, n):
    word = list(base)
    for _ in range(n):
        at = rng.randrange(len(word) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            word.insert(at, rng.choice("abé"))
        elif at < len(word):
            word[at : at + 1] = [rng.choice("abc")] if kind == 1 else []
    return "".join(word)


@pytest.mark.parametrize("block", [4096, 5])
def test_variants_are_all_variants(spark, block):
    rng = random.Random(block)
    bases = ["aaaaaaa", "abababab", "riverside", "überfluß", "cathedralx", "aaaaaaaaaa"]
    counts = Counter()
    for _ in range(700):
        counts[variants_of(rng, rng.choice(bases), rng.choice([0, 1, 1, 2, 3]))] = rng.choice([1, 2, 3, 30, 31, 400, 5000])
    counts |= Counter({w: 100_000 for w in bases})
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rule = Spelling(block=block)
    assert sorted(tuple(r) for r in spelling_variants(words, rule).collect()) == brute_variants(counts)
    rows = near_words(words.filter("n > 1 and char_length(word) > 6"), rule).collect()
    assert len(rows) == len({r.word for r in rows})


def test_spelling_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["Riverside", "windmills", "GARDENING", "überfluß", "Éclairage", "short", "naïveté×÷", "mountain", "mountains"]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "1", "ß", "Ÿ"]) for _ in range(rng.randint(0, 120)))) for i in range(200)]
    rows += [(500, None), (501, ""), (None, "windmills Riverside"), (7, rows[7][1]), (502, "y" * 100_000 + " " + "y" * 100_000)]
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            code = zlib.crc32(f"{ident}:{run}".encode())
            if ident is not None and code % 31 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += 1
    got = sorted(tuple(r) for r in queries.op12_spelling(spark, written(spark, tmp_path, rows)).collect())
    assert got == brute_variants(counts) and any(r[1] for r in got)


def test_spelling_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Windmill windmill", 1, 2)], "`a.b` long, text string, word long, n long")
    assert [tuple(r) for r in count_words(docs, id_column="a.b").collect()] == [("windmill", 2)]
    assert count_words(docs.limit(0), id_column="a.b").count() == 0
    assert spelling_variants(count_words(docs.limit(0), id_column="a.b")).count() == 0
    many = count_words(docs.union(docs), Spelling(counted=0), id_column="a.b")
    assert [tuple(r) for r in many.collect()] == [("windmill", 4)]
    nulls = spark.createDataFrame([(None, 5, 1), ("windmill", None, 1), ("windmills", 5, 1)], "word string, n long, short long")
    assert [tuple(r) for r in spelling_variants(nulls).collect()] == [("windmills", None, "windmills", 5, 0, None)]
