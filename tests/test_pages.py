import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.functions.html import DropRules, decode_characters, scan_page
from brightloom.functions.packing import pack
from brightloom.operators import embed
from brightloom.operators import pages as P
from brightloom.session import cut_lineage, ensure_settings
from brightloom.sources import pages as SP

SITE_RULES = DropRules(classes=("references",), class_prefixes=("mw-editsection", "navbox"), ids=("tagged-pages-container",))

ARTICLE = """<html><head><title> The &amp; Title </title></head><body>
<nav><a href="/nav">nav</a></nav>
<h1 id="top">Top</h1><p>Intro <a href="/a">link&nbsp;a</a> text.</p>
<h2>Part<span class="mw-editsection">[edit]</span></h2><h3> </h3>
<ul><li><a href="/b">only link</a></li><li>plain item</li></ul>
<table class="navbox"><tr><td><a href="/hidden">x</a></td></tr></table>
<div role="navigation"><p>menu</p></div><ol class="x references"><li>ref</li></ol><div id="tagged-pages-container"><p>tags</p></div>
<h3>Deep</h3><table><tr><th>head</th><td>cell</td></tr></table>
<h2>Next</h2><p>outer <p>inner</p> lost</p><div>direct text</div>
<img src="/i.png" alt="A"><img src="/j.png"><img alt="none"><script>var x = "<p>no</p>";</script>
<footer><p>foot</p></footer></body></html>"""


def extracted(spark, html):
    df = spark.createDataFrame([("1", "s", "https://e.org/p", html)], "page_id string, source_id string, url string, html string")
    return cut_lineage(P.extract_pages(df, SITE_RULES))


def test_extraction(spark):
    page = extracted(spark, ARTICLE).collect()[0]
    assert page["html_title"] == "The & Title"
    assert [(s["ord"], s["level"], s["heading"], s["anchor"], s["heading_path"]) for s in page["sections"]] == [
        (0, 1, "Top", "top", "Top"),
        (1, 2, "Part", None, "Top > Part"),
        (2, 3, "Deep", None, "Top > Part > Deep"),
        (3, 2, "Next", None, "Top > Next"),
    ]
    assert [(b["heading_path"], b["text"]) for b in page["blocks"]] == [
        ("Top", "Intro link a text."),
        ("Top > Part", "plain item"),
        ("Top > Part > Deep", "head"),
        ("Top > Part > Deep", "cell"),
        ("Top > Next", "outer"),
        ("Top > Next", "inner"),
    ]
    assert [(x["href"], x["text"]) for x in page["links"]] == [("/a", "link a"), ("/b", "only link")]
    assert [(i["src"], i["alt"]) for i in page["images"]] == [("/i.png", "A"), ("/j.png", None)]


def test_extraction_of_nothing(spark):
    page = extracted(spark, "plain words, no markup").collect()[0]
    assert (page["html_title"], page["sections"], page["blocks"], page["links"]) == (None, [], [], [])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("&#39;&amp;&times;&#x2014;&deg;", "'&×—°"),
        ("&amp;#39;", "&#39;"),
        ("&dagger;&Dagger;", "†‡"),
        ("&bogus; &amp &AMP;", "&bogus; &amp &AMP;"),
        ("&#0; &#1114112; &#xD800;", "&#0; &#1114112; &#xD800;"),
        ("a & b", "a & b"),
    ],
)
def test_character_references(text, expected):
    assert decode_characters(text) == expected


def test_reference_without_semicolon_stays(spark):
    assert scan_page("<p>x &copy y &copy; z</p>")["blocks"][0]["text"] == "x &copy y © z"


def test_drop_rules_are_parameters():
    rules = DropRules(tags=(), classes=("ad",), class_prefixes=("x-",), ids=())
    found = scan_page("<nav><p>kept</p></nav><p class='ad'>a</p><p class='b x-1'>b</p>", rules)
    assert [b["text"] for b in found["blocks"]] == ["kept"]


def cleaned(spark, truncate=(), sections=(), blocks=()):
    html = "<h1>Guide</h1><p>one</p><h2>Promo</h2><p>two</p><h3>Tools</h3><p>three</p><h2>Body</h2><p>four</p><p>Ad placeholder</p><h2>Related Guides here</h2><p>five</p><h2>After</h2><p>six</p>"
    rules = spark.createDataFrame(
        [("s", list(truncate), list(sections), list(blocks))],
        "source_id string, truncate_after array<string>, drop_sections array<string>, drop_blocks array<string>",
    )
    page = P.clean_pages(extracted(spark, html), rules).collect()[0]
    return [b["text"] for b in page["blocks"]], [(s["ord"], s["heading"]) for s in page["sections"]]


def test_cleaning(spark):
    every = ["one", "two", "three", "four", "Ad placeholder", "five", "six"]
    assert cleaned(spark)[0] == every
    assert cleaned(spark, truncate=["related guides"])[0] == every[:5]
    assert cleaned(spark, truncate=["related guides"])[1] == [(0, "Guide"), (1, "Promo"), (2, "Tools"), (3, "Body")]
    texts, heads = cleaned(spark, sections=["PROMO"])
    assert texts == ["one", "four", "Ad placeholder", "five", "six"]
    assert heads == [(0, "Guide"), (3, "Body"), (4, "Related Guides here"), (5, "After")]
    assert cleaned(spark, blocks=["(?i)^ad placeholder$"])[0] == ["one", "two", "three", "four", "five", "six"]
    assert cleaned(spark, truncate=["guide"])[0] == []


def chunks_of(spark, blocks, max_chars, overlap):
    df = spark.createDataFrame([(blocks,)], f"blocks {P.BLOCKS_TYPE}")
    return [(c["heading_path"], c["text"]) for c in df.select(P.chunk_texts(F.col("blocks"), max_chars, overlap).alias("c")).collect()[0]["c"]]


def test_chunks_join_blocks_of_one_path(spark):
    assert chunks_of(spark, [("A", "x"), ("A", "y"), ("B", "z"), (None, "n"), (None, " "), ("A", "w")], 100, 10) == [
        ("A", "x\n\ny"), ("B", "z"), (None, "n"), ("A", "w")
    ]


def test_chunks_carry_overlap_and_cut_long_blocks(spark):
    a, b = "a" * 80, "b" * 80
    assert chunks_of(spark, [("A", a), ("A", b)], 100, 20) == [("A", a), ("A", "a" * 18 + "\n\n" + b)]
    long = "".join(chr(97 + i % 26) for i in range(250))
    got = [text for _, text in chunks_of(spark, [("A", long)], 100, 20)]
    assert got == [long[0:100], long[80:180], long[160:250]]
    assert chunks_of(spark, [("A", a), ("A", b)], 100, 0) == [("A", a), ("A", b)]


def test_chunk_limits_hold(spark):
    chance = random.Random(5)
    blocks = [(chance.choice("AB"), " ".join("w" * chance.randint(1, 9) for _ in range(chance.randint(1, 60)))) for _ in range(60)]
    got = chunks_of(spark, blocks, 120, 30)
    assert all(0 < len(text) <= 120 for _, text in got)
    joined = " ".join(text for _, text in got)
    assert all(word in joined for _, text in blocks for word in text.split())


def packed_one_by_one(blocks, max_chars, overlap):
    """The contract of packing with whole strings, block by block."""
    chunks, waiting, tail, path = [], "", "", None

    def emit(text):
        nonlocal tail
        text = text.strip()
        if text:
            chunks.append({"heading_path": path, "text": text})
            tail = text[-overlap:] if overlap else ""

    for own_path, text in blocks:
        text = (text or "").strip()
        if not text:
            continue
        if own_path != path:
            emit(waiting)
            waiting, tail, path = "", "", own_path
        if waiting and len(waiting) + 2 + len(text) > max_chars:
            emit(waiting)
            waiting = ""
        if len(text) > max_chars:
            start = 0
            while True:
                emit(text[start : start + max_chars])
                if start + max_chars >= len(text):
                    break
                start += max(1, max_chars - overlap)
        elif waiting:
            waiting += "\n\n" + text
        else:
            room = max_chars - 2 - len(text)
            waiting = tail[-room:] + "\n\n" + text if tail and room > 0 else text
    emit(waiting)
    return chunks


def test_packing_equals_a_plain_loop():
    chance = random.Random(11)
    for _ in range(4000):
        blocks = [
            (chance.choice([None, "A", "B"]) if chance.random() < 0.2 else "A", "".join(chance.choices("abé \n", k=chance.randint(0, 40))))
            for _ in range(chance.randint(0, 12))
        ]
        max_chars = chance.randint(1, 30)
        overlap = chance.randint(0, max_chars - 1)
        assert pack(blocks, max_chars, overlap) == packed_one_by_one(blocks, max_chars, overlap)


def test_packing_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [(None, None), ("A", "x")])], f"id int, blocks {P.BLOCKS_TYPE}")
    got = {r["id"]: r["c"] for r in df.select("id", P.chunk_texts(F.col("blocks")).alias("c")).collect()}
    assert got[1] is None and got[2] == [] and [tuple(c) for c in got[3]] == [("A", "x")]


def test_spans_of_odd_markup():
    assert scan_page("<p>a<p>b<title>t</title>c</p>")["blocks"][0]["text"] == "a"
    assert scan_page("<title>a <b>c</title>")["title"] == "a <b>c"
    assert scan_page("<h1>x<p>y</p>z</h1>")["headings"] == []
    crossed = scan_page("<p>ab <a href='/x'>cd</p>ef</a><a href='/y'><h2>gh</h2></a>")
    assert crossed["links"] == [{"href": "/x", "text": "cd"}, {"href": "/y", "text": ""}]
    assert (crossed["blocks"][0]["raw_chars"], crossed["blocks"][0]["link_chars"]) == (5, 2)
    assert scan_page("<p title='a > b' title=c>kept</p><!-- <p>no</p> --><p>cut <a href=")["blocks"] == [
        {"tag": "p", "text": "kept", "raw_chars": 4, "link_chars": 0, "headings_before": 0}
    ]
    assert scan_page("<nav><p>a</nav><p>b</p><script>'<p>no</p>'</script><li>c</li>")["blocks"][1]["text"] == "c"


@pytest.mark.parametrize("unit", ["<p>", "</p>", "<a", "<p x='", "<!--", "<script>", "<nav>", "<p>a</b>"])
def test_scan_is_linear(unit):
    started = time.process_time()
    scan_page(unit * (1_000_000 // len(unit)))
    assert time.process_time() - started < 20


@pytest.mark.parametrize("max_chars, overlap", [(0, 0), (10, 10), (10, -1)])
def test_chunk_options(max_chars, overlap):
    with pytest.raises(ValueError):
        P.check_chunk_options(max_chars, overlap)


def test_markdown_heads_only_where_the_path_changes(spark):
    df = spark.createDataFrame([("T", [(None, "0"), ("A", "1"), ("A", "2"), (None, "3"), ("A", "4")])], f"title string, blocks {P.BLOCKS_TYPE}")
    got = df.select(P.markdown(F.col("title"), F.col("blocks")).alias("m")).collect()[0]["m"]
    assert got == "# T\n\n0\n\n## A\n\n1\n\n2\n\n3\n\n## A\n\n4"


def reference_vector(text, dims):
    """One text at a time with plain integers."""
    state = 0x811C9DC5
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        state = ((state ^ (raw[i] | raw[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    values = []
    for _ in range(dims):
        state = (state + 0x9E3779B9) & 0xFFFFFFFF
        z = state
        z = ((z ^ (z >> 16)) * 0x21F0AAAD) & 0xFFFFFFFF
        z = ((z ^ (z >> 15)) * 0x735A2D97) & 0xFFFFFFFF
        z ^= z >> 15
        values.append(z / 0xFFFFFFFF * 2 - 1)
    norm = sum(v * v for v in values) ** 0.5
    return [v / norm for v in values]


def test_hash_embedding(spark):
    texts = ["", "a", "ab", "Grüße 😀", "x" * 500, "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(embed.embedding(F.col("t"), batch=2)).collect()]
    for text, vector in zip(texts, got):
        assert vector == pytest.approx(reference_vector(text, 768), abs=1e-6)
        assert sum(v * v for v in vector) == pytest.approx(1.0, abs=1e-5)


def test_embedder_of_another_shape_fails(spark):
    import numpy as np

    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="embedder returned shape"):
        df.select(embed.embedding(F.col("t"), lambda texts: np.zeros((1, 4)), dims=4)).collect()


def test_own_embedder(spark):
    import numpy as np

    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    got = [r[0] for r in df.select(embed.embedding(F.col("t"), lambda texts: np.array([[len(t), 1.0] for t in texts]), dims=2)).collect()]
    assert sorted(got) == [[1.0, 1.0], [2.0, 1.0]]


def test_titles_lose_the_suffix_of_their_source(spark):
    """Thousands of patterns are rows of a join, not branches of one expression."""
    many = [(f"s{i}", f"type{i % 3}", rf" - Site {i}$" if i % 2 else None) for i in range(5000)]
    catalogue = spark.createDataFrame(many, "source_id string, default_page_type string, title_suffix string")
    crawled = [("s1", "Fox - Site 1"), ("s1", " - Site 1"), ("s2", "Fox - Site 2"), ("s4999", "Fox - Site 4999 "), ("s4999", None), ("none", "x"), (None, "x")]
    crawled = spark.createDataFrame([(s, f"https://x/{i}", "", title) for i, (s, title) in enumerate(crawled)], "source_id string, url string, html string, title string")
    start = time.perf_counter()
    done = SP.page_requests(crawled, catalogue)
    done._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - start < 10
    got = {r["url"][-1]: (r["title"], r["page_type"]) for r in done.collect()}
    assert got == {"0": ("Fox", "type1"), "1": (None, "type1"), "2": ("Fox - Site 2", "type2"), "3": ("Fox - Site 4999", "type1"), "4": (None, "type1")}


def test_batches_for_python_are_bounded_by_bytes(spark):
    """By rows alone the 24 MB would be one batch, and pages or vectors gigabytes."""
    ensure_settings(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 8000).alias("text"))
    found = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) >= 24_000_000 and max(found) < 5_000_000


def test_seeds_of_a_long_text_take_little_memory():
    texts = ["a" * 1_000_000, *(f"t{i}" for i in range(99))]
    tracemalloc.start()
    seeds = embed.text_seeds(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
    assert seeds.tolist() == [int(embed.text_seeds([text])[0]) for text in texts]
    assert embed.text_seeds([]).tolist() == [] and embed.text_seeds(["", "a"])[0] == embed.FNV_OFFSET
