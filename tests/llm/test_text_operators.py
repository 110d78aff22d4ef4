"""The training-text operators against brute force, with nulls, empty and repeated rows."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from collections import Counter
from pyspark.sql import functions as F

from brightloom.llm import queries
from brightloom.llm.decontamination import Leaks, find_leaks, without_leaks
from brightloom.llm.main_text import Labelling, Weights, extract, fit_weights, main_text, minimum_cut
from brightloom.llm.pieces import encode_pieces
from brightloom.llm.pii import find_personal_data, sanitise
from brightloom.llm.quality import compression_bands, counts
from brightloom.llm.repeats import remove_repeats
from brightloom.llm.resampling import Grams, Resampling, draw, kth_largest, sampled, weigh
from brightloom.llm.secrets import scan_secrets
from brightloom.llm.simhash import Copies, copy_links, near_duplicates, one_of_each, shingles, simhash, walk_pairs, wide_simhash
from brightloom.llm.warc import build_index, keyed, look_up, read_records, url_key, write_archives

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone cloud paper green letter window garden silver train music answer winter corner bridge market".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "er"]) for _ in range(n))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a repeated row, a null id, a long text."""
    rows = [(1, None), (2, ""), (3, "   \n"), (4, prose(1, 60)), (4, prose(1, 60)), (None, prose(2, 60)), (5, "x" * 200_000), (6, None)]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_odd_rows_keep_a_row_each(spark, odd, nothing):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    source = F.col("source")
    for run in (compression_bands, near_duplicates, remove_repeats, find_personal_data, lambda d: scan_secrets(d, source, source), lambda d: encode_pieces(d, vocabulary)):
        assert sorted((r.doc_id for r in run(odd).select("doc_id").collect()), key=str) == sorted([1, 2, 3, 4, 4, None, 5, 6], key=str)
        assert run(nothing).count() == 0


def test_counts_of_quality(spark):
    assert counts("a b\nc # $\n\na b\n") == (7, 7, 2, 1, 0)
    text = " ".join(["one two three four five six"] * 2)
    assert counts(text)[4] == 12
    for text in (prose(3, 80), "ab " * 50, "x", ""):
        words = text.split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        held = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
        assert counts(text)[4] == len(held)


def test_bands_reject_repetition(spark):
    rows = compression_bands(frame(spark, [prose(4, 200), "buy now " * 200, prose(5, 300)])).collect()
    assert not next(r for r in rows if r.doc_id == 1).kept


def test_trie_pairs_are_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) for b in range(0, 64, 7)] + [base]))
    found = {pair for i, j in walk_pairs(keys, 0, 3) for pair in zip(i.tolist(), j.tolist())}
    assert found == {(i, j) for i, j in itertools.combinations(range(len(keys)), 2) if bin(int(keys[i] ^ keys[j])).count("1") <= 3}


def test_simhash_by_definition():
    text = "One two THREE four two three"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    assert simhash(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert simhash(None) == simhash(" ") == 0


def test_near_duplicates_by_brute_force(spark):
    texts = [prose(i, 400) for i in range(12)]
    texts += [t.replace(t.split()[200], "else", 1) for t in texts[:6]] + [texts[0], "", None]
    found = {r.doc_id: r for r in near_duplicates(frame(spark, texts)).collect()}
    prints = [simhash(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                root[a] = root[b] = min(root[a], root[b])
    assert [found[i].component_id for i in range(len(texts))] == root


def test_copy_links_shuffle_each_fingerprint_once_for_a_block(spark):
    """The rows of a fingerprint meet the list of crowded units without a shuffle of their own, and units in parts give the same clusters."""
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(80)] for _ in range(12)]
    texts = [" ".join(words[: 80 - k]) for words in base for k in range(4)]
    prints = []
    for node, text in enumerate(texts):
        hashed = shingles(text, Copies())
        prints.append((node, bytearray(wide_simhash(hashed, Copies()) + np.uint64(len(hashed)).tobytes())))
    nodes = spark.createDataFrame(prints, "node bigint, wide binary")
    found = []
    for part_rows in (3, 50_000):
        links = copy_links(nodes, Copies(), part_rows)
        plan = links._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 2  # of the rows, and of their counts
        label = list(range(len(texts)))
        for r in links.collect():
            a, b = label[r.a], label[r.b]
            label = [min(a, b) if x in (a, b) else x for x in label]
        found.append(label)
    assert found[0] == found[1] == [node // 4 * 4 for node in range(len(texts))]


def test_one_of_each_keeps_the_smallest(spark, odd, nothing):
    texts = [prose(i, 300) for i in range(20)]
    near = [" ".join(w if k % 60 else "changed" for k, w in enumerate(t.split())) for t in texts[:10]]
    kept = {r.doc_id for r in one_of_each(frame(spark, texts + near + texts[:3])).collect()}
    assert kept == set(range(20))
    rows = one_of_each(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "4", "5", "None"]
    assert one_of_each(odd).columns == odd.columns and one_of_each(nothing).count() == 0
    assert Copies().distance() == 78


def test_copies_at_the_similarity_by_brute_force(spark):
    rng = random.Random(3)
    words = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    texts, wanted = [], set()
    for shared, union in ((156, 200), (158, 200), (160, 200), (164, 200), (170, 200), (8, 10)):
        for _ in range(40):  # pairs at 0.78, 0.79, 0.80, 0.82, 0.85, and short ones at 0.80
            both, own = words(shared + 4), (union - shared) // 2
            pair = [" ".join(both + words(own)) for _ in range(2)]
            one, other = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in pair)
            assert len(one & other) == shared and len(one | other) == union
            wanted |= {len(texts)} | ({len(texts) + 1} if 5 * shared < 4 * union else set())
            texts += pair
    kept = {r.doc_id for r in one_of_each(frame(spark, texts)).select("doc_id").collect()}
    assert wanted <= kept  # below the similarity no text goes
    assert len(kept - wanted) <= 2  # of 160 copies at or above it


PAGES = "page_id long, url string, html string, offset long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*row, 7) for row in rows], PAGES)


def read_back(spark, pages, **options):
    folder, captures = write_archives(pages, **options)
    index = build_index(captures)
    return index, read_records(folder, look_up(index, keyed(pages)))


def test_warc_round_trip(spark):
    rows = [(i, f"http://h{i % 3}.example.org/p?q={i}", f"<p>text {i % 7} é\r\n\r\n{'z' * (i % 5) * 1000}</p>") for i in range(200)]
    rows += [(900, None, None), (901, "not a url\n", ""), (None, "http://x.example/", "<p>lone</p>"), (902, "http://[bad", "<p>lone</p>")]
    rows += [rows[0], (903, rows[0][1], "other")]
    _, records = read_back(spark, pages_of(spark, rows))
    found = sorted(((r.page_id, r.payload_bytes, r.payload, r.record_type, r.refers_to) for r in records.collect()), key=str)
    first = {}
    for page, _, text in rows:
        if page is not None:
            first[text or ""] = min(first.get(text or "", page), page)
    want = []
    for page, _, text in rows:
        text = text or ""
        response = first.get(text, page) == page
        want.append((page, len(text.encode()), text if response else None, "response" if response else "revisit", None if response else first[text]))
    assert found == sorted(want, key=str)


def test_warc_least_bytes_and_index(spark):
    from brightloom.llm.warc import Archiving

    rows = [(i, f"http://www.Site{i % 4}.example/{i % 10}", "same" if i % 2 else "longer payload") for i in range(100)]
    pages = pages_of(spark, rows)
    folder, captures = write_archives(pages, least_bytes=10)
    records = read_records(folder, captures)
    assert {r.page_id: r.record_type for r in records.collect()} == {i: "revisit" if i % 2 == 0 and i else "response" for i in range(100)}
    index = build_index(captures, Archiving(block_lines=3))
    assert len(index.directory) > 30
    asked = spark.createDataFrame([(url_key("https://site1.example/5"),), (url_key("http://none.example/"),), (None,)], "url_key string")
    assert sorted(r.page_id for r in look_up(index, asked).collect()) == [i for i in range(100) if i % 4 == 1 and i % 10 == 5]
    nobody = build_index(write_archives(pages.limit(0))[1])
    assert nobody.directory == [] and look_up(nobody, asked).count() == 0


def test_url_keys():
    assert url_key("https://www.Docs.example.org:443/a?b=1#c") == "org,example,docs)/a?b=1" == url_key("http://docs.example.org/a?b=1")
    assert url_key("http://u:p@a.b:8080") == "b,a:8080)/"
    assert url_key(None) == "" and len(url_key("http://a.b/" + "x" * 5000)) == 1024


def energy(gains, edges, kept):
    return sum(max(g, 0) * (not k) + max(-g, 0) * k for g, k in zip(gains, kept)) + sum(c for (a, b), c in edges.items() if kept[a] != kept[b])


def test_minimum_cut_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 7)
        gains = [rng.choice([rng.uniform(-2, 2), 0.0]) for _ in range(n)]
        edges = {(a, b): rng.uniform(0, 1.5) for a in range(n) for b in range(a) if rng.random() < 0.6}
        best = min(energy(gains, edges, kept) for kept in itertools.product([False, True], repeat=n))
        assert energy(gains, edges, minimum_cut(gains, edges)) == pytest.approx(best)


SHAPES = [
    ("<p>x<b>y</b>z &lt;i&gt; <!-- c -->w</p><div class='comments'><p>A comment that is fairly long and has many words in it.</p></div>", "xyz <i> w"),
    ("<body class='has-sidebar'><header>Site</header><article><header><h1>T</h1></header><p>Para one.<p>Two<ul><li>a<li>b</ul><aside>x</aside></article>", "T Para one. Two a b"),
    ("<main><p>It is <span class='ad'>buy</span> fine &amp; good&#33;</p><script>if(a<b){}</script><p>second</main><footer>c</footer>", "It is fine & good! second"),
    ("<div><p>long text with more than eight words in one line</p></div><div id=cookie-notice>We use cookies</div><nav><a href=/>home</a></nav>", "long text with more than eight words in one line"),
    ("a < b and c > d", "a < b and c > d"),
    ("", ""),
    (None, ""),
]


def test_main_text_of_shapes(spark):
    weights = Weights(Labelling().weights())
    for source, want in SHAPES:
        assert main_text(source, weights) == want
    for source in ("<div>" * 30_000, "<a '" * 30_000, "</div>" * 30_000, "<!--", "<script>x"):
        assert main_text(source, weights) == ""


def test_main_text_of_long_attributes_and_formulas():
    weights = Weights(Labelling().weights())
    text = prose(9, 40)
    for quote, inner in (("'", '"'), ('"', "'")):
        value = f"<div class={inner}ad{inner}>not > text</div> " * 1000
        assert main_text(f"<article data-state={quote}{value}{quote}><p>{text}</p></article>", weights) == text
    formula = "<math><mrow><mi>a</mi><mo>+</mo><msup><mi>b</mi><mn>2</mn></msup></mrow></math>"
    assert main_text(f"<article><p>{text} {formula} {text}</p></article>", weights) == f"{text} a+b2 {text}"
    assert main_text(f"<article><p title='it>{text}</p></article>", weights) == text
    for source in ("<a x='" * 30_000, "<a x=" * 30_000, "<p =\"" * 30_001 + "'", "<a x='>" * 30_001):
        main_text(source, weights)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("*", F.lit("clash").alias("text"))
    found = {r.page_id: r.text for r in extract(pages, fit_weights(pages)).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        article = re.sub(r"</?b>", "", re.sub(r"</?(h1|p|br)>", " ", article))
        assert found[row.page_id] == " ".join(html.unescape(article).split())
    assert (fit_weights(pages.limit(0)) == Labelling().weights()).all() and extract(pages.limit(0)).count() == 0


def test_repeats_by_brute_force(spark):
    same = prose(7, 40)
    texts = [prose(8, 30) + same, same + prose(9, 30), "ab" * 120, None, same, "é" * 90]
    seen, want = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            gone[i : i + 100] |= data[i : i + 100] in seen
            seen.add(data[i : i + 100])
        want.append(bytes(b for b, g in zip(data, gone) if not g))
    found = {r.doc_id: bytes(r.kept) for r in remove_repeats(frame(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_pieces_as_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [prose(1, 50), " lead", "trail ", "a  b", "", None, "naïve café ﬁ 你好 🙂\x00", "\n\t x", "▁under", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"]
    found = {r.doc_id: r for r in encode_pieces(frame(spark, texts), path, decoded=True).collect()}
    for i, text in enumerate(texts):
        ids = model.encode(text or "")
        assert found[i].ids == ids and found[i].decoded == model.decode(ids)


def test_leaks_are_found(spark, odd, nothing):
    items = [prose(100 + i, 20 + i) for i in range(6)]
    edited = " ".join(w for k, w in enumerate(items[1].split()) if k not in (5, 12))
    texts = [prose(50, 80) + " " + items[0].upper() + "! " + prose(51, 40), edited, prose(52, 100), " ".join(items[2].split()[:10]), None]
    benchmark = spark.createDataFrame([*enumerate(items), (7, None), (8, "too short")], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in find_leaks(frame(spark, texts), benchmark).collect()}
    assert set(rows) == {(0, 0), (1, 1)}
    assert rows[0, 0].distance == 0 and rows[0, 0].start_word == 80 and rows[1, 1].distance == 2
    assert {r.doc_id for r in without_leaks(frame(spark, texts), benchmark).collect()} == {2, 3, 4}
    assert find_leaks(odd, benchmark).count() == 0 and find_leaks(nothing, benchmark).count() == 0
    assert without_leaks(odd, benchmark.limit(0)).count() == odd.count()
    sliced = find_leaks(frame(spark, texts), benchmark, Leaks(slice_words=40))
    assert {(r.doc_id, r.item_id) for r in sliced.collect()} == set(rows)


def test_personal_data(spark):
    texts = ["Mail jo.doe@example.org or call +44 20 7946 0958 now", "host 10.0.0.256 and 10.0.0.25", "pay 4111 1111 1111 1111 today, not 4111 1111 1111 1112", "nothing", None]
    docs = frame(spark, texts)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind != "term"] for r in find_personal_data(docs).collect()}
    assert found[0] == [("email", 5, 23), ("phone", 32, 48)]
    assert found[1] == [("ip", 20, 29)] and found[2] == [("card", 4, 23)] and found[3] == found[4] == []
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert "jo.doe" not in clean[0] and "[EMAIL]" in clean[0] and clean[3] == "nothing" and clean[4] is None
    assert sanitise(docs).columns == docs.columns


def test_personal_data_over_whole_texts(spark):
    """A name and a short code that give an address away go wherever they stand in its documents."""
    far = lambda i: prose(70 + i, 60)
    texts = [f"Write to kim@example.org {far(0)} Zyxwell {far(1)} zyxwell of Q7 said", f"{far(2)} Q7 Zyxwell {far(3)} mail kim@example.org now"]
    texts += [f"at kim@example.org Zyxwell, {far(4)} Q7", *(prose(200 + i, 60) for i in range(60)), "lee@example.org " + prose(300, 60), prose(301, 60) + " lee@example.org"]
    clean = {r.doc_id: r.text for r in sanitise(frame(spark, texts)).collect()}
    for i in range(3):
        assert not re.search("zyxwell|q7|kim@", clean[i], re.I)
    assert clean[1].split()[:60] == far(2).split() and [clean[i] for i in range(3, 63)] == texts[3:63]


def test_secrets(spark):
    texts = ['password = "hunter2hunter"', "key AKIA" + "A1" * 10, "id 0123456789abcdef01234567 end", None, "secret: abc"]
    rows = {r.doc_id: r for r in scan_secrets(frame(spark, texts), F.col("source"), F.col("lang")).collect()}
    kinds = {i: sorted(s.kind for s in r.spans if s.kind in ("assign", "access", "hex")) for i, r in rows.items()}
    assert kinds == {0: ["assign"], 1: ["access"], 2: ["hex"], 3: [], 4: []}


def test_resampling_parts_good_from_bad(spark, odd, nothing):
    good = [prose(i, 120).capitalize() + "." for i in range(60)]
    bad = [" ".join(w + "###" for w in prose(1000 + i, 120).split()) for i in range(60)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    drawn = draw(docs, labels)
    kept = {r.doc_id for r in weigh(drawn).filter("kept").collect()}
    assert len(kept & set(range(60))) >= 57 and not kept & set(range(60, 120))
    assert {r.doc_id for r in sampled(drawn).collect()} == kept
    assert weigh(draw(odd, labels)).count() == odd.count() and weigh(draw(nothing, labels)).count() == 0
    free = draw(docs, labels.limit(0))
    assert weigh(free).filter("kept").count() == 120 and draw(nothing, labels.limit(0)).size == 0


def test_resampling_keeps_columns_of_any_name(spark):
    names = ["a.b", "_id", "_toxic", "_weight", "row", "key", "weight", "doc_id", "text", "apart"]
    docs = spark.createDataFrame([tuple([i] * 8 + [prose(i, 30), -i]) for i in range(20)], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None), (3, 0, None)], "doc_id long, quality int, toxic int")
    found = sampled(draw(docs, labels))
    assert found.columns == names and found.schema == docs.schema
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert all(rows[r["doc_id"]] == r for r in found.collect())
    assert weigh(draw(docs, labels, id_column="a.b"), "a.b").count() == 20


def test_resampling_query_equals_plain_sums(spark, tmp_path):
    """Weights from counts held in dictionaries, and the sample as the largest keys of what is not toxic."""
    rng = np.random.default_rng(5)
    texts = [prose(i, int(rng.integers(0, 80))) + (" ###" * int(rng.integers(0, 6)) if i % 3 == 0 else "") for i in range(150)] + [None, "", texts_twice := prose(3, 20), texts_twice]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    marks = {i: (int(i % 3 != 0), int(i % 25 == 0)) for i in range(0, 150, 2)}
    spark.createDataFrame([(i, *m) for i, m in marks.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rule, grams = Resampling(), Grams(Resampling().buckets)
    found = [grams(t or "").tolist() for t in texts]
    marks = {i: m for i, m in marks.items() if texts[i] not in texts[:i]}
    good = [i for i, m in marks.items() if m == (1, 0)]
    bad = [i for i, m in marks.items() if m[0] == 0]
    corpus, target = (Counter(g for i in some for g in found[i]) for some in (range(len(texts)), good))
    in_good, in_bad = (Counter(g for i in some for g in set(found[i])) for some in (good, bad))
    share, ratios = sum(target.values()) / sum(corpus.values()), {}
    for gram, n in corpus.items():
        ratio = np.log((target[gram] + 0.5) / (n * share + 0.5))
        labelled = np.log((in_good[gram] + 0.5) / (len(good) + 1)) - np.log((in_bad[gram] + 0.5) / (len(bad) + 1))
        square, held = (target[gram] - n * share) ** 2 / (n * share + 1), (in_bad if ratio < 0 else in_good)[gram]
        least = min(abs(ratio), abs(labelled)) * np.sign(ratio) if ratio * labelled > 0 else 0
        ratios[gram] = least * square / (square + rule.z**2) * held**2 / (held**2 + rule.support**2)
    rows = queries.op10_resampling(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.log_weight == pytest.approx(sum(ratios[g] for g in found[r.doc_id]), abs=1e-3)
    drawn = draw(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    fine = [r for r in drawn.rows.collect() if r.toxic < drawn.toxic_cut]
    assert drawn.size == sum(r.weight >= drawn.cut for r in fine)
    last = sorted((r.key for r in fine), reverse=True)[drawn.size - 1]
    assert {r.doc_id for r in rows if r.kept} == {r.row.doc_id for r in fine if r.key >= last}


@pytest.mark.parametrize("size", [100, 400, 1500])
def test_planted_toxic_texts_go_at_every_size(spark, size):
    """Rare toxic words, and a phrase whose words are common in clean texts."""

    def text(i: int) -> str:
        words = prose(i, 100).split()
        words[10], words[30] = "you", "people"  # the words of the phrase, apart
        if i % 10 == 0:
            words[50:52] = ["you", "people"] if i % 20 else ["scum", "moron"]
        return " ".join(words)

    docs = frame(spark, [text(i) for i in range(size)])
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(size) if i % 10 or i % 40 < 30], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in weigh(draw(docs, labels)).filter("kept").collect()}
    assert not [i for i in kept if i % 10 == 0]
    assert len(kept) >= 0.95 * 0.9 * size


def test_kth_largest(spark):
    values = [float(i % 37) for i in range(500)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 13, 250, 499):
        assert kth_largest(table, "v", k, bins=8, at_end=5) == sorted(values, reverse=True)[k - 1]


def test_digest_of_kept_bytes(spark):
    assert hashlib.sha256(b"").hexdigest() == remove_repeats(frame(spark, [None])).select(F.sha2("kept", 256)).first()[0]
