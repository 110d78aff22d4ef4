import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brightloom.operators import graph, hybrid, lookups, text_index, upsert, verify
from brightloom.operators.ordered import best_before
from brightloom.operators.text_index import TextIndex, build_index, count_words, index_differences, index_of, keyword_hits
from brightloom.operators.vector_search import nearest_vectors
from brightloom.plans import search_queries
from brightloom.plans.registry import Tables
from brightloom.session import cut_lineage, lookup_join

NOW = datetime(2024, 1, 31)


def chunk_table(spark, texts):
    rows = [(f"{i}:0", str(i), 0, None, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, page_id string, ord int, heading_path string, text string")


# ---- vectors ----


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vector_id string, embedding array<float>, namespace string")


@pytest.mark.parametrize("per_block, sent", [(512, 1 << 20), (3, 1 << 20), (3, 0)])
def test_nearest_equals_brute_force(spark, per_block, sent):
    chance = random.Random(1)
    points = [(f"v{i:03d}", [chance.gauss(0, 1) for _ in range(8)], chance.choice("ab")) for i in range(200)]
    points += [(f"w{i}", points[0][1], points[0][2]) for i in range(20)] + [("zero", [0.0] * 8, "a")]
    asked = [(f"q{i}", points[i][1], [None, "a", "b"][i % 3]) for i in range(7)]

    def cosine(a, b):
        a, b = [float(f) for f in a], [float(f) for f in b]
        norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / norm, 6) if norm else 0.0

    expected = {}
    for q, vector, namespace in asked:
        scored = sorted((-cosine(vector, v), vid) for vid, v, ns in points if namespace in (None, ns))
        expected[q] = [vid for _, vid in scored[:15]]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>, namespace string")
    got = {}
    for r in nearest_vectors(queries, vectors(spark, points).repartition(5), 15, per_block, sent).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vector_id"])
    assert got == expected


def test_nearest_without_queries_or_vectors(spark):
    none = spark.createDataFrame([], "query_id string, embedding array<float>")
    assert nearest_vectors(none, vectors(spark, [("a", [1.0], "n")]), 3).count() == 0
    asked = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<float>")
    assert nearest_vectors(asked, vectors(spark, []), 3).count() == 0


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_nearest_of_odd_rows(spark, sent):
    """Nulls are not found, lengths meet their own kind, repeated rows come as often as they are there."""
    rows = [("a", [1.0, 0.0], "n"), ("a", [1.0, 0.0], "n"), ("b", [0.0, 2.0], None), ("long", [1.0, 0.0, 0.0], "n"), ("none", None, "n"), ("hole", [1.0, None], "n"), ("empty", [], "n")]
    asked = [("q", [2.0, 0.0]), ("r", [0.0, 0.0, 0.0]), ("s", None), ("t", [])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    found = nearest_vectors(queries, vectors(spark, rows), 3, 512, sent)
    got = sorted((r["query_id"], r["rank"], r["vector_id"], r["score"]) for r in found.collect())
    assert got == [("q", 1, "a", 1.0), ("q", 2, "a", 1.0), ("q", 3, "b", 0.0), ("r", 1, "long", 0.0)]


def test_any_number_of_queries_reads_the_vectors_once(spark, tmp_path):
    chance = random.Random(2)
    points = [(f"v{i:04d}", [chance.gauss(0, 1) for _ in range(4)], "n") for i in range(3000)]
    vectors(spark, points).write.parquet(f"{tmp_path}/vectors")
    stored = spark.read.parquet(f"{tmp_path}/vectors")
    found = nearest_vectors(stored.select(F.col("vector_id").alias("query_id"), "embedding"), stored, 1)
    # one scan of the vectors and one of the queries' written table
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.filter("query_id <> vector_id").isEmpty() and found.count() == 3000


# ---- the text index ----


def queries(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "query_id string, text string")


def test_keyword_search_wants_every_term(spark):
    index = build_index(chunk_table(spark, ["red fox", "red red dog", "Réd fox fox jumps", "blue bird", "green tree"]))
    got = {}
    for r in keyword_hits(queries(spark, a="RED fox!", b="red missing", c="...", d="fox"), index, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {"a": ["2:0", "0:0"], "d": ["2:0", "0:0"]}


def test_bm25_scores(spark):
    texts = ["red fox", "red red dog barks", "blue bird", "green tree", "old stone wall"]
    hit = keyword_hits(queries(spark, q="dog dog"), build_index(chunk_table(spark, texts)), 5).collect()[0]
    mean = sum(len(t.split()) for t in texts) / 5
    idf = math.log((5 - 1 + 0.5) / (1 + 0.5))
    expected = -2 * idf * 1 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / mean))
    assert hit["score"] == pytest.approx(expected)


def test_index_follows_replaced_pages(spark):
    chunks = chunk_table(spark, ["one two", "two three", "four"])
    index = build_index(chunks)
    assert index_differences(index, chunks).count() == 0
    changed = spark.createDataFrame([("1",)], "page_id string")
    new = chunk_table(spark, ["", "five two two"]).filter("page_id = '1'")
    after = upsert.replace_rows(chunks, new, changed, "page_id")
    assert index_differences(index, after).count() > 0
    replaced = text_index.replace_in_index(index, changed, new)
    assert index_differences(replaced, after).count() == 0
    assert replaced.lengths.filter("chunk_id = '1:0'").collect()[0]["terms"] == 3


def test_written_index_finds_the_same(spark, tmp_path):
    index = build_index(chunk_table(spark, ["red fox", "red dog", "fox"]))
    text_index.write_index(index, str(tmp_path / "index"))
    asked = queries(spark, a="fox", b="red dog")
    hits = [keyword_hits(asked, i, 5).orderBy("query_id", "rank").collect() for i in (index, text_index.read_index(spark, str(tmp_path / "index")))]
    assert hits[0] == hits[1] and len(hits[0]) == 3


def test_damaged_index_is_noticed(spark):
    chunks = chunk_table(spark, ["one two two"])
    index = build_index(chunks)
    wrong = TextIndex(index.postings.withColumn("tf", F.lit(1).cast("long")), index.lengths)
    assert [tuple(r) for r in index_differences(wrong, chunks).select("term", "tf", "expected_tf").collect()] == [("two", 1, 2)]


# ---- fusion, guards and expansion ----


def test_reciprocal_ranks_add_up(spark):
    arms = spark.createDataFrame(
        [("q", "semantic", "a", 1, 0.9), ("q", "semantic", "b", 2, 0.8), ("q", "keyword", "b", 1, -3.0)],
        "query_id string, arm string, chunk_id string, rank int, score double",
    )
    got = {r["chunk_id"]: (round(r["fused"], 9), r["semantic"], r["keyword"]) for r in hybrid.fuse_ranks(arms).collect()}
    assert got == {"a": (round(1 / 61, 9), 0.9, None), "b": (round(1 / 62 + 1 / 61, 9), 0.8, -3.0)}


def corpus(spark):
    pages = spark.createDataFrame(
        [("0", "good", "t0"), ("1", "poor", "t1"), ("2", "poor", "t1"), ("3", "gone", "t1"), ("4", "poor", "t2")],
        "page_id string, source_id string, page_type string",
    ).select(
        "*", F.concat(F.lit("https://e.org/"), "page_id").alias("url"), F.lit("T").alias("title"), F.lit("en").alias("language"),
        F.when(F.col("page_id") == "2", "deprecated").otherwise("active").alias("lifecycle"), F.lit(datetime(2024, 1, 1)).alias("crawled_at"),
    )
    sources = spark.createDataFrame([("good", 1), ("poor", 2)], "source_id string, tier int")
    chunks = chunk_table(spark, ["red fox " + "x" * 400, "red fox", "red fox", "red fox", "unrelated"])
    rows = chunks.select("chunk_id", "page_id").join(pages, "page_id").join(sources, "source_id", "left").select(
        F.col("chunk_id").alias("vector_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"),
        F.col("page_type").alias("namespace"), "page_type", F.col("tier").alias("source_tier"), "language", "lifecycle", "crawled_at",
    )
    edges = spark.createDataFrame(
        [("e1", "0", "4", "see_also", 1.0), ("e2", "0", "1", "part_of", 1.0), ("e3", "0", "9", "part_of", 1.0), ("e4", "1", "4", "part_of", 1.0), ("e5", "0", None, "see_also", 1.0), ("e6", "0", "3", "link", 1.0)],
        "edge_id string, src_page_id string, dst_page_id string, edge_type string, weight double",
    )
    return hybrid.Corpus(chunks, pages, sources, rows, build_index(chunks), edges)


def search(spark, **options):
    asked = spark.createDataFrame([("q", "red fox", [1.0, 0.0])], "query_id string, text string, embedding array<float>")
    found = hybrid.hybrid_search(asked, corpus(spark), hybrid.SearchOptions(as_of=NOW, **options))
    return found.orderBy("position").collect()


def test_hybrid_orders_by_fused_score_and_tier(spark):
    got = search(spark)
    assert [r["page_id"] for r in got[:3]] == ["0", "1", "2"]
    assert {r["page_id"]: r["source_tier"] for r in got}["3"] == 0
    assert got[0]["tier_boost"] == 0.05 and got[0]["snippet"].endswith("…") and len(got[0]["snippet"]) == 301
    assert got[0]["freshness"] == pytest.approx(0.5 ** (30 / 90))


def test_filters_before_the_cut_of_the_keyword_arm(spark):
    options = dict(mode="keyword", top_k=1, candidate_factor=1, filters=hybrid.SearchFilters(lifecycle="deprecated"))
    assert search(spark, **options) == []  # the one candidate is of another page
    assert [r["page_id"] for r in search(spark, filter_before_cut=True, **options)] == ["2"]


def test_filters_guard_both_arms(spark):
    only = hybrid.SearchFilters(page_types=("t1",), tiers_max=2, lifecycle="active")
    assert {r["page_id"] for r in search(spark, filters=only)} == {"1", "3"}
    assert {r["page_id"] for r in search(spark, filters=hybrid.SearchFilters(page_types=()))} == {"0", "1", "2", "3", "4"}
    assert search(spark, filters=hybrid.SearchFilters(language="de")) == []
    assert search(spark, filters=hybrid.SearchFilters(crawled_from=datetime(2024, 1, 2))) == []
    assert only.namespace() == "t1" and hybrid.SearchFilters(page_types=("a", "b")).namespace() is None


def test_modes(spark):
    assert all(r["keyword"] is None for r in search(spark, mode="semantic"))
    keyword = search(spark, mode="keyword")
    assert {r["page_id"] for r in keyword} == {"0", "1", "2", "3"} and all(r["semantic"] is None for r in keyword)


def test_expansion_follows_chosen_edges_once(spark):
    got = search(spark, mode="keyword", top_k=2, expand=True)
    assert [(r["page_id"], r["via"], r["position"]) for r in got] == [("0", "primary", 1), ("1", "primary", 2), ("4", "relationship", 3)]
    assert got[2]["fused"] == 0.0 and got[2]["semantic"] is None
    linked = search(spark, mode="keyword", top_k=2, expand=True, edge_types=("link",))
    assert [r["page_id"] for r in linked] == ["0", "1", "3"]


@pytest.mark.parametrize("options", [{"top_k": 0}, {"top_k": 51}, {"mode": "other"}])
def test_search_options(options):
    with pytest.raises(ValueError):
        hybrid.SearchOptions(as_of=NOW, **options)


# ---- the graph ----


@pytest.mark.parametrize("block_rows", [4, 100_000])
def test_best_before_equals_a_fold(spark, block_rows):
    chance = random.Random(2)
    rows = [(chance.choice("xxxy"), n, chance.randint(1, 5)) for n in range(50)]
    df = spark.createDataFrame(rows, "k string, seq long, tier int")
    got = {r["seq"]: r["held"] for r in best_before(df, ["k"], "seq", F.struct("tier", "seq"), "held", block_rows).collect()}
    held = {}
    for key, seq, tier in rows:
        assert (got[seq] and tuple(got[seq])) == held.get(key)
        held[key] = min(held.get(key, (tier, seq)), (tier, seq))


def graph_pages(spark, rows):
    return spark.createDataFrame(rows, "page_id string, source_id string, url string, title string, page_type string, lifecycle string, seq long")


def test_entities_and_conflicts(spark):
    pages = graph_pages(
        spark,
        [("a", "two", "u1", "The Sword", "item", "active", 1), ("b", "one", "u2", "Sword", "item", "active", 2), ("c", "two", "u3", "sword!", "item", "active", 3),
         ("d", "one", "u4", "SWORD", "item", "active", 4), ("e", "two", "u5", None, "item", "active", 5), ("f", "two", "u6", "Sword", "place", "active", 6), ("g", "lost", "u7", "sword", "item", "active", 7)],
    )
    sources = spark.createDataFrame([("one", 1), ("two", 2)], "source_id string, tier int")
    decisions = graph.entity_decisions(pages, sources)
    assert {r["page_id"]: (r["outcome"], r["other_page_id"]) for r in decisions.collect()} == {
        "a": ("first", None), "b": ("won", "a"), "c": ("lost", "b"), "d": ("tied", "b"), "e": ("first", None), "f": ("first", None), "g": ("lost", "b"),
    }
    entities = {(r["normalized"], r["kind"]): (r["name"], r["canonical_page_id"]) for r in graph.registered_entities(decisions).collect()}
    assert entities == {("sword", "item"): ("sword", "b"), ("u5", "item"): ("u5", "e"), ("sword", "place"): ("Sword", "f")}
    assert sorted((r["src_page_id"], r["dst_page_id"]) for r in graph.supersede_edges(decisions).collect()) == [("b", "a"), ("b", "c"), ("b", "g")]
    after = graph.deprecate_losers(pages, decisions)
    assert {r["page_id"] for r in after.filter("lifecycle = 'deprecated'").collect()} == {"a", "c", "g"}


def test_mentions_are_whole_token_runs(spark):
    texts = spark.createDataFrame([("p1", "A Red-Fox jumps over the wall."), ("p2", "redfox only"), ("p3", "one two three four five six")], "page_id string, text string")
    entities = spark.createDataFrame(
        [("red fox", "x", "e1"), ("fox", "x", "p1"), ("ox", "x", "e3"), ("wall", "x", None), ("two three four five six", "x", "e4"), ("two three four five seven", "x", "e5"), ("red fox", "y", "e6")],
        "normalized string, kind string, canonical_page_id string",
    )
    got = {(r["src_page_id"], r["dst_page_id"]) for r in graph.mention_edges(texts, entities).collect()}
    assert got == {("p1", "e1"), ("p1", "e6"), ("p3", "e4")}


def test_link_edges(spark):
    links = [("/b", " B "), ("b", "again"), ("#self", ""), ("https://e.org/a", "self"), ("mailto:x@y.z", "mail"), ("/long", "x" * 300)]
    pages = spark.createDataFrame([("a", "s", "https://e.org/a", links)], "page_id string, source_id string, url string, links array<struct<href:string,text:string>>")
    known = spark.createDataFrame([("a", "s", "https://e.org/a"), ("b", "s", "https://e.org/b"), ("o", "other", "https://e.org/long")], "page_id string, source_id string, url string")
    got = {r["dst_url"]: (r["dst_page_id"], r["evidence"]) for r in graph.link_edges(pages, known).collect()}
    assert got == {"https://e.org/b": ("b", "B"), "https://e.org/a#self": (None, None), "mailto:x@y.z": (None, "mail"), "https://e.org/long": (None, "x" * 200)}
    assert set(r["dst_url"] for r in graph.link_edges(pages, known, ("mailto",)).collect()) == {"mailto:x@y.z"}


# ---- snapshots, lookups and joins of hot keys ----


def test_keyed_upsert(spark):
    shape = "k string, a string, b string"
    current = spark.createDataFrame([("1", "x", None), ("2", "y", "q")], shape)
    changes = spark.createDataFrame([("2", None, "new"), ("3", "z", "r")], shape)
    got = sorted((tuple(r) for r in upsert.keyed_upsert(current, changes, ["k"], ["a"]).collect()))
    assert got == [("1", "x", None), ("2", None, "q"), ("3", "z", "r")]


def test_last_of_several_changes(spark):
    changes = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, seq long, v string")
    assert upsert.last_per_key(changes, ["k"]).collect()[0]["v"] == "b"


def test_images_and_their_links(spark):
    shape = "image_id string, page_id string, url string, content_hash string, content_type string, alt_text string, width int"
    current = spark.createDataFrame([("i1", "p", "/a", "h1", "t", "old", 5), ("i2", "p", "/b", "h1", "t", "old", 5)], shape)
    changes = spark.createDataFrame([("x", "p", "/a", "h1", "t", "new", 9), ("y", "p", "/b", "h2", "t", "new", 9), ("z", "p", "/c", "h3", "t", "new", 9)], shape)
    got = {r["image_id"]: (r["content_hash"], r["alt_text"], r["width"]) for r in upsert.upsert_images(current, changes).collect()}
    assert got == {"i1": ("h1", "old", 5), "i2": ("h2", "new", 5), "z": ("h3", "new", 9)}
    links = spark.createDataFrame([("c", "i1")], "chunk_id string, image_id string")
    assert upsert.link_chunk_images(links, links).count() == 1


def test_edge_insert_ignores_only_equal_urls(spark):
    shape = "src_page_id string, dst_url string, edge_type string, weight double"
    current = spark.createDataFrame([("a", "u", "link", 1.0), ("a", None, "x", 1.0)], shape)
    new = spark.createDataFrame([("a", "u", "link", 9.0, 1), ("a", "v", "link", 2.0, 2), ("a", "v", "link", 3.0, 3), ("a", None, "x", 4.0, 4), ("a", None, "x", 4.0, 5)], shape + ", seq long")
    got = sorted((str(r["dst_url"]), r["weight"]) for r in graph.insert_edges(current, new).collect())
    assert got == [("None", 1.0), ("None", 4.0), ("None", 4.0), ("u", 1.0), ("v", 2.0)]


def test_keyset_pages(spark):
    pages = spark.createDataFrame([(f"p{i}", "s") for i in range(5)], "page_id string, source_id string")
    page = sorted(tuple(r) for r in lookups.keyset_page(pages, 2, "p0").select("page_id", "next_cursor").collect())
    assert page == [("p1", "p2"), ("p2", "p2")]
    assert {r["next_cursor"] for r in lookups.keyset_page(pages, 2, "p3").collect()} == {None}


def test_caller_order(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    wanted = spark.createDataFrame([("c", 0), ("x", 1), ("a", 2)], "id string, pos int")
    assert [r["id"] for r in lookups.in_caller_order(table, wanted, "id").collect()] == ["c", "a"]


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_lookup_join_of_hot_keys_equals_a_join(spark, how):
    left = spark.createDataFrame([("hot" if n % 3 else f"k{n}", n) for n in range(60)], "k string, n int")
    right = spark.createDataFrame([("hot", "H"), ("k3", "3"), ("none", "N")], "k string, v string")
    expected = sorted(map(str, left.join(right, "k", how).collect()))
    assert sorted(map(str, lookup_join(left, right, ["k"], how, F.col("n"), hot_rows=5).collect())) == expected


def test_verify_is_clean_for_a_clean_store(spark):
    c = corpus(spark)
    pages = c.pages
    ledger = c.chunks.join(pages, "page_id").select("chunk_id", F.lit("m").alias("model"), F.col("chunk_id").alias("vector_id"), F.col("page_type").alias("namespace"))
    empty_images = spark.createDataFrame([], "image_id string, page_id string, url string")
    store = verify.Store(
        c.sources, pages, pages, c.chunks, empty_images, spark.createDataFrame([], "chunk_id string, image_id string"),
        c.edges.filter("dst_page_id <> '9'"), pages, ledger, pages, spark.createDataFrame([("1", "validate", "fail")], "page_id string, phase string, outcome string"), c.text_index,
    )
    report = verify.verify_report(store, "m").collect()[0]
    assert report["ok"] and report["pages_with_validation_failures"] == 1
    other = verify.verify_report(store, "another model").collect()[0]
    assert not other["ok"] and other["chunks_lacking_embedding"] == 5


def test_second_crawl_of_pages(spark):
    shape = "page_id string, source_id string, url string, title string, content_hash string, lifecycle string, version int, crawled_at int, updated_at int"
    current = spark.createDataFrame([("a", "s", "/a", "old", "h1", "deprecated", 3, 1, 1), ("b", "s", "/b", "old", "h1", "active", 1, 1, 1), ("c", "s", "/c", "old", "h1", "active", 1, 1, 1)], shape)
    crawl = spark.createDataFrame([("x", "s", "/a", None, "h2", 9, 9), ("y", "s", "/b", "new", "h1", 9, 9), ("z", "s", "/z", "new", "h3", 9, 9)], "page_id string, source_id string, url string, title string, content_hash string, crawled_at int, updated_at int")
    got = sorted(tuple(r) for r in upsert.upsert_pages(current, crawl).select(*[f.split()[0] for f in shape.split(", ")]).collect())
    assert got == [
        ("a", "s", "/a", None, "h2", "deprecated", 4, 1, 9),
        ("b", "s", "/b", "old", "h1", "active", 1, 1, 1),
        ("c", "s", "/c", "old", "h1", "active", 1, 1, 1),
        ("z", "s", "/z", "new", "h3", "active", 1, 9, 9),
    ]


def test_differences_of_an_index_are_found_without_sorting(spark):
    chunks = spark.createDataFrame([("1:0", "a b b"), ("2:0", "b c"), ("3:0", "!")], "chunk_id string, text string").withColumn("heading_path", F.lit(None).cast("string"))
    stored = [("a", "1:0", 1), ("b", "1:0", 1), ("b", "1:0", 1), ("b", "2:0", None), ("d", "2:0", 4)]
    index = TextIndex(spark.createDataFrame(stored, "term string, chunk_id string, tf bigint"), build_index(chunks).lengths)
    found = index_differences(index, chunks)
    # A posting stored twice is a difference even where its counts add up.
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("b", "1:0", 2, 2), ("b", "2:0", None, 1), ("d", "2:0", 4, None), ("c", "2:0", None, 1)]))
    plan = index_differences(index, chunks)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_both_tables_of_an_index_come_from_one_written_table(spark):
    chunks = spark.createDataFrame([("1:0", "a b b"), ("2:0", "!")], "chunk_id string, text string").withColumn("heading_path", F.lit(None).cast("string"))
    index = index_of(cut_lineage(count_words(chunks)))
    assert {tuple(r) for r in index.postings.collect()} == {("a", "1:0", 1), ("b", "1:0", 2)}
    assert {tuple(r) for r in index.lengths.collect()} == {("1:0", 3), ("2:0", 0)}
    for table in (index.postings, index.lengths):
        assert "regexp_extract_all" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert "words" not in index.lengths._jdf.queryExecution().executedPlan().toString()


def test_a_semantic_search_writes_no_text_index(spark, monkeypatch):
    written = []
    monkeypatch.setattr(search_queries, "_stored_index", lambda chunks: written.append(chunks) or build_index(chunks))
    tables = Tables(spark, "/root/testdata/sf0.001")
    search_queries.document_corpus(tables, "semantic")
    assert not written
    search_queries.document_corpus(tables, "keyword")
    assert len(written) == 1


ODD_TEXTS = ["", "Éclair  éclair x_y don’t", "a-b A_b 12³ Ⅷ 中文 中文", "\U0001df00 ࡰ \U0001f600", "plain red Red", "i̇ İx ß", None, "\x1cred\x85fox x"]


def test_counted_words_are_those_of_the_index_tokens(spark):
    chunks = chunk_table(spark, ODD_TEXTS)
    counted = {r.chunk_id: (r.terms, sorted((w.term, w.tf) for w in r.words)) for r in count_words(chunks).collect()}
    for chunk_id, tokens in chunks.select("chunk_id", text_index.X.index_tokens(F.coalesce("text", F.lit("")))).collect():
        assert counted[chunk_id] == (len(tokens), sorted((t, tokens.count(t)) for t in set(tokens)))


def test_a_search_shuffles_no_posting_by_chunk_and_word(spark):
    chance = random.Random(4)
    chunks = chunk_table(spark, [" ".join(chance.choices("abcdefgh", k=6)) for _ in range(60)])
    index = index_of(cut_lineage(count_words(chunks)))
    asked = queries(spark, q="a b", r="c", s="h h g")
    found = keyword_hits(asked, index, 50)
    rows = found.orderBy("query_id", "rank").collect()
    assert rows == keyword_hits(asked, TextIndex(index.postings, index.lengths), 50).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {"q", "r", "s"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Initial Plan")[-1]
