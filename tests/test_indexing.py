from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from brightloom.operators.indexing import index_pages, supersede
from brightloom.operators.text_index import build_index
from brightloom.operators.verify import chunks_lacking_embedding, namespace_drift, orphan_embeddings

AS_OF = datetime(2024, 1, 31)
PAGE = "page_id string, source_id string, url string, title string, page_type string, lifecycle string, language string, seq long, html string"


def run(spark, rows):
    pages = spark.createDataFrame(rows, PAGE).withColumn("crawled_at", F.lit(AS_OF).cast("timestamp"))
    sources = spark.createDataFrame([("s", 1), ("t", 2)], "source_id string, tier int")
    rules = spark.createDataFrame([("s", ["Related"], [], ["^ad$"])], "source_id string, truncate_after array<string>, drop_sections array<string>, drop_blocks array<string>")
    return index_pages(pages, pages.drop("html"), sources, rules, "m", AS_OF, lambda texts: np.ones((len(texts), 2)), 2)


def page(page_id, source, body, title=None, seq=1):
    return (page_id, source, f"https://e.org/{page_id}", title, "item", "active", "en", seq, body)


def test_index_run_and_reindexing_leaves_no_orphans(spark):
    long = "<h1>A</h1>" + "".join(f"<p>{'word ' * 200}{i}</p>" for i in range(3))
    first = run(
        spark,
        [page("a", "s", long + "<p>ad</p><h2>Related</h2><p>x</p>", "The Sword", 1), page("b", "t", "<h1>B</h1><p>See the sword <a href='/a'>here</a></p>", "Sword", 2)],
    )
    tables = {"chunks": first.chunks, "sections": first.sections, "markdown": first.markdown, "vectors": first.vectors, "ledger": first.ledger, "edges": first.edges}
    assert sorted(r["chunk_id"] for r in first.chunks.collect()) == ["a:0", "a:1", "a:2", "b:0"]
    assert [r["heading"] for r in first.sections.filter("page_id = 'a'").collect()] == ["A"]
    assert "ad" not in first.markdown.filter("page_id = 'a'").collect()[0]["markdown"].split()
    edges = {(r["src_page_id"], r["dst_page_id"], r["edge_type"]) for r in first.edges.collect()}
    assert edges == {("b", None, "link"), ("b", "a", "entity_mention"), ("a", "b", "supersedes")}

    second = run(spark, [page("a", "s", "<h1>A</h1><p>short now</p>", "The Sword", 1)])
    after = supersede(tables, second)
    assert sorted(r["chunk_id"] for r in after["chunks"].collect()) == ["a:0", "b:0"]
    assert sorted(r["vector_id"] for r in after["vectors"].collect()) == ["a:0", "b:0"]
    assert orphan_embeddings(after["chunks"], after["ledger"]).count() == 0
    assert chunks_lacking_embedding(after["chunks"], after["ledger"], "m").count() == 0
    types = spark.createDataFrame([("a", "item"), ("b", "item")], "page_id string, page_type string")
    assert namespace_drift(after["chunks"], types, after["ledger"]).count() == 0
    assert {(r["src_page_id"], r["edge_type"]) for r in after["edges"].collect()} == {("b", "link"), ("b", "entity_mention")}
    assert build_index(after["chunks"]).lengths.count() == 2
