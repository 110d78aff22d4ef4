"""Queries over the search side: vectors, text index, fusion, hybrid search, reconciliation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from brightloom.operators import embed, lookups, upsert, verify
from brightloom.operators import pages as P
from brightloom.operators.hybrid import Corpus, SearchFilters, SearchOptions, filter_vectors, fuse_ranks, hybrid_search
from brightloom.operators.indexing import index_pages
from brightloom.operators.text_index import build_index, count_words, index_differences, index_of, keyword_hits, TextIndex
from brightloom.operators.vector_search import nearest_vectors, vectors_by_id
from brightloom.plans.page_queries import AS_OF, DOC_CHUNKS, RULES, SEEDS, SITE_PARTS, _rules, document_pages
from brightloom.plans.registry import query
from brightloom.session import cut_lineage
from brightloom.sources.pages import indexable_pages as ready_pages

MODEL = "hash-768"
TOP_K = 10

# ---- vectors ---------------------------------------------------------------------------


def _cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 9)"


@query(
    f"""SELECT query_id, vector_id, round(score, 6) AS score, rank FROM (
          SELECT query_id, vector_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank
          FROM (SELECT q.query_id, v.vector_id, {_cosine('q.embedding', 'v.embedding')} AS score FROM search_queries q, vectors v))
        WHERE rank <= 10""",
    ("search_queries", "vectors"),
)
def vector_topk(t):
    return nearest_vectors(t("search_queries").drop("namespace"), t("vectors"), TOP_K)


@query(
    f"""SELECT query_id, vector_id, round(score, 6) AS score, rank FROM (
          SELECT query_id, vector_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank
          FROM (SELECT q.query_id, v.vector_id, {_cosine('q.embedding', 'v.embedding')} AS score
                FROM search_queries q JOIN vectors v ON v.namespace = q.namespace AND v.source_tier <= 2))
        WHERE rank <= 10""",
    ("search_queries", "vectors"),
)
def vector_topk_filtered(t):
    """Every query stays in the namespace of its own vector; a metadata bound applies to all."""
    return nearest_vectors(t("search_queries"), filter_vectors(t("vectors"), SearchFilters(tiers_max=2)), TOP_K)


@query(
    "SELECT vector_id, namespace, round(list_sum(CAST(embedding AS DOUBLE[])), 3) AS total FROM vectors SEMI JOIN search_queries ON vector_id = query_id",
    ("search_queries", "vectors"),
)
def vector_lookup(t):
    found = vectors_by_id(t("vectors"), t("search_queries").select(F.col("query_id").alias("vector_id")))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return found.select("vector_id", "namespace", F.round(total, 3).alias("total"))


@query(
    """SELECT vector_id, CASE WHEN namespace = 'type1' THEN 'moved' ELSE namespace END AS namespace FROM vectors WHERE namespace <> 'type2'
       UNION ALL SELECT concat('new', vector_id), 'moved' FROM vectors WHERE namespace = 'type1'""",
    ("vectors",),
)
def vector_replace(t):
    """Vectors of one namespace are written again, with copies, and another namespace is deleted."""
    vectors = t("vectors")
    again = vectors.filter("namespace = 'type1'").withColumn("namespace", F.lit("moved"))
    copies = again.withColumn("vector_id", F.concat(F.lit("new"), "vector_id"))
    after = upsert.replace_rows(vectors, again.unionByName(copies), again, "vector_id")
    return upsert.delete_rows(after, vectors.filter("namespace = 'type2'"), "vector_id").select("vector_id", "namespace")


# ---- the text index --------------------------------------------------------------------

TOKENS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"

INDEX = f"""{DOC_CHUNKS},
  chunks AS (SELECT concat(page_id, ':', ord) AS chunk_id, page_id, ord, text FROM packed),
  tokens AS (SELECT chunk_id, unnest({TOKENS.format('text')}) AS term FROM chunks),
  postings AS (SELECT term, chunk_id, count(*) AS tf FROM tokens GROUP BY ALL),
  lengths AS (SELECT chunk_id, len({TOKENS.format('text')}) AS terms FROM chunks)"""

HITS = f"""{INDEX},
  terms AS (SELECT query_id, term, count(*) AS repeats FROM (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
  wanted AS (SELECT query_id, count(*) AS n FROM terms GROUP BY ALL),
  freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  corpus AS (SELECT count(*) AS n_chunks, avg(terms) AS mean FROM lengths),
  scored AS (SELECT query_id, chunk_id, count(*) AS found,
      -sum(repeats * greatest(CASE WHEN ln((n_chunks - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_chunks - df + 0.5) / (df + 0.5)) END, 0)
           * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * terms.terms / mean))) AS score
    FROM (SELECT * FROM terms) q JOIN postings USING (term) JOIN freq USING (term) JOIN lengths terms USING (chunk_id), corpus GROUP BY query_id, chunk_id),
  ranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS rank
    FROM scored JOIN wanted USING (query_id) WHERE found = n),
  hits AS (SELECT * FROM ranked WHERE rank <= 30)"""


def _chunks(t):
    """The stored chunk table of the documents."""
    return cut_lineage(P.chunk_pages(document_pages(t)))


def _stored_index(chunks):
    """The index as a stored table, for which the words are read once: searches read it several times."""
    return index_of(cut_lineage(count_words(chunks)))


def _passages(t):
    return t("benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


@query(f"WITH {INDEX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM postings GROUP BY term")
def text_postings(t):
    index = build_index(_chunks(t))
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


@query(f"WITH {INDEX} SELECT term, chunk_id, CASE WHEN length(term) <> 5 THEN tf + 1 END AS tf, tf AS expected_tf FROM postings WHERE length(term) IN (5, 7)")
def index_differences_found(t):
    """An index that lost the words of five letters and counts those of seven once too often."""
    chunks = _chunks(t)
    index = build_index(chunks)
    size = F.length("term")
    damaged = index.postings.filter(size != 5).withColumn("tf", F.col("tf") + F.when(size == 7, 1).otherwise(0))
    return index_differences(TextIndex(damaged, index.lengths), chunks)


@query(f"WITH {HITS} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits")
def keyword_topk(t):
    return keyword_hits(_passages(t), _stored_index(_chunks(t)), 30)


# ---- fusion and hybrid search ----------------------------------------------------------


@query(
    f"""WITH near AS (SELECT query_id, vector_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank
            FROM (SELECT q.query_id, v.vector_id, {_cosine('q.embedding', 'v.embedding')} AS score FROM search_queries q, vectors v)),
          inside AS (SELECT query_id, vector_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank
            FROM (SELECT q.query_id, v.vector_id, {_cosine('q.embedding', 'v.embedding')} AS score FROM search_queries q JOIN vectors v USING (namespace))),
          arms AS (SELECT * FROM near WHERE rank <= 20 UNION ALL SELECT * FROM inside WHERE rank <= 20)
        SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS fused FROM arms GROUP BY ALL""",
    ("search_queries", "vectors"),
)
def rank_fusion(t):
    queries, vectors = t("search_queries"), t("vectors")

    def arm(name, asked):
        near = nearest_vectors(asked, vectors, 20)
        return near.select("query_id", F.lit(name).alias("arm"), F.col("vector_id").alias("chunk_id"), "rank", "score")

    arms = arm("semantic", queries.drop("namespace")).unionByName(arm("keyword", queries))
    return fuse_ranks(arms).select("query_id", "chunk_id", "fused")


EMBEDDED = f"""{HITS},
  texts AS (SELECT concat('c', chunk_id) AS id, text FROM chunks UNION ALL SELECT concat('q', item_id), text FROM benchmark),
  {SEEDS.strip()},
  embedded AS (SELECT id, CAST(CAST(e AS FLOAT[]) AS DOUBLE[]) AS e FROM unit)"""


def _hybrid_oracle(condition: str, select: str, expand: str = "", arms: str = "semantic hybrid keyword", filter_first: bool = False) -> str:
    semantic = "SELECT query_id, 'semantic' AS arm, chunk_id, rank, score FROM near WHERE rank <= 30"
    keyword = "SELECT query_id, 'keyword' AS arm, chunk_id, rank, score FROM hits"
    if filter_first:
        admitted = "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS rank FROM ranked JOIN allowed USING (chunk_id)"
        keyword = f"SELECT query_id, 'keyword' AS arm, chunk_id, rank, score FROM ({admitted}) WHERE rank <= 30"
    used = " UNION ALL ".join(sql for name, sql in (("semantic", semantic), ("keyword", keyword)) if name in arms)
    return f"""WITH {EMBEDDED},
  described AS (SELECT p.page_id, p.source_id, p.url, p.title, p.page_type, p.language, p.lifecycle, p.crawled_at, s.tier AS source_tier
                FROM doc_pages p JOIN doc_sources s USING (source_id)),
  allowed AS (SELECT chunk_id FROM chunks JOIN described USING (page_id) WHERE {condition}),
  near AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM (SELECT q.id[2:] AS query_id, c.id[2:] AS chunk_id, round(list_inner_product(q.e, c.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(c.e, c.e)), 9) AS score
          FROM embedded q, embedded c JOIN allowed a ON c.id = concat('c', a.chunk_id) WHERE q.id LIKE 'q%' AND c.id LIKE 'c%')),
  arms AS ({used}),
  fused AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS fused, max(CASE WHEN arm = 'semantic' THEN score END) AS semantic,
      max(CASE WHEN arm = 'keyword' THEN score END) AS keyword, max(CASE WHEN arm = 'semantic' THEN rank END) AS sr, max(CASE WHEN arm = 'keyword' THEN rank END) AS kr
    FROM arms GROUP BY ALL),
  found AS (SELECT f.*, c.page_id, c.text, d.* EXCLUDE (page_id), 0.05 / source_tier AS tier_boost,
      power(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(crawled_at)) / 86400000000.0) / 90.0) AS freshness
    FROM fused f JOIN chunks c USING (chunk_id) JOIN described d USING (page_id) WHERE {condition}),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused + tier_boost, 12) DESC, sr NULLS LAST, kr NULLS LAST, chunk_id) AS position FROM found),
  results AS (SELECT * FROM best WHERE position <= 10){expand} {select}"""


RESULT = """SELECT query_id, position, chunk_id, page_id, url, title, page_type, source_tier,
  CASE WHEN length(text) > 300 THEN concat(left(text, 300), '…') ELSE text END AS snippet,
  round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(fused, 6) AS fused, round(tier_boost, 6) AS tier_boost, round(freshness, 6) AS freshness,
  'primary' AS via FROM results"""

FILTER_SQL = "page_type IN ('type0', 'type1', 'type2', 'type3', 'type4', 'type5', 'type6') AND source_tier <= 2 AND language = 'en' AND lifecycle = 'active' AND crawled_at >= TIMESTAMP '2023-10-20'"
FILTERS = SearchFilters(
    page_types=tuple(f"type{n}" for n in range(7)), tiers_max=2, language="en", lifecycle="active", crawled_from=datetime(2023, 10, 20)
)

EXPAND = """,
  parents AS (SELECT query_id, page_id AS src_page_id, min(position) AS parent FROM results GROUP BY ALL),
  ways AS (SELECT query_id, dst_page_id, parent, edge_type, weight, edge_id, row_number() OVER (PARTITION BY query_id, dst_page_id ORDER BY parent, edge_type, weight DESC, edge_id) AS way
    FROM parents JOIN doc_edges USING (src_page_id) WHERE edge_type IN ('prerequisite', 'see_also', 'part_of')
      AND NOT EXISTS (SELECT 1 FROM parents x WHERE x.query_id = parents.query_id AND x.src_page_id = dst_page_id)),
  added AS (SELECT w.query_id, c.chunk_id, d.page_id, d.title, (SELECT max(position) FROM results r WHERE r.query_id = w.query_id)
      + row_number() OVER (PARTITION BY w.query_id ORDER BY parent, edge_type, weight DESC, edge_id) AS position
    FROM ways w JOIN chunks c ON c.page_id = w.dst_page_id AND c.ord = 0 JOIN described d ON d.page_id = w.dst_page_id WHERE way = 1)"""

CORPUS_VIEWS = ("doc_pages", "doc_sources", "doc_edges")


def document_corpus(t, mode: str = "hybrid") -> Corpus:
    """Documents as an indexed corpus; chunk table and text index are written once, the index only for modes that read it."""
    chunks = _chunks(t)
    pages, sources = t("doc_pages").drop("html"), t("doc_sources")
    vectors = embed.vector_rows(chunks, pages, sources)
    index = build_index(chunks) if mode == "semantic" else _stored_index(chunks)
    return Corpus(chunks, pages, sources, vectors, index, t("doc_edges"))


def passage_queries(t):
    return _passages(t).withColumn("embedding", embed.embedding(F.col("text")))


def _search(t, **options):
    wanted = SearchOptions(as_of=AS_OF, top_k=TOP_K, **options)
    found = hybrid_search(passage_queries(t), document_corpus(t, wanted.mode), wanted)
    return found.drop("heading_path")


@query(_hybrid_oracle("true", RESULT), CORPUS_VIEWS)
def hybrid_search_all(t):
    return _search(t)


@query(_hybrid_oracle(FILTER_SQL, RESULT), CORPUS_VIEWS)
def hybrid_search_filtered(t):
    return _search(t, filters=FILTERS)


@query(_hybrid_oracle(FILTER_SQL, RESULT, filter_first=True), CORPUS_VIEWS)
def hybrid_search_filtered_first(t):
    """The keyword arm is filtered before it is cut to its candidates."""
    return _search(t, filters=FILTERS, filter_before_cut=True)


@query(_hybrid_oracle("page_type = 'type3'", RESULT, arms="semantic"), CORPUS_VIEWS)
def semantic_search(t):
    """One page type asked for: the search stays in that namespace."""
    return _search(t, mode="semantic", filters=SearchFilters(page_types=("type3",)))


@query(_hybrid_oracle("true", RESULT, arms="keyword"), CORPUS_VIEWS)
def keyword_search(t):
    return _search(t, mode="keyword")


@query(
    _hybrid_oracle(
        FILTER_SQL,
        """SELECT query_id, position, chunk_id, page_id, title, 'primary' AS via FROM results
           UNION ALL SELECT query_id, position, chunk_id, page_id, title, 'relationship' FROM added""",
        EXPAND,
    ),
    CORPUS_VIEWS,
)
def hybrid_expand(t):
    found = _search(t, filters=FILTERS, expand=True)
    return found.select("query_id", "position", "chunk_id", "page_id", "title", "via")


# ---- the stored tables and their reconciliation ----------------------------------------

# Documents as pages, their whole texts as chunks, with damage on purpose: chunks of
# Spanish pages have no vector, French ledger rows have another namespace, ledger rows of
# pages `type5` have lost their chunk, some edges lead nowhere, images of one source are gone,
# and the stored text index has lost its postings of French pages.
STORE = """
  st_pages AS (SELECT page_id, source_id, page_type, lifecycle, language FROM doc_pages),
  st_chunks AS (SELECT concat(page_id, ':0') AS chunk_id, page_id FROM doc_pages WHERE page_type <> 'type5'),
  st_ledger AS (SELECT concat(page_id, ':0') AS chunk_id, concat(page_id, ':0') AS vector_id, CASE WHEN language = 'fr' THEN NULL ELSE page_type END AS namespace
                FROM doc_pages WHERE language <> 'es'),
  st_images AS (SELECT concat('i', page_id) AS image_id, page_id FROM doc_pages WHERE source_id <> 'src7'),
  st_links AS (SELECT concat(page_id, ':0') AS chunk_id, concat('i', page_id) AS image_id FROM doc_pages)"""


def damaged_store(t, index: bool = False) -> verify.Store:
    """The tables, with `index` the text index as a written table."""
    docs = t("doc_pages")
    chunk_id = F.concat("page_id", F.lit(":0"))
    chunk = [chunk_id.alias("chunk_id"), "page_id", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("heading_path"), F.col("html").alias("text")]
    chunks = docs.filter("page_type <> 'type5'").select(*chunk)
    counted = count_words(docs.filter("page_type <> 'type5' AND language <> 'fr'").select(*chunk))
    ledger = docs.filter("language <> 'es'").select(
        chunk_id.alias("chunk_id"), F.lit(MODEL).alias("model"), chunk_id.alias("vector_id"),
        F.when(F.col("language") != "fr", F.col("page_type")).alias("namespace"), F.lit(AS_OF).cast("timestamp").alias("indexed_at"),
    )
    image_id = F.concat(F.lit("i"), "page_id")
    events = docs.select(
        "page_id", F.lit("v1").alias("rule_id"), F.lit("validate").alias("phase"), F.when(F.col("title").isNull(), "fail").otherwise("pass").alias("outcome")
    )
    return verify.Store(
        sources=t("doc_sources"),
        pages=docs,
        sections=docs.filter("language = 'en'").select("page_id"),
        chunks=chunks,
        images=docs.filter("source_id <> 'src7'").select(image_id.alias("image_id"), "page_id", F.concat(F.lit("/i/"), "page_id").alias("url")),
        chunk_images=docs.select(chunk_id.alias("chunk_id"), image_id.alias("image_id")),
        edges=t("doc_edges"),
        entities=docs.select("title", "page_type").distinct(),
        ledger=ledger,
        rules=_rules(t),
        rule_events=events,
        text_index=index_of(cut_lineage(counted) if index else counted),
    )


VIEWS = ("doc_pages", "doc_sources", "doc_edges")


@query(
    f"""WITH {STORE} SELECT
          (SELECT count(*) FROM st_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM st_ledger)) AS chunks_lacking_embedding,
          (SELECT count(*) FROM st_ledger WHERE chunk_id NOT IN (SELECT chunk_id FROM st_chunks)) AS orphan_embeddings,
          (SELECT count(*) FROM st_ledger l JOIN st_chunks USING (chunk_id) JOIN st_pages USING (page_id) WHERE coalesce(namespace, '') <> page_type) AS namespace_drift,
          (SELECT count(*) FROM doc_edges WHERE dst_page_id NOT IN (SELECT page_id FROM st_pages)) AS dangling_edges,
          (SELECT count(*) FROM st_links WHERE chunk_id NOT IN (SELECT chunk_id FROM st_chunks) OR image_id NOT IN (SELECT image_id FROM st_images)) AS dangling_chunk_images,
          (SELECT CAST(count(*) = 0 AS INT) FROM doc_pages WHERE page_type <> 'type5' AND language = 'fr' AND regexp_matches(html, '[\\p{{L}}\\p{{N}}]')) AS index_consistent, (SELECT count(*) FROM doc_pages WHERE title IS NULL) AS pages_with_validation_failures, 0 AS ok""",
    VIEWS,
)
def verify_report(t):
    return verify.verify_report(damaged_store(t, index=True), MODEL)


@query(
    f"""WITH {STORE}
        SELECT 'chunks_lacking_embedding' AS drift, chunk_id AS id FROM st_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM st_ledger)
        UNION ALL SELECT 'orphan_embeddings', chunk_id FROM st_ledger WHERE chunk_id NOT IN (SELECT chunk_id FROM st_chunks)
        UNION ALL SELECT 'namespace_drift', l.chunk_id FROM st_ledger l JOIN st_chunks USING (chunk_id) JOIN st_pages USING (page_id) WHERE coalesce(namespace, '') <> page_type
        UNION ALL SELECT 'dangling_edges', edge_id FROM doc_edges WHERE dst_page_id NOT IN (SELECT page_id FROM st_pages)
        UNION ALL SELECT 'dangling_chunk_images', chunk_id FROM st_links WHERE chunk_id NOT IN (SELECT chunk_id FROM st_chunks) OR image_id NOT IN (SELECT image_id FROM st_images)""",
    VIEWS,
)
def drift_rows(t):
    store = damaged_store(t)
    lists = {
        "chunks_lacking_embedding": verify.chunks_lacking_embedding(store.chunks, store.ledger, MODEL),
        "orphan_embeddings": verify.orphan_embeddings(store.chunks, store.ledger),
        "namespace_drift": verify.namespace_drift(store.chunks, store.pages, store.ledger),
        "dangling_edges": verify.dangling_edges(store.edges, store.pages).withColumnRenamed("edge_id", "chunk_id"),
        "dangling_chunk_images": verify.dangling_chunk_images(store.chunk_images, store.chunks, store.images),
    }
    result = None
    for name, df in lists.items():
        part = df.select(F.lit(name).alias("drift"), F.col("chunk_id").alias("id"))
        result = part if result is None else result.unionByName(part)
    return result


@query(
    f"""WITH {STORE} SELECT (SELECT count(*) FROM doc_sources) AS sources, (SELECT count(*) FROM st_pages) AS pages,
          (SELECT count(*) FROM st_pages WHERE language = 'en') AS sections, (SELECT count(*) FROM st_chunks) AS chunks,
          (SELECT count(*) FROM st_images) AS images, (SELECT count(*) FROM doc_edges) AS edges,
          (SELECT count(*) FROM (SELECT DISTINCT title, page_type FROM doc_pages)) AS entities, (SELECT count(*) FROM st_ledger) AS embeddings,
          {len(RULES)} AS rules, (SELECT count(*) FROM doc_pages) AS rule_events""",
    VIEWS,
)
def corpus_stats(t):
    return verify.corpus_stats(damaged_store(t))


@query("SELECT lifecycle, count(*) AS pages FROM site_pages GROUP BY lifecycle", ("site_pages",))
def pages_by_lifecycle(t):
    return verify.pages_by_lifecycle(t("site_pages"))


@query(
    f"""WITH {STORE} SELECT chunk_id, page_id, CAST(chunk_id IN (SELECT chunk_id FROM st_ledger) AS INT) AS has_embedding FROM st_chunks""",
    VIEWS,
)
def chunk_flags(t):
    store = damaged_store(t)
    return lookups.chunk_items(store.chunks, store.ledger).select("chunk_id", "page_id", "has_embedding")


@query(f"WITH {STORE} SELECT page_id, '{MODEL}' AS model, vector_id FROM st_chunks JOIN st_ledger USING (chunk_id)", VIEWS)
def page_vector_ids(t):
    store = damaged_store(t)
    return lookups.vector_ids_of_pages(store.chunks, store.ledger)


@query(f"WITH {STORE} SELECT chunk_id, image_id, concat('/i/', page_id) AS url FROM st_links JOIN st_images USING (image_id)", VIEWS)
def chunk_image_list(t):
    store = damaged_store(t)
    return lookups.images_of_chunks(store.chunk_images, store.images).select("chunk_id", "image_id", "url")


@query(
    f"""WITH {STORE}, renewed AS (SELECT chunk_id, vector_id, 'again' AS namespace FROM st_ledger WHERE namespace IS NULL)
        SELECT chunk_id, vector_id, coalesce(namespace, 'again') AS namespace FROM st_ledger
        UNION ALL SELECT chunk_id, chunk_id, 'new' FROM st_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM st_ledger)""",
    VIEWS,
)
def ledger_upsert(t):
    """Chunks with a lost namespace and chunks without a vector are embedded again."""
    store = damaged_store(t)
    stamp = F.lit(AS_OF).cast("timestamp").alias("indexed_at")
    lost = store.ledger.filter("namespace IS NULL").withColumn("namespace", F.lit("again"))
    lacking = verify.chunks_lacking_embedding(store.chunks, store.ledger, MODEL).select(
        "chunk_id", F.lit(MODEL).alias("model"), F.col("chunk_id").alias("vector_id"), F.lit("new").alias("namespace"), stamp
    )
    return upsert.upsert_embedding_ledger(store.ledger, lost.unionByName(lacking)).select("chunk_id", "vector_id", "namespace")


@query(
    f"""WITH {SITE_PARTS}, s AS (SELECT page_id, source_id FROM site_pages WHERE source_id <> 'org'),
          b AS (SELECT page_id, count(*) AS blocks FROM blocks GROUP BY page_id)
        SELECT page_id, 1 AS sections, CAST(heading <> '' AS INT) AS has_markdown, 1 AS vectors_match, 1 AS ledger_match
        FROM s JOIN heads USING (page_id) JOIN b USING (page_id)""",
    ("site_pages",),
)
def index_job(t):
    """The whole index run over the crawled pages of known sources, summed up per page."""
    site = t("site_pages").withColumn("raw_key", upsert.raw_key(F.col("page_id"))).withColumn("title", F.lit(None).cast("string"))
    site = site.withColumn("crawled_at", F.lit(AS_OF).cast("timestamp"))
    sources = t("sources").filter("source_id <> 'org'")
    ready, _ = ready_pages(site.drop("html"), site.select("page_id", "html"), sources)
    no_rules = t.rows([], "source_id string, truncate_after array<string>, drop_sections array<string>, drop_blocks array<string>")
    done = index_pages(ready.drop("source_tier"), site.drop("html"), sources, no_rules, MODEL, AS_OF)
    sections = done.sections.groupBy("page_id").agg(F.count(F.lit(1)).alias("sections"))
    chunks = done.chunks.groupBy("page_id").agg(F.count(F.lit(1)).alias("_chunks"))
    vectors = done.vectors.filter(F.size("embedding") == 768).groupBy("page_id").agg(F.countDistinct("vector_id").alias("_vectors"))
    ledger = done.ledger.groupBy(F.substring_index("chunk_id", ":", 1).alias("page_id")).agg(F.count(F.lit(1)).alias("_ledger"))
    joined = sections.join(chunks, "page_id").join(vectors, "page_id").join(ledger, "page_id").join(done.markdown, "page_id")
    return joined.select(
        "page_id",
        "sections",
        F.startswith("markdown", F.lit("# ")).alias("has_markdown"),
        (F.col("_chunks") == F.col("_vectors")).alias("vectors_match"),
        (F.col("_chunks") == F.col("_ledger")).alias("ledger_match"),
    )
