"""Inputs derived from the driver's tables, as the SQL text both engines run.

Spark gets the tables as named DataFrames, an oracle gets the same text as a chain of CTEs.
Each entry is `name -> (inputs, text)`; `{name}` stands for an input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightloom.sources.tables import read_table

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # Typed event log; the sources mix upper and lower case on purpose.
    "typed_events": (
        ("events",),
        """SELECT CAST(event_id AS STRING) AS event_id, user_id, concat('app.', event_type) AS type, ts AS occurred_at,
             concat('{{"source":"', CASE WHEN event_id % 3 = 0 THEN 'web' WHEN event_id % 3 = 1 THEN 'Mobile' ELSE 'mobile' END,
                    '","level":', CAST(event_id % 20 + 1 AS STRING), '}}') AS payload_json, event_id AS seq
           FROM {events}""",
    ),
    # Deliveries: purchases arrive twice under one id, errors once more under a new id.
    "incoming_events": (
        ("typed_events",),
        """SELECT event_id, user_id, type, occurred_at, payload_json, seq FROM {typed_events}
           UNION ALL SELECT event_id, user_id, type, occurred_at, payload_json, seq + 100000000000 FROM {typed_events}
             WHERE type = 'app.purchase'
           UNION ALL SELECT concat('r', event_id), user_id, type, occurred_at, payload_json, seq + 200000000000 FROM {typed_events}
             WHERE type = 'app.error'""",
    ),
    "play_sessions": (
        ("typed_events",),
        """SELECT concat(CAST(user_id AS STRING), '-', CAST(s AS STRING)) AS session_id, user_id, min(occurred_at) AS started_at,
             CASE WHEN s % 7 = 0 THEN NULL ELSE max(occurred_at) END AS ended_at, count(*) AS event_count
           FROM (SELECT user_id, occurred_at, sum(CASE WHEN prev IS NULL OR occurred_at > prev + INTERVAL '12' HOUR THEN 1 ELSE 0 END)
                   OVER (PARTITION BY user_id ORDER BY occurred_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
                 FROM (SELECT user_id, occurred_at, seq, lag(occurred_at) OVER (PARTITION BY user_id ORDER BY occurred_at, seq) AS prev
                       FROM {typed_events}) a) b
           GROUP BY user_id, s""",
    ),
    "achievements": (
        ("typed_events",),
        """SELECT user_id, type AS code, count(*) >= 15 AS unlocked, count(*) AS progress_numerator, 15 AS progress_denominator,
             CASE WHEN count(*) >= 15 THEN max(occurred_at) END AS unlocked_at
           FROM {typed_events} GROUP BY user_id, type""",
    ),
    "outbox": (
        ("typed_events",),
        """SELECT event_id, CAST(seq % 12 AS INT) AS attempts,
             CASE WHEN seq % 12 >= 10 THEN 'dead_lettered' WHEN seq % 4 = 0 THEN 'pending' ELSE 'synced' END AS status,
             CASE WHEN seq % 8 = 0 THEN occurred_at + INTERVAL '1' DAY END AS next_attempt_at, occurred_at AS created_at
           FROM {typed_events}""",
    ),
    "sources": (
        (),
        """SELECT 'com' AS source_id, 1 AS tier UNION ALL SELECT 'net', 2 UNION ALL SELECT 'org', 2""",
    ),
    "site_pages": (
        ("pages",),
        """SELECT CAST(page_id AS STRING) AS page_id, regexp_extract(url, 'example[.]([a-z]+)', 1) AS source_id, url, html,
             concat('type', CAST(page_id % 11 AS STRING)) AS page_type, 'en' AS language,
             CASE WHEN page_id % 13 = 0 THEN 'deprecated' ELSE 'active' END AS lifecycle, page_id AS seq
           FROM {pages}""",
    ),
    # Documents as pages: titles repeat across sources, URLs differ in a tracking parameter.
    "doc_pages": (
        ("documents",),
        """SELECT CAST(doc_id AS STRING) AS page_id, source AS source_id,
             concat('https://Docs.example/d/', CAST(doc_id % 900 AS STRING), '?utm=', CAST(doc_id AS STRING), '&v=1#top') AS url,
             text AS html, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE concat('The Doc ', CAST(doc_id % 303 AS STRING)) END AS title,
             concat('type', CAST(doc_id % 303 % 11 AS STRING)) AS page_type, lang AS language,
             CASE WHEN doc_id % 13 = 0 THEN 'deprecated' ELSE 'active' END AS lifecycle,
             TIMESTAMP '2024-01-30 00:00:00' - CAST(doc_id % 120 AS INT) * INTERVAL '1' DAY AS crawled_at, doc_id AS seq
           FROM {documents}""",
    ),
    "doc_sources": (
        ("documents",),
        """SELECT source AS source_id, 1 + length(source) % 3 AS tier FROM {documents} GROUP BY source""",
    ),
    "vectors": (
        ("embeddings",),
        """SELECT CAST(vec_id AS STRING) AS vector_id, embedding, concat('type', CAST(label AS STRING)) AS namespace, label % 3 + 1 AS source_tier
           FROM {embeddings}""",
    ),
    # Every benchmark item searches with its text and with the vector stored under its number.
    "search_queries": (
        ("benchmark", "embeddings"),
        """SELECT CAST(b.item_id AS STRING) AS query_id, b.text, e.embedding, concat('type', CAST(e.label AS STRING)) AS namespace
           FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id""",
    ),
    # A graph over documents; some destinations do not exist.
    "doc_edges": (
        ("documents",),
        """SELECT concat('e', CAST(doc_id AS STRING)) AS edge_id, CAST(doc_id AS STRING) AS src_page_id,
             CAST((doc_id * 7 + 3) % 1100 AS STRING) AS dst_page_id,
             CASE WHEN doc_id % 4 = 0 THEN 'prerequisite' WHEN doc_id % 4 = 1 THEN 'see_also'
                  WHEN doc_id % 4 = 2 THEN 'part_of' ELSE 'link' END AS edge_type, 1.0 AS weight
           FROM {documents}""",
    ),
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A derived view, or one of the driver's tables."""
    if name not in VIEWS:
        return read_table(spark, root, name)
    inputs, text = VIEWS[name]
    return spark.sql(text, **{i: table(spark, root, i) for i in inputs}) if inputs else spark.sql(text)


def with_views(names: list[str], query: str) -> str:
    """An oracle query preceded by the views it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for needed in VIEWS[name][0]:
                visit(needed)
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return query
    ctes = []
    for name in ordered:
        inputs, text = VIEWS[name]
        ctes.append(f"{name} AS ({text.format(**{i: i for i in inputs})})")
    joined = ", ".join(ctes)
    head, _, rest = query.lstrip().partition(" ")
    if head.upper() == "WITH":
        # The query's own CTEs follow the views.
        return f"WITH RECURSIVE {joined}, {rest.removeprefix('RECURSIVE ')}"
    return f"WITH {joined} {query}"
