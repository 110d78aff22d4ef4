"""Queries over pages: rules, extraction, cleaning, chunks, graph, upserts and listings."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from brightloom.functions import scalars as S
from brightloom.functions import text as X
from brightloom.functions import urls as U
from brightloom.functions.html import DropRules
from brightloom.operators import embed, graph, lookups, rules, upsert, writes
from brightloom.operators import pages as P
from brightloom.plans.registry import query
from brightloom.session import cut_lineage, ensure_checkpoint_dir
from brightloom.sources import pages as SP

AS_OF = datetime(2024, 1, 31)
SITE_RULES = DropRules(class_prefixes=("navbox",))
PAGE_TYPES = [f"type{n}" for n in range(9)]

RULES = [
    ("n1", "normalize", "canonical_url", json.dumps({"stripParams": ["utm"]}), "error", True, 10),
    ("n2", "normalize", "collapse_whitespace", "{}", "error", True, 20),
    ("n3", "normalize", "derive_summary", json.dumps({"maxChars": 120}), "error", True, 30),
    ("n4", "normalize", "require_title", "{}", "error", True, 40),
    ("v1", "validate", "require_title", "{}", "error", True, 10),
    ("v2", "validate", "min_text_len", json.dumps({"min": 200}), "error", True, 20),
    ("v3", "validate", "allowed_page_type", json.dumps({"allowed": PAGE_TYPES}), "error", True, 30),
    ("v4", "validate", "language_is_en", "{}", "warn", True, 40),
    ("v5", "validate", "language_is_en", "{}", "error", False, 50),
    ("d1", "dedup", "near_duplicate_hash", "{}", "error", True, 10),
    ("d2", "dedup", "same_canonical_url", "{}", "error", True, 20),
]
RULES_SCHEMA = "rule_id string, phase string, kind string, params string, severity string, enabled boolean, priority int"

# White space as the library counts it, for the oracles' regular expressions.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS_IN_LINE = WS.replace(r"\n", "")


def _trim(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[{WS}]+|[{WS}]+\z', '', 'g')"


NORMALIZED = rf"""
  u AS (SELECT *, concat('https://docs.example/d/', doc, '?v=1') AS canonical_url,
          {_trim(rf"regexp_replace(regexp_replace(regexp_replace(html, '[ \t]+', ' ', 'g'), '[{WS_IN_LINE}]+(\n|\z)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")} AS tidy
        FROM (SELECT *, regexp_extract(url, '/d/([0-9]+)', 1) AS doc FROM doc_pages)),
  paragraphs AS (SELECT *, coalesce(list_filter(list_transform(regexp_split_to_array(tidy, '\n[{WS}]*\n'),
                   lambda p: {_trim('p')}), lambda p: p <> '')[1], '') AS para FROM u),
  n AS (SELECT *, CASE WHEN length(para) > 120 THEN regexp_replace(left(para, 120), '[{WS}]+\z', '') WHEN para <> '' THEN para END AS summary
        FROM paragraphs)"""

VALIDATED = NORMALIZED + """,
  v AS (SELECT *, coalesce(length(title), 0) = 0 AS no_title, length(tidy) < 200 AS short,
          page_type NOT IN ('type0','type1','type2','type3','type4','type5','type6','type7','type8') AS bad_type, language <> 'en' AS not_en
        FROM n)"""


def _rules(t):
    return t.rows(RULES, RULES_SCHEMA)


def _normalized(t):
    return rules.normalize(rules.page_candidates(t("doc_pages")), rules.load_rules(_rules(t), "normalize"))


@query(
    f"WITH {NORMALIZED} SELECT page_id, canonical_url, sha256(tidy) AS text_hash, summary FROM n",
    ("doc_pages",),
)
def rules_normalize(t):
    done = _normalized(t)
    return done.select("page_id", "canonical_url", F.sha2("text", 256).alias("text_hash"), "summary")


@query(
    """SELECT doc_id, form, CASE form
         WHEN 0 THEN 'https://docs.example/a/' || doc_id || '/d%20e?q=' || doc_id % 7
         WHEN 1 THEN 'http://me:pw' || doc_id || '@docs.example/' || source || '/'
         WHEN 2 THEN 'https://docs.example:8443/' || doc_id || '//x?a=1+2'
         WHEN 3 THEN 'mailto:' || source || doc_id || '@docs.example'
         WHEN 4 THEN 'https://docs.example/' || lang || '/%C3%A9' || doc_id END AS canonical
       FROM documents, unnest([0, 1, 2, 3, 4, 5]) AS u(form)"""
)
def canonical_urls(t):
    """Each document's address in forms that differ from the standard one."""
    doc = F.col("doc_id").cast("string")
    written = [
        F.concat(F.lit(" HTTPS://Docs.Example:443/a/./b/../"), doc, F.lit("/d e?utm=5&q="), (F.col("doc_id") % 7).cast("string"), F.lit("#top\n")),
        F.concat(F.lit("http://me:pw"), doc, F.lit("@docs.EXAMPLE:80/../"), F.col("source"), F.lit("/x/..#f")),
        F.concat(F.lit("https:\\\\docs.example:8443\\"), doc, F.lit("//x/%2e%2E/x?&a=1%202&utm")),
        F.concat(F.lit("MailTo:"), F.col("source"), doc, F.lit("@docs.example#f")),
        F.concat(F.lit("https://docs.example/"), F.col("lang"), F.lit("/%2E/é"), doc, F.lit("?utm=")),
        F.concat(F.lit("https://docs example/"), doc),
    ]
    rows = t("documents").select("doc_id", F.col("source"), F.posexplode(F.array(*written)).alias("form", "url"))
    return rows.select("doc_id", "form", U.canonical_url(F.col("url"), ["utm"]).alias("canonical"))


@query(
    f"""WITH {VALIDATED} SELECT page_id, CAST(NOT (no_title OR short OR bad_type) AS INT) AS passed,
          concat_ws('|', CASE WHEN no_title THEN 'missing title' END,
            CASE WHEN short THEN concat('text length ', length(tidy), ' < 200') END,
            CASE WHEN bad_type THEN concat('page_type ', page_type, ' not allowed') END,
            CASE WHEN not_en THEN concat('language ', language, ' != en') END) AS faults FROM v""",
    ("doc_pages",),
)
def rules_validate(t):
    done = rules.validate(_normalized(t).drop("outcomes"), rules.load_rules(_rules(t), "validate"))
    faults = F.transform(F.filter("outcomes", lambda o: o["status"].isin("fail", "warn")), lambda o: o["detail"])
    return done.select("page_id", "passed", F.array_join(faults, "|").alias("faults"))


@query(
    f"""WITH {VALIDATED},
          one AS (SELECT 'n1' AS rule_id, 'normalize' AS phase, CASE WHEN canonical_url <> url THEN 'applied' ELSE 'skipped' END AS outcome FROM v
            UNION ALL SELECT 'n2', 'normalize', CASE WHEN tidy <> html THEN 'applied' ELSE 'skipped' END FROM v
            UNION ALL SELECT 'n3', 'normalize', CASE WHEN summary IS NOT NULL THEN 'applied' ELSE 'skipped' END FROM v
            UNION ALL SELECT 'n4', 'normalize', 'skipped' FROM v
            UNION ALL SELECT 'v1', 'validate', CASE WHEN no_title THEN 'fail' ELSE 'pass' END FROM v
            UNION ALL SELECT 'v2', 'validate', CASE WHEN short THEN 'fail' ELSE 'pass' END FROM v
            UNION ALL SELECT 'v3', 'validate', CASE WHEN bad_type THEN 'fail' ELSE 'pass' END FROM v
            UNION ALL SELECT 'v4', 'validate', CASE WHEN not_en THEN 'warn' ELSE 'pass' END FROM v)
        SELECT rule_id, phase, outcome, count(*) AS pages FROM one GROUP BY ALL""",
    ("doc_pages",),
)
def rules_outcomes(t):
    done = rules.validate(_normalized(t), rules.load_rules(_rules(t), "validate"))
    events = rules.rule_events(done, F.lit(AS_OF).cast("timestamp"))
    return events.groupBy("rule_id", "phase", "outcome").agg(F.count(F.lit(1)).alias("pages"))


@query(
    f"""WITH {VALIDATED} SELECT DISTINCT page_id FROM v WHERE no_title OR short OR bad_type""",
    ("doc_pages",),
)
def pages_failing_validation(t):
    done = rules.validate(_normalized(t), rules.load_rules(_rules(t), "validate"))
    return rules.pages_failing_validation(rules.rule_events(done, F.lit(AS_OF).cast("timestamp")))


DEDUPED = """
  h AS (SELECT page_id, source_id, canonical, seq, html, first_value(page_id) OVER g AS first_page, seq = min(seq) OVER g AS is_first
        FROM (SELECT page_id, source_id, seq, html, concat('https://docs.example/d/', regexp_extract(url, '/d/([0-9]+)', 1), '?v=1') AS canonical
              FROM candidates) WINDOW g AS (PARTITION BY source_id, html ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  c AS (SELECT *, arg_min(CASE WHEN is_first THEN page_id END, CASE WHEN is_first THEN seq END) OVER (PARTITION BY source_id, canonical) AS first_same_url
        FROM h),
  d AS (SELECT *, CASE WHEN NOT is_first THEN 'skip' WHEN first_same_url <> page_id THEN 'merge' ELSE 'insert' END AS action FROM c)"""


@query(
    f"""WITH candidates AS (SELECT * FROM doc_pages), {DEDUPED}
        SELECT page_id, action, CASE action WHEN 'skip' THEN first_page WHEN 'merge' THEN first_same_url END AS other FROM d""",
    ("doc_pages",),
)
def rules_dedup(t):
    # Narrow rows, written once: the decision reads them several times, the text only here.
    pages = cut_lineage(
        t("doc_pages").select(
            "page_id", "source_id", "seq", F.sha2("html", 256).alias("content_hash"), U.canonical_url(F.col("url"), ["utm"]).alias("canonical_url")
        )
    )
    empty = pages.filter(F.lit(False))
    done = rules.dedup(pages, empty, rules.load_rules(_rules(t), "dedup"))
    detail = F.array_join(F.transform("outcomes", lambda o: o["detail"]), "")
    other = F.nullif(F.regexp_extract(detail, "([0-9]+)$", 1), F.lit(""))
    return done.select("page_id", "action", other.alias("other"))


@query(
    """WITH base AS (SELECT page_id, source_id, seq, html, page_type IN ('type0', 'type2') AS held,
                       concat('https://docs.example/d/', regexp_extract(url, '/d/([0-9]+)', 1), '?v=1') AS canonical FROM doc_pages),
            s AS (SELECT page_id, source_id, html, canonical FROM base WHERE held),
            b AS (SELECT concat('a-', page_id) AS page_id, source_id, seq * 3 AS seq, html, canonical FROM base
                  UNION ALL SELECT concat('b-', page_id), source_id, seq * 3 + 1, html, concat(canonical, '&moved=1') FROM base
                  UNION ALL SELECT concat('c-', page_id), source_id, seq * 3 + 2, concat(html, 'changed'), canonical FROM base),
            own AS (SELECT source_id, html, arg_min(canonical, seq) AS canonical, arg_min(page_id, seq) AS page_id, min(seq) AS arrived
                    FROM b ANTI JOIN s USING (source_id, html) GROUP BY source_id, html),
            refs AS (SELECT source_id, html, canonical, page_id, -1 AS arrived FROM s UNION ALL SELECT source_id, html, canonical, page_id, arrived FROM own),
            h AS (SELECT source_id, html, min(arrived) AS h_at, first(page_id ORDER BY arrived, page_id) AS h_page FROM refs GROUP BY ALL),
            u AS (SELECT source_id, canonical, min(arrived) AS u_at, first(page_id ORDER BY arrived, page_id) AS u_page FROM refs GROUP BY ALL)
       SELECT b.page_id, CASE WHEN h_at < seq THEN 'skip' WHEN u_at < seq THEN 'merge' ELSE 'insert' END AS action,
              CASE WHEN h_at < seq THEN h_page WHEN u_at < seq THEN u_page END AS other
       FROM b LEFT JOIN h USING (source_id, html) LEFT JOIN u USING (source_id, canonical)""",
    ("doc_pages",),
)
def dedup_stored(t):
    """Pages crawled again, at another URL and with other bytes, against a store that holds two page types."""
    known = t("doc_pages").select("page_id", "source_id", "seq", "page_type", "html", U.canonical_url(F.col("url"), ["utm"]).alias("canonical_url"))
    hashed = [F.sha2("html", 256).alias("content_hash"), F.sha2(F.concat("html", F.lit("changed")), 256).alias("_changed")]
    known = cut_lineage(known.select("page_id", "source_id", "seq", "page_type", "canonical_url", *hashed))
    ways = [("a-", F.col("canonical_url"), F.col("content_hash")), ("b-", F.concat("canonical_url", F.lit("&moved=1")), F.col("content_hash")), ("c-", F.col("canonical_url"), F.col("_changed"))]
    crawl = F.inline(F.array(*[
        F.struct(F.concat(F.lit(mark), "page_id").alias("page_id"), (F.col("seq") * 3 + n).alias("seq"), url.alias("canonical_url"), bytes_.alias("content_hash"))
        for n, (mark, url, bytes_) in enumerate(ways)
    ]))
    done = rules.dedup(known.select("source_id", crawl), known.filter("page_type IN ('type0', 'type2')"), rules.load_rules(_rules(t), "dedup"))
    detail = F.array_join(F.transform("outcomes", lambda o: o["detail"]), "")
    return done.select("page_id", "action", F.nullif(F.regexp_extract(detail, "((?:[abc]-)?[0-9]+)$", 1), F.lit("")).alias("other"))


@query(
    f"""WITH {VALIDATED}, candidates AS (SELECT * FROM v WHERE NOT (no_title OR short OR bad_type) AND language <> 'de'), {DEDUPED}
        SELECT v.page_id, CASE WHEN v.language = 'de' AND seq_even THEN 'unchanged' WHEN no_title OR short OR bad_type THEN 'rejected'
                               WHEN v.language = 'de' THEN 'stored' WHEN d.action = 'skip' THEN 'deduped' ELSE 'stored' END AS verdict
        FROM (SELECT *, page_type IN ('type0', 'type2', 'type4') AS seq_even FROM v) v LEFT JOIN d USING (page_id)""",
    ("doc_pages",),
)
def write_verdicts(t):
    """A crawl against a store that holds the German pages, some of them with other bytes.

    The stored German pages sit in a source of their own, so only equal keys matter.
    """
    requests = t("doc_pages").withColumn(
        "source_id", F.when(F.col("language") == "de", F.concat(F.lit("de-"), "page_id")).otherwise(F.col("source_id"))
    )
    same = F.col("page_type").isin("type0", "type2", "type4")
    stored = requests.filter("language = 'de'").select(
        "page_id", "source_id", "url", F.col("url").alias("canonical_url"),
        F.sha2(F.when(same, F.col("html")).otherwise(F.lit("other")), 256).alias("content_hash"),
    )
    return rules.write_flow(requests, stored, _rules(t)).select("page_id", "verdict")


@query(
    """WITH r AS (SELECT page_id, CAST(page_id AS BIGINT) AS doc, length(html) >= 200 AS ok, length(html) + 6 >= 200 AS ok_again FROM doc_pages),
            w AS (SELECT *, unnest([1, 2, 3, 4, 5, 6]) AS nth, doc % 2 = 1 AS odd FROM r)
       SELECT doc, nth,
         CASE WHEN odd AND nth = 3 THEN CASE WHEN ok_again THEN 'stored' ELSE 'rejected' END
              WHEN NOT ok THEN 'rejected'
              WHEN nth = 1 OR odd AND nth IN (4, 5) THEN 'stored'
              WHEN nth = 2 OR nth IN (4, 6) AND NOT odd THEN 'deduped'
              ELSE 'unchanged' END AS verdict,
         CASE WHEN ok AND (nth IN (1, 3, 5)) OR odd AND ok_again AND nth = 3 AND ok THEN concat(page_id, '-1')
              WHEN odd AND nth = 5 AND ok_again THEN concat(page_id, '-3')
              WHEN odd AND ok AND nth = 6 THEN concat(page_id, '-4')
              ELSE concat(page_id, '-', nth) END AS page_id
       FROM w""",
    ("doc_pages",),
)
def write_repeats(t):
    """Each page crawled three times in one batch, in turn with a twin under another URL.

    Odd pages come with other bytes in between, which frees the first bytes for the twin.
    """
    nth = F.explode(F.array(*[F.lit(n) for n in range(1, 7)]))
    doc = F.col("page_id").cast("long")
    crawled = t("doc_pages").select(
        doc.alias("doc"), nth.alias("nth"), F.concat(F.lit("w-"), "page_id").alias("source_id"), "url", "html", "page_id"
    )
    other = (F.col("doc") % 2 == 1) & (F.col("nth") == 3)
    requests = crawled.select(
        F.concat("page_id", F.lit("-"), F.col("nth").cast("string")).alias("page_id"),
        "source_id",
        F.when(F.col("nth") % 2 == 0, F.concat("url", F.lit("&twin"))).otherwise(F.col("url")).alias("url"),
        F.when(other, F.concat("html", F.lit(" again"))).otherwise(F.col("html")).alias("html"),
        (F.col("doc") * 10 + F.col("nth")).alias("seq"),
    )
    wanted = t.rows([r for r in RULES if r[0] in ("v2", "d1", "d2")], RULES_SCHEMA)
    empty = requests.filter(F.lit(False)).select("page_id", "source_id", "url", F.col("url").alias("canonical_url"), F.lit("").alias("content_hash"))
    done = writes.write_batch(requests, empty, wanted)
    return done.select(
        F.floor(F.col("seq") / 10).alias("doc"), (F.col("seq") % 10).cast("int").alias("nth"), "verdict", "page_id"
    )


@query(
    """WITH a AS (SELECT regexp_replace(title, 'The ', '') AS fact, language AS value, tier, page_id, seq
                  FROM doc_pages JOIN doc_sources USING (source_id) WHERE title IS NOT NULL),
            m AS (SELECT *, min(tier) OVER (PARTITION BY fact) AS low FROM a),
            g AS (SELECT fact, any_value(low) AS tier, count(DISTINCT CASE WHEN tier = low THEN value END) > 1 AS unresolved, count(*) AS n,
                    arg_min(value, seq) FILTER (tier = low) AS v, arg_min(page_id, seq) FILTER (tier = low) AS p FROM m GROUP BY fact)
       SELECT fact, tier, CAST(unresolved AS INT) AS unresolved, CASE WHEN NOT unresolved THEN v END AS value,
         CASE WHEN NOT unresolved THEN p END AS page_id, n - CASE WHEN unresolved THEN 0 ELSE 1 END AS losers FROM g""",
    ("doc_pages", "doc_sources"),
)
def rules_conflict(t):
    assertions = (
        t("doc_pages").filter("title IS NOT NULL").join(t("doc_sources"), "source_id")
        .select(F.replace("title", F.lit("The "), F.lit("")).alias("fact"), F.col("language").alias("value"), "tier", "page_id", "seq")
    )
    return rules.resolve_by_tier(assertions, ["fact"])


# ---- input contracts and the crawl frontier ---------------------------------------------


@query(
    """SELECT page_id, concat_ws('|', CASE WHEN source_id = '' THEN 'source_id' END, CASE WHEN url LIKE '/%' THEN 'url' END,
         CASE WHEN length(html) > 4000000 THEN 'html' END, CASE WHEN page_type IN ('type9', 'type10') THEN 'page_type' END,
         CASE WHEN length(language) < 2 THEN 'language' END) AS violations
       FROM (SELECT page_id, CASE WHEN page_type = 'type1' THEN '' ELSE source_id END AS source_id,
               CASE WHEN page_type = 'type2' THEN concat('/d/', page_id) ELSE url END AS url, html, page_type,
               CASE WHEN page_type = 'type3' THEN 'x' ELSE language END AS language FROM doc_pages)""",
    ("doc_pages",),
)
def page_request_check(t):
    kind = F.col("page_type")
    requests = (
        t("doc_pages")
        .withColumn("source_id", F.when(kind == "type1", "").otherwise(F.col("source_id")))
        .withColumn("url", F.when(kind == "type2", F.concat(F.lit("/d/"), "page_id")).otherwise(F.col("url")))
        .withColumn("language", F.when(kind == "type3", "x").otherwise(F.col("language")))
    )
    return SP.check_page_requests(requests, PAGE_TYPES).select("page_id", "violations")


@query(
    """SELECT source_id, concat_ws('|', CASE WHEN name = '' THEN 'name' END, CASE WHEN source_id LIKE '%1' THEN 'base_url' END,
         CASE WHEN tier = 0 THEN 'tier' END) AS violations
       FROM (SELECT source_id, CASE WHEN source_id LIKE '%2' THEN '' ELSE source_id END AS name, tier - 1 AS tier FROM doc_sources)""",
    ("doc_sources",),
)
def source_request_check(t):
    requests = t("doc_sources").select(
        "source_id",
        F.when(F.endswith("source_id", F.lit("2")), "").otherwise(F.col("source_id")).alias("name"),
        F.when(F.endswith("source_id", F.lit("1")), "no url").otherwise(F.concat(F.lit("https://"), "source_id")).alias("base_url"),
        (F.col("tier") - 1).alias("tier"),
        F.lit(None).cast("string").alias("license"),
    )
    return SP.check_source_requests(requests).select("source_id", "violations")


@query(
    """SELECT page_id, CASE kind WHEN 'svg' THEN 'content_type' WHEN 'bad' THEN 'data_base64' ELSE '' END AS violations,
         CASE WHEN kind <> 'bad' THEN sha256(html) END AS content_hash
       FROM (SELECT page_id, html, CASE page_type WHEN 'type4' THEN 'svg' WHEN 'type5' THEN 'bad' ELSE 'png' END AS kind FROM doc_pages)""",
    ("doc_pages",),
)
def image_request_check(t):
    kind = F.col("page_type")
    requests = t("doc_pages").select(
        "page_id",
        "url",
        F.when(kind == "type4", "image/svg+xml").otherwise("image/png").alias("content_type"),
        F.when(kind == "type5", "***").otherwise(F.base64(F.encode("html", "UTF-8"))).alias("data_base64"),
        F.lit(None).cast("string").alias("alt_text"),
        F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"),
    )
    return SP.check_image_requests(requests).select("page_id", "violations", "content_hash")


FRONTIER = """
  f AS (SELECT page_id, source_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
          regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM site_pages),
  base AS (SELECT source_id, regexp_extract(min(url), '^([a-z]+://[^/?#]+)', 1) AS origin FROM site_pages GROUP BY source_id),
  ok AS (SELECT f.source_id, f.url FROM f JOIN base USING (source_id, origin) WHERE (path LIKE '/en/%' OR path LIKE '/fr/%')
           AND NOT starts_with(substr(path, 5), '1'))"""


@query(f"WITH {FRONTIER} SELECT DISTINCT source_id, url FROM ok", ("site_pages",))
def crawl_frontier(t):
    """Each source is based at the host of its first URL."""
    first_url = t("site_pages").groupBy("source_id").agg(F.min("url").alias("base_url"))
    catalogue = first_url.withColumn("path_prefixes", F.array(F.lit("/en/"), F.lit("/fr/")))
    return SP.crawl_frontier(t("site_pages").select("source_id", "url"), catalogue, ["1"])


@query(
    """SELECT page_id, CASE WHEN title IS NULL THEN NULL WHEN source_id LIKE '%1' THEN regexp_replace(title, ' Doc .*', '') ELSE title END AS title, 'article' AS page_type
       FROM doc_pages""",
    ("doc_pages",),
)
def page_requests(t):
    catalogue = t("doc_sources").select(
        "source_id",
        F.lit("article").alias("default_page_type"),
        F.when(F.endswith("source_id", F.lit("1")), r"\s*Doc [0-9]+$").alias("title_suffix"),
    )
    crawled = t("doc_pages").select("page_id", "source_id", "url", "html", F.concat(F.lit("  "), "title", F.lit(" ")).alias("title"))
    return SP.page_requests(crawled.withColumn("title", F.rtrim("title")), catalogue).select("page_id", "title", "page_type")


@query(
    """SELECT page_id, CASE WHEN page_type = 'type1' THEN 'page_not_stored' WHEN source_id = 'src3' THEN 'source_missing'
         WHEN page_type = 'type2' THEN 'raw_missing' ELSE 'ready' END AS state FROM doc_pages""",
    ("doc_pages",),
)
def indexable_pages(t):
    pages = t("doc_pages").select(
        "page_id", "source_id", F.when(F.col("page_type") != "type1", upsert.raw_key(F.col("page_id"))).alias("raw_key")
    )
    raw = t("doc_pages").filter("page_type <> 'type2'").select("page_id", "html")
    ready, refused = SP.indexable_pages(pages, raw, t("doc_sources").filter("source_id <> 'src3'"))
    return ready.select("page_id", F.lit("ready").alias("state")).unionByName(
        refused.select("page_id", F.col("reason").alias("state"))
    )


# ---- extraction over the crawled pages -------------------------------------------------

# A reading of the crawled pages' own markup that is good enough for them: no lists or
# tables in the article, every paragraph opened by a bare <p>.
SITE_PARTS = rf"""
  a AS (SELECT page_id, html, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS article FROM site_pages),
  raw AS (SELECT page_id, unnest(string_split(article, '<p>')[2:]) AS part, generate_subscripts(string_split(article, '<p>')[2:], 1) AS i FROM a),
  cut AS (SELECT page_id, i, regexp_replace(string_split(part, '</p>')[1], '<[^>]*>', '', 'g') AS piece FROM raw),
  clean AS (SELECT page_id, i, {_trim(rf"regexp_replace(replace(replace(replace(replace(piece, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[{WS}]+', ' ', 'g')")} AS text FROM cut),
  blocks AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS ord, text FROM clean WHERE text <> ''),
  heads AS (SELECT page_id, {_trim(rf"regexp_replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&quot;', chr(34)), '&amp;', '&'), '[{WS}]+', ' ', 'g')")} AS heading,
              {_trim(rf"regexp_replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', chr(34)), '&amp;', '&'), '[{WS}]+', ' ', 'g')")} AS title FROM site_pages)"""


@query(f"WITH {SITE_PARTS} SELECT page_id, title, heading FROM heads", ("site_pages",))
def page_titles(t):
    done = P.extract_pages(t("site_pages"))
    return done.select("page_id", F.col("html_title").alias("title"), F.get(F.col("sections"), F.lit(0))["heading"].alias("heading"))


@query(
    f"WITH {SITE_PARTS} SELECT b.page_id, ord, heading AS heading_path, text FROM blocks b JOIN heads USING (page_id)",
    ("site_pages",),
)
def page_blocks(t):
    return P.page_blocks(P.extract_pages(t("site_pages")))


# ---- marked-up documents: every document's lines as a page with sections, lists and links

MARKUP_ORACLE = rf"""
  lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
              generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  placed AS (SELECT *, concat('Doc ', doc_id % 300) AS top, concat('Part ', i // 4) AS part, concat('Sub ', i) AS sub,
               (SELECT 0) AS z FROM lines),
  pathed AS (SELECT *, CASE WHEN i % 4 >= 2 THEN concat(top, ' > ', part, ' > Sub ', i - i % 2) ELSE concat(top, ' > ', part) END AS heading_path FROM placed),
  texts AS (SELECT doc_id, source, 3 * i AS k, heading_path, {_trim(rf"regexp_replace(concat(line, ' see ', i), '[{WS}]+', ' ', 'g')")} AS text FROM pathed
            UNION ALL SELECT doc_id, source, 3 * i + 2, heading_path, concat('item ', i) FROM pathed),
  m_blocks AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, source AS source_id,
                 CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS ord, heading_path, text FROM texts),
  heads AS (SELECT doc_id, -1 AS k, 1 AS level, concat('Doc ', doc_id % 300) AS heading, 'top' AS anchor, concat('Doc ', doc_id % 300) AS heading_path FROM documents
            UNION ALL SELECT doc_id, i, 2, part, concat('p', i), concat(top, ' > ', part) FROM placed WHERE i % 4 = 0
            UNION ALL SELECT doc_id, i, 3, sub, NULL, concat(top, ' > ', part, ' > ', sub) FROM placed WHERE i % 4 = 2),
  m_sections AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS ord,
                   level, heading, anchor, heading_path FROM heads),
  m_links AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, source AS source_id, doc_id, 2 * i AS ord, concat('/d/', (doc_id * 7 + i) % 1000) AS href, concat('see ', i) AS link_text FROM placed
              UNION ALL SELECT CAST(doc_id AS VARCHAR), source, doc_id, 2 * i + 1, concat('d/', doc_id, '?q=', i % 2, '#x'), 'only a link' FROM placed)"""


def marked_up(t):
    """Documents as HTML pages `(page_id, source_id, url, html, ...)`.

    Every fourth line opens a part, the lines between open subsections; each line is a
    paragraph that ends in a link and is followed by a list of one link and one plain item.
    """
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    doc = F.col("doc_id")

    def line_html(line, i):
        part = F.concat(F.lit('<h2 id="p'), i.cast("string"), F.lit('">Part '), F.floor(i / 4).cast("string"), F.lit("</h2>"))
        sub = F.concat(F.lit("<h3>Sub "), i.cast("string"), F.lit("</h3><h4> </h4>"))
        head = F.when(i % 4 == 0, part).when(i % 4 == 2, sub).otherwise(F.lit(""))
        link = F.concat(
            F.lit(' <a href="/d/'), ((doc * 7 + i) % 1000).cast("string"), F.lit('">see '), i.cast("string"), F.lit("</a></p>")
        )
        items = F.concat(
            F.lit('<ul><li><a href="d/'), doc.cast("string"), F.lit("?q="), (i % 2).cast("string"),
            F.lit('#x">only a&nbsp;link</a></li><li>item '), i.cast("string"), F.lit("</li></ul>"),
        )
        return F.concat(head, F.lit("<p>"), line, link, items)

    body = F.array_join(F.transform(F.split(text, "\n"), line_html), "")
    title = F.concat(F.lit("Doc "), (doc % 300).cast("string"))
    html = F.concat(
        F.lit("<html><head><title>"), title, F.lit(" &amp; more</title><style>p{}</style></head><body><nav><p>menu <a href='/m'>m</a></p></nav><h1 id='top'>"),
        title, F.lit("</h1>"), body,
        F.lit("<div class='x navbox'><p>chrome <a href='/c'>c</a></p></div><img src='/i/"), doc.cast("string"), F.lit(".png' alt='Fig'><footer>end</footer></body></html>"),
    )
    return t("documents").select(
        doc.cast("string").alias("page_id"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("https://docs.example/d/"), doc.cast("string")).alias("url"),
        title.alias("title"),
        F.concat(F.lit("type"), (doc % 11).cast("string")).alias("page_type"),
        F.col("lang").alias("language"),
        F.lit("active").alias("lifecycle"),
        F.lit(AS_OF).cast("timestamp").alias("crawled_at"),
        doc.alias("seq"),
        html.alias("html"),
    )


@query(f"WITH {MARKUP_ORACLE} SELECT page_id, ord, heading_path, text FROM m_blocks")
def markup_blocks(t):
    return P.page_blocks(P.extract_pages(marked_up(t), SITE_RULES))


@query(f"WITH {MARKUP_ORACLE} SELECT concat(page_id, ':sec:', ord) AS section_id, page_id, ord, level, heading, anchor, heading_path FROM m_sections")
def markup_sections(t):
    return P.page_sections(P.extract_pages(marked_up(t), SITE_RULES))


@query(f"WITH {MARKUP_ORACLE} SELECT page_id, CAST(ord AS INT) AS ord, href, link_text FROM m_links")
def markup_links(t):
    return P.page_links(P.extract_pages(marked_up(t), SITE_RULES)).select("page_id", "ord", "href", "link_text")


@query("SELECT CAST(doc_id AS VARCHAR) AS page_id, 0 AS ord, concat('/i/', doc_id, '.png') AS src, 'Fig' AS alt FROM documents")
def markup_images(t):
    return P.page_images(P.extract_pages(marked_up(t), SITE_RULES))


CLEANED = """
  cuts AS (SELECT page_id, min(ord) AS cut FROM m_blocks WHERE contains(lower(heading_path), 'part 9') GROUP BY page_id),
  c_blocks AS (SELECT b.*, row_number() OVER (PARTITION BY b.page_id ORDER BY ord) - 1 AS new_ord FROM m_blocks b LEFT JOIN cuts c USING (page_id)
    WHERE b.source_id LIKE '%1' AND (cut IS NULL OR ord < cut) AND NOT contains(heading_path, 'Sub 6') AND NOT regexp_matches(text, '^item [0-9]*[02468]$')
       OR b.source_id NOT LIKE '%1')"""

CLEAN_RULES = "source_id string, truncate_after array<string>, drop_sections array<string>, drop_blocks array<string>"


def _cleaning(t):
    return t("doc_sources").filter(F.endswith("source_id", F.lit("1"))).select(
        "source_id",
        F.array(F.lit("PART 9")).alias("truncate_after"),
        F.array(F.lit("sub 6")).alias("drop_sections"),
        F.array(F.lit("^item [0-9]*[02468]$"), F.lit("^nothing$")).alias("drop_blocks"),
    )


@query(f"WITH {MARKUP_ORACLE}, {CLEANED} SELECT page_id, CAST(new_ord AS INT) AS ord, heading_path, text FROM c_blocks")
def clean_blocks(t):
    return P.page_blocks(P.clean_pages(P.extract_pages(marked_up(t), SITE_RULES), _cleaning(t)))


@query(
    f"""WITH {MARKUP_ORACLE}, cut AS (SELECT page_id, min(ord) AS cut_at FROM m_sections WHERE contains(lower(heading), 'part 9') GROUP BY page_id)
        SELECT s.page_id, s.ord, heading FROM m_sections s JOIN documents d ON d.doc_id = CAST(s.page_id AS BIGINT) LEFT JOIN cut USING (page_id)
        WHERE d.source NOT LIKE '%1' OR ((cut_at IS NULL OR s.ord < cut_at) AND NOT contains(heading_path, 'Sub 6'))"""
)
def clean_sections(t):
    done = P.clean_pages(P.extract_pages(marked_up(t), SITE_RULES), _cleaning(t))
    return P.page_sections(done).select("page_id", "ord", "heading")


@query(
    f"""WITH {MARKUP_ORACLE},
          s AS (SELECT *, lag(heading_path) OVER (PARTITION BY page_id ORDER BY ord) IS DISTINCT FROM heading_path AS turns FROM m_blocks),
          j AS (SELECT page_id, string_agg(concat(CASE WHEN turns THEN concat('## ', heading_path, chr(10), chr(10)) ELSE '' END, text), chr(10) || chr(10) ORDER BY ord) AS body
                FROM s GROUP BY page_id)
        SELECT page_id, sha256(concat('# Doc ', CAST(page_id AS BIGINT) % 300, ' & more', chr(10), chr(10), body)) AS markdown_hash FROM j"""
)
def page_markdown(t):
    done = P.page_markdown(P.extract_pages(marked_up(t), SITE_RULES))
    return done.select("page_id", F.sha2("markdown", 256).alias("markdown_hash"))


def chunk_oracle(blocks: str, max_chars: int = 1200, overlap: int = 150) -> str:
    """CTEs that pack `blocks(page_id, ord, heading_path, text)` into `packed`.

    Runs of one heading path are numbered first; each run is then folded over its texts.
    """
    step = max_chars - overlap
    trim = _trim
    seed = (
        f"CASE WHEN c = '' OR {max_chars - 2} - length(x.t) <= 0 THEN x.t "
        f"ELSE concat(right(c, least(length(c), {max_chars - 2} - length(x.t))), chr(10), chr(10), x.t) END"
    )
    closed = trim("a.buf")
    return f"""
  runs AS (SELECT *, sum(CASE WHEN turns THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run
           FROM (SELECT *, lag(heading_path) OVER (PARTITION BY page_id ORDER BY ord) IS DISTINCT FROM heading_path OR ord = min(ord) OVER (PARTITION BY page_id) AS turns FROM {blocks})),
  lists AS (SELECT page_id, run, any_value(heading_path) AS heading_path, list({{'t': text, 'out': []::VARCHAR[], 'buf': '', 'carry': ''}} ORDER BY ord) AS items
            FROM runs GROUP BY page_id, run),
  folded AS (SELECT page_id, run, heading_path, list_reduce(items, lambda a, x:
      CASE WHEN length(x.t) > {max_chars} THEN
        {{'t': '', 'out': list_concat(CASE WHEN a.buf <> '' THEN list_append(a.out, {closed}) ELSE a.out END,
              list_filter(list_transform(range(0, CAST(1 + ceil((length(x.t) - {max_chars}) / {step}) AS BIGINT)), lambda i: {trim(f"substr(x.t, CAST(i * {step} + 1 AS BIGINT), {max_chars})")}), lambda p: p <> '')),
          'buf': '', 'carry': right({trim(f"substr(x.t, CAST(ceil((length(x.t) - {max_chars}) / {step}) * {step} + 1 AS BIGINT), {max_chars})")}, {overlap})}}
      WHEN a.buf = '' THEN {{'t': '', 'out': a.out, 'buf': {seed.replace('c = ', 'a.carry = ').replace('right(c,', 'right(a.carry,').replace('length(c)', 'length(a.carry)')}, 'carry': a.carry}}
      WHEN length(a.buf) + 2 + length(x.t) > {max_chars} THEN
        {{'t': '', 'out': list_append(a.out, {closed}),
          'buf': {seed.replace('c = ', f'right({closed}, {overlap}) = ').replace('right(c,', f'right(right({closed}, {overlap}),').replace('length(c)', f'length(right({closed}, {overlap}))')},
          'carry': right({closed}, {overlap})}}
      ELSE {{'t': '', 'out': a.out, 'buf': concat(a.buf, chr(10), chr(10), x.t), 'carry': a.carry}} END,
      {{'t': '', 'out': []::VARCHAR[], 'buf': '', 'carry': ''}}) AS f FROM lists),
  pieces AS (SELECT page_id, run, heading_path, CASE WHEN f.buf <> '' THEN list_append(f.out, {trim('f.buf')}) ELSE f.out END AS texts FROM folded),
  flat AS (SELECT page_id, run, heading_path, unnest(texts) AS text, generate_subscripts(texts, 1) AS i FROM pieces),
  packed AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY run, i) - 1 AS INT) AS ord, heading_path, text FROM flat)"""


@query(
    f"""WITH {MARKUP_ORACLE}, {chunk_oracle('m_blocks')}
        SELECT concat(page_id, ':', ord) AS chunk_id, page_id, ord, heading_path, text, sha256(text) AS content_hash,
          CAST(ceil(length(text) / 4.0) AS INT) AS token_count FROM packed"""
)
def markup_chunks(t):
    return P.chunk_pages(P.extract_pages(marked_up(t), SITE_RULES))


# Documents as plain pages of one section: each line is a block.
DOC_BLOCKS = f"""
  d_lines AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents),
  d_blocks AS (SELECT page_id, ord, NULL::VARCHAR AS heading_path, {_trim('line')} AS text FROM d_lines WHERE {_trim('line')} <> '')"""

DOC_CHUNKS = f"{DOC_BLOCKS}, {chunk_oracle('d_blocks')}"


def document_pages(t):
    """Documents whose lines are blocks without a heading."""
    blocks = F.transform(F.split("text", "\n"), lambda line: F.struct(F.lit(None).cast("string").alias("heading_path"), line.alias("text")))
    return t("documents").select(F.col("doc_id").cast("string").alias("page_id"), blocks.alias("blocks"))


@query(f"WITH {DOC_CHUNKS} SELECT concat(page_id, ':', ord) AS chunk_id, page_id, ord, text FROM packed")
def document_chunks(t):
    return P.chunk_pages(document_pages(t)).select("chunk_id", "page_id", "ord", "text")


@query(
    f"""WITH {DOC_CHUNKS} SELECT page_id, count(*) AS chunks, max(length(text)) AS longest, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens
        FROM packed GROUP BY page_id"""
)
def chunk_stats(t):
    chunks = P.chunk_pages(document_pages(t))
    return chunks.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max(F.length("text")).alias("longest"), F.sum("token_count").alias("tokens")
    )


# FNV-1a and the vector stream in SQL; texts of the base plane only, so code points are UTF-16 units.
SEEDS = """
  seeds AS (SELECT id, list_reduce(list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS UBIGINT)),
              lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::UBIGINT) AS seed FROM texts),
  mixed AS (SELECT id, list_transform(range(1, 769), lambda i: (seed + CAST(i AS UBIGINT) * 2654435769) % 4294967296) AS z FROM seeds),
  one AS (SELECT id, list_transform(z, lambda v: (xor(v, v >> 16) * 569420461) % 4294967296) AS z FROM mixed),
  two AS (SELECT id, list_transform(z, lambda v: (xor(v, v >> 15) * 1935289751) % 4294967296) AS z FROM one),
  drawn AS (SELECT id, list_transform(z, lambda v: xor(v, v >> 15)::DOUBLE / 4294967295 * 2 - 1) AS r FROM two),
  unit AS (SELECT id, list_transform(r, lambda v: v / sqrt(list_sum(list_transform(r, lambda w: w * w)))) AS e FROM drawn)"""


@query(
    f"""WITH texts AS (SELECT doc_id AS id, text FROM documents), {SEEDS}
        SELECT id AS doc_id, len(list_filter(e, lambda v: v > 0)) AS positive, list_position(e, list_max(e)) AS largest_at,
          list_position(e, list_min(e)) AS smallest_at FROM (SELECT id, CAST(e AS FLOAT[]) AS e FROM unit)"""
)
def embed_hash(t):
    vectors = t("documents").select("doc_id", embed.embedding(F.col("text")).alias("e"))
    return vectors.select(
        "doc_id",
        F.size(F.filter("e", lambda v: v > 0)).alias("positive"),
        F.array_position("e", F.array_max("e")).alias("largest_at"),
        F.array_position("e", F.array_min("e")).alias("smallest_at"),
    )


# ---- the graph -------------------------------------------------------------------------

LINKED = f"""{MARKUP_ORACLE},
  abs_links AS (SELECT page_id, source_id, CASE WHEN href LIKE '/%' THEN concat('https://docs.example', href) ELSE concat('https://docs.example/d/', href) END AS dst_url, ord, link_text FROM m_links),
  firsts AS (SELECT page_id, source_id, dst_url, arg_min(link_text, ord) AS evidence FROM abs_links GROUP BY ALL),
  known AS (SELECT CAST(doc_id AS VARCHAR) AS dst_page_id, source AS source_id, concat('https://docs.example/d/', doc_id) AS dst_url FROM documents)"""


@query(
    f"""WITH {LINKED} SELECT page_id AS src_page_id, dst_page_id, dst_url, 'link' AS edge_type, 1.0::DOUBLE AS weight, evidence
        FROM firsts LEFT JOIN known USING (source_id, dst_url) WHERE dst_page_id IS DISTINCT FROM page_id"""
)
def link_edges(t):
    pages = marked_up(t)
    return graph.link_edges(P.extract_pages(pages, SITE_RULES), pages)


def _name(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({expr}), '^(the|a|an)[{WS}]+', ''), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH names AS (SELECT CAST(item_id AS VARCHAR) AS item, {_name('text')} AS normalized FROM benchmark),
             texts AS (SELECT CAST(doc_id AS VARCHAR) AS doc, {_name('text')} AS normal FROM documents)
        SELECT doc AS src_page_id, item AS dst_page_id, normalized AS mentioned FROM texts, names
        WHERE item <> doc AND length(normalized) >= 3 AND contains(concat(' ', normal, ' '), concat(' ', normalized, ' '))"""
)
def entity_mentions(t):
    entities = t("benchmark").select(
        X.normalize_name(F.col("text")).alias("normalized"), F.lit("passage").alias("kind"), F.col("item_id").cast("string").alias("canonical_page_id")
    )
    texts = t("documents").select(F.col("doc_id").cast("string").alias("page_id"), "text")
    return graph.mention_edges(texts, entities).select("src_page_id", "dst_page_id", "mentioned")


ENTITIES = f"""
  named AS (SELECT page_id, seq, tier, coalesce(title, url) AS name, {_name('coalesce(title, url)')} AS normalized, page_type AS kind
            FROM doc_pages JOIN doc_sources USING (source_id)),
  met AS (SELECT *, min({{'t': tier, 's': seq, 'p': page_id}}) OVER (PARTITION BY normalized, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM named),
  decided AS (SELECT *, CASE WHEN held IS NULL THEN 'first' WHEN tier < held.t THEN 'won' WHEN tier > held.t THEN 'lost' ELSE 'tied' END AS outcome FROM met)"""


@query(f"WITH {ENTITIES} SELECT page_id, normalized, kind, tier, outcome, held.p AS other_page_id FROM decided", ("doc_pages", "doc_sources"))
def tier_conflict(t):
    decisions = graph.entity_decisions(t("doc_pages"), t("doc_sources"), block_rows=64)
    return decisions.select("page_id", "normalized", "kind", "tier", "outcome", "other_page_id")


@query(
    f"""WITH {ENTITIES} SELECT normalized, kind, arg_max(name, seq) FILTER (outcome <> 'tied') AS name,
          arg_min(page_id, {{'t': tier, 's': seq}}) AS canonical_page_id FROM decided GROUP BY normalized, kind""",
    ("doc_pages", "doc_sources"),
)
def entities(t):
    return graph.registered_entities(graph.entity_decisions(t("doc_pages"), t("doc_sources")))


@query(
    f"""WITH {ENTITIES} SELECT CASE outcome WHEN 'won' THEN page_id ELSE held.p END AS src_page_id,
          CASE outcome WHEN 'won' THEN held.p ELSE page_id END AS dst_page_id FROM decided WHERE outcome IN ('won', 'lost')""",
    ("doc_pages", "doc_sources"),
)
def supersede_edges(t):
    decisions = graph.entity_decisions(t("doc_pages"), t("doc_sources"))
    return graph.supersede_edges(decisions).select("src_page_id", "dst_page_id")


@query(
    f"""WITH {ENTITIES}, losers AS (SELECT DISTINCT CASE outcome WHEN 'won' THEN held.p ELSE page_id END AS page_id FROM decided WHERE outcome IN ('won', 'lost'))
        SELECT p.page_id, CASE WHEN l.page_id IS NOT NULL THEN 'deprecated' ELSE lifecycle END AS lifecycle FROM doc_pages p LEFT JOIN losers l USING (page_id)""",
    ("doc_pages", "doc_sources"),
)
def deprecated_pages(t):
    pages = t("doc_pages")
    return graph.deprecate_losers(pages, graph.entity_decisions(pages, t("doc_sources"))).select("page_id", "lifecycle")


@query(
    """WITH new AS (SELECT src_page_id, CASE WHEN edge_type = 'link' THEN NULL ELSE concat('u', CAST(dst_page_id AS BIGINT) % 50) END AS dst_url,
                      edge_type, CAST(edge_id[2:] AS BIGINT) AS seq, concat('s', CAST(src_page_id AS BIGINT) % 100) AS src FROM doc_edges)
       SELECT src AS src_page_id, dst_url, edge_type, arg_min(seq, seq) AS weight FROM new WHERE dst_url IS NOT NULL
         AND NOT (edge_type = 'see_also' AND dst_url IN ('u1', 'u10')) GROUP BY ALL
       UNION ALL SELECT src, NULL, edge_type, seq FROM new WHERE dst_url IS NULL
       UNION ALL SELECT src, dst_url, 'see_also', -1 FROM (SELECT DISTINCT src FROM new), (VALUES ('u1'), ('u10')) AS v(dst_url)""",
    ("doc_edges",),
)
def edges_insert(t):
    source = F.concat(F.lit("s"), (F.col("src_page_id").cast("long") % 100).cast("string"))
    url = F.when(F.col("edge_type") != "link", F.concat(F.lit("u"), (F.col("dst_page_id").cast("long") % 50).cast("string")))
    seq = F.substring("edge_id", 2, 20).cast("long")
    new = t("doc_edges").select(source.alias("src_page_id"), url.alias("dst_url"), "edge_type", seq.alias("weight"), seq.alias("seq"))
    current = new.select("src_page_id").distinct().select(
        "src_page_id", F.explode(F.array(F.lit("u1"), F.lit("u10"))).alias("dst_url"), F.lit("see_also").alias("edge_type"), F.lit(-1).cast("long").alias("weight")
    )
    return graph.insert_edges(current, new)


# ---- upserts and listings ---------------------------------------------------------------


def _page_table(t):
    """The stored page table of a first crawl."""
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    return t("doc_pages").select(
        "page_id", "source_id", "url", F.col("url").alias("canonical_url"), "title", "page_type", F.lit(None).cast("string").alias("summary"),
        "language", F.lit("[]").alias("tags"), F.sha2("html", 256).alias("content_hash"), upsert.raw_key(F.col("page_id")).alias("raw_key"),
        "lifecycle", F.lit(1).alias("version"), "crawled_at", now.alias("updated_at"),
    )


@query(
    """WITH old AS (SELECT * FROM doc_pages WHERE language <> 'fr'),
            new AS (SELECT *, CASE WHEN language = 'es' THEN concat(html, '!') ELSE html END AS html2 FROM doc_pages)
       SELECT n.page_id, CASE WHEN o.page_id IS NOT NULL AND n.html2 <> o.html THEN 2 ELSE 1 END AS version,
         CASE WHEN o.page_id IS NULL THEN 'new ' || n.title WHEN n.html2 <> o.html THEN 'new ' || n.title ELSE o.title END AS title,
         coalesce(o.lifecycle, 'active') AS lifecycle, sha256(n.html2) AS content_hash,
         epoch_us(CASE WHEN o.page_id IS NOT NULL THEN o.crawled_at ELSE TIMESTAMP '2024-01-31' END) AS crawled_at,
         epoch_us(CASE WHEN o.page_id IS NULL OR n.html2 <> o.html THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-01' END) AS updated_at
       FROM new n LEFT JOIN old o USING (page_id)""",
    ("doc_pages",),
)
def page_upsert(t):
    """A second crawl: French pages are new, Spanish ones have changed, others are as stored."""
    current = _page_table(t).filter("language <> 'fr'")
    now = F.lit(AS_OF).cast("timestamp")
    body = F.when(F.col("language") == "es", F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    crawled = t("doc_pages").select("page_id", F.sha2(body, 256).alias("content_hash"))
    changes = (
        _page_table(t).drop("content_hash").join(crawled, "page_id")
        .withColumn("title", F.concat(F.lit("new "), F.col("title")))
        .withColumn("crawled_at", now).withColumn("updated_at", now)
    )
    after = upsert.upsert_pages(current, changes)
    return after.select("page_id", "version", "title", "lifecycle", "content_hash", "crawled_at", "updated_at")


@query(
    """SELECT source_id, concat(source_id, ' v2') AS name, tier + 1 AS tier, epoch_us(CASE WHEN tier = 2 THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-01' END) AS created_at
       FROM doc_sources""",
    ("doc_sources",),
)
def source_upsert(t):
    def rows(sources, version, at):
        return sources.select(
            "source_id", F.concat("source_id", F.lit(version)).alias("name"), F.lit("https://x").alias("base_url"), "tier",
            F.lit(None).cast("string").alias("license"), F.lit(at).cast("timestamp").alias("created_at"),
        )

    current = rows(t("doc_sources").filter("tier <> 2"), " v1", datetime(2024, 1, 1))
    changes = rows(t("doc_sources").withColumn("tier", F.col("tier") + 1), " v2", AS_OF)
    return upsert.upsert_sources(current, changes).select("source_id", "name", "tier", "created_at")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS page_id, concat('/i/', source) AS url, CASE WHEN lang = 'es' THEN 'h2' ELSE 'h1' END AS content_hash,
         CASE WHEN lang = 'es' THEN 'new' WHEN lang = 'fr' THEN 'new' ELSE 'old' END AS alt_text, CASE WHEN lang = 'fr' THEN 20 ELSE 10 END AS width
       FROM (SELECT * FROM documents)"""
)
def image_upsert(t):
    """Spanish images have new bytes, French ones are new, the others are as stored."""
    base = t("documents").select(
        F.col("doc_id").cast("string").alias("page_id"), F.concat(F.lit("/i/"), "source").alias("url"), "lang", F.concat(F.lit("i"), "doc_id").alias("image_id")
    )

    def rows(df, content_hash, alt, width):
        return df.select(
            "image_id", "page_id", "url", content_hash.alias("content_hash"), F.lit("image/png").alias("content_type"),
            F.lit(alt).alias("alt_text"), F.lit(width).alias("width"),
        )

    current = rows(base.filter("lang <> 'fr'"), F.lit("h1"), "old", 10)
    changes = rows(base, F.when(F.col("lang") == "es", "h2").otherwise("h1"), "new", 20)
    return upsert.upsert_images(current, changes).select("page_id", "url", "content_hash", "alt_text", "width")


@query(
    f"""WITH {DOC_CHUNKS}, langs AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, lang FROM documents)
        SELECT concat(page_id, ':', ord) AS chunk_id, page_id, text FROM packed JOIN langs USING (page_id) WHERE lang <> 'es'
        UNION ALL SELECT concat(doc_id, ':0'), CAST(doc_id AS VARCHAR), 'replaced' FROM documents WHERE lang = 'es'"""
)
def chunk_replace(t):
    """Spanish pages are indexed again and now have a single chunk."""
    current = P.chunk_pages(document_pages(t)).select("chunk_id", "page_id", "text")
    changed = t("documents").filter("lang = 'es'").select(F.col("doc_id").cast("string").alias("page_id"))
    new = changed.select(F.concat("page_id", F.lit(":0")).alias("chunk_id"), "page_id", F.lit("replaced").alias("text"))
    return upsert.replace_rows(current, new, changed, "page_id")


@query(
    """SELECT page_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY page_id) AS position FROM doc_pages
       WHERE page_id > '3' QUALIFY position <= 20""",
    ("doc_pages",),
)
def page_list(t):
    return lookups.keyset_page(t("doc_pages"), 20, "3").select("page_id", "source_id", "position")


@query(
    """SELECT source_id, page_id AS next_cursor FROM doc_pages WHERE page_id > '3'
       QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY page_id) = 20""",
    ("doc_pages",),
)
def page_cursor(t):
    page = lookups.keyset_page(t("doc_pages"), 20, "3")
    return page.filter(F.col("next_cursor").isNotNull()).select("source_id", "next_cursor").distinct()


@query(
    """SELECT p.page_id, p.title, p.page_type, p.language, p.lifecycle, sha256(p.html) AS html_hash,
         CASE WHEN p.language = 'en' THEN concat('# ', p.page_id) END AS markdown, CASE WHEN p.language = 'de' THEN '' ELSE 'a|b' END AS tags
       FROM doc_pages p""",
    ("doc_pages",),
)
def page_details(t):
    pages = t("doc_pages").drop("html").withColumn("tags", F.when(F.col("language") == "de", "not json").otherwise('["a","b"]'))
    markdown = t("doc_pages").filter("language = 'en'").select("page_id", F.concat(F.lit("# "), "page_id").alias("markdown"))
    found = lookups.page_details(pages, t("doc_pages").select("page_id", "html"), markdown)
    return found.select(
        "page_id", "title", "page_type", "language", "lifecycle", F.sha2("html", 256).alias("html_hash"), "markdown", "tags"
    )


@query(
    """SELECT e.edge_id, e.pos, p.page_id, p.title FROM (SELECT edge_id, dst_page_id AS page_id, row_number() OVER (ORDER BY edge_id) AS pos FROM doc_edges) e
       JOIN doc_pages p USING (page_id)""",
    ("doc_edges", "doc_pages"),
)
def pages_in_caller_order(t):
    """Every edge asks for its destination, in the order of edge ids."""
    ranked = t("doc_edges").select("edge_id", F.col("dst_page_id").alias("page_id"))
    rank_of = ranked.orderBy("edge_id").select("edge_id", "page_id")
    # Positions come from a range-partitioned sort, not from one window over all rows.
    parts = cut_lineage(rank_of.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = {row["_part"]: row["n"] for row in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, {}
    for part in sorted(sizes):
        offsets[part] = before
        before += sizes[part]
    start = F.create_map(*[F.lit(x) for item in offsets.items() for x in item])
    local = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)
    wanted = parts.select("edge_id", "page_id", (start[F.col("_part")] + local + 1).alias("pos"))
    found = lookups.in_caller_order(t("doc_pages"), wanted, "page_id")
    return found.join(wanted.select("edge_id", "pos"), "pos").select("edge_id", "pos", "page_id", "title")


@query(
    "SELECT page_id, source_id, url FROM doc_pages WHERE (source_id, url) IN (SELECT source_id, url FROM doc_pages WHERE language = 'fr')",
    ("doc_pages",),
)
def pages_by_natural_key(t):
    wanted = t("doc_pages").filter("language = 'fr'").select("source_id", "url")
    return lookups.by_key(t("doc_pages"), wanted, ["source_id", "url"]).select("page_id", "source_id", "url")


@query("SELECT source_id, tier FROM doc_sources", ("doc_sources",))
def source_list(t):
    return lookups.list_sources(t("doc_sources"))


@query(f"WITH {ENTITIES} SELECT DISTINCT normalized, kind FROM decided", ("doc_pages", "doc_sources"))
def entity_list(t):
    entities = graph.registered_entities(graph.entity_decisions(t("doc_pages"), t("doc_sources")))
    return lookups.list_entities(entities).select("normalized", "kind")


@query(
    f"""WITH {MARKUP_ORACLE} SELECT page_id, ord, level, heading FROM m_sections
        WHERE page_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'fr')"""
)
def section_list(t):
    """Headings of the French pages; a page asked for twice is listed once."""
    french = t("documents").filter("lang = 'fr'").select(F.col("doc_id").cast("string").alias("page_id"))
    sections = P.page_sections(P.extract_pages(marked_up(t), SITE_RULES))
    return lookups.page_listing(sections, french.unionByName(french), "ord").select("page_id", "ord", "level", "heading")


@query(
    """SELECT page_id, url, title, page_type, language, 'active' AS lifecycle, length(html) AS version, seq AS updated_at FROM doc_pages""",
    ("doc_pages",),
)
def page_items(t):
    pages = t("doc_pages").withColumn("lifecycle", F.lit("active"))
    return lookups.page_items(pages.withColumn("version", F.length("html")).withColumn("updated_at", F.col("seq")))


@query("SELECT source_id, concat('Source ', source_id) AS name, concat('https://', source_id) AS base_url, tier, 'free' AS license FROM doc_sources", ("doc_sources",))
def source_items(t):
    sources = t("doc_sources").select(
        "source_id", "tier", F.concat(F.lit("Source "), "source_id").alias("name"), F.concat(F.lit("https://"), "source_id").alias("base_url"),
        F.lit("free").alias("license"),
    )
    return lookups.source_items(sources)


@query(
    f"""WITH {VALIDATED},
          one AS (SELECT page_id, 0 AS ord, 'v1' AS rule_id, CASE WHEN no_title THEN 'fail' ELSE 'pass' END AS outcome FROM v
            UNION ALL SELECT page_id, 1, 'v2', CASE WHEN short THEN 'fail' ELSE 'pass' END FROM v
            UNION ALL SELECT page_id, 2, 'v3', CASE WHEN bad_type THEN 'fail' ELSE 'pass' END FROM v
            UNION ALL SELECT page_id, 3, 'v4', CASE WHEN not_en THEN 'warn' ELSE 'pass' END FROM v)
        SELECT page_id, ord, rule_id, 'validate' AS phase, outcome, CAST(count(*) AS INT) AS runs
        FROM one, (VALUES (1), (2)) AS r(run) GROUP BY ALL""",
    ("doc_pages",),
)
def rule_events_appended(t):
    """The audit trail after two runs over the same pages, each appended to the stored one."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/rule_events/{uuid.uuid4().hex}"
    done = rules.validate(_normalized(t).drop("outcomes"), rules.load_rules(_rules(t), "validate"))
    events = rules.rule_events(done, F.lit(AS_OF).cast("timestamp"))
    for _ in range(2):
        rules.append_rule_events(events, folder)
    trail = t.spark.read.parquet(folder)
    return trail.groupBy("page_id", "ord", "rule_id", "phase", "outcome").agg(F.count(F.lit(1)).cast("int").alias("runs"))


@query(
    """SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS terms,
         length(text) BETWEEN 1 AND 2000 AS searchable FROM benchmark"""
)
def query_terms_ascii(t):
    """Search terms in their strict form, and whether the query's length is admitted."""
    return t("benchmark").select(
        "item_id", F.array_join(X.query_tokens(F.col("text"), strict_ascii=True), " ").alias("terms"),
        F.length("text").between(1, 2000).alias("searchable"),
    )
