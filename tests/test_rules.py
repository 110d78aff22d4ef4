import json
import random

import pytest
from pyspark.sql import functions as F

from brightloom.operators import rules as R
from brightloom.operators import writes as W

RULES = "rule_id string, phase string, kind string, params string, severity string, enabled boolean, priority int"
REQUEST = "page_id string, source_id string, url string, html string, title string, page_type string, language string, seq long"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), RULES)


def candidate(spark, **values):
    base = {"page_id": "1", "source_id": "s", "url": "https://E.org/a?utm=1#x", "html": "text", "title": "T", "page_type": "article", "language": "en", "seq": 1}
    df = spark.createDataFrame([tuple({**base, **values}[c.split()[0]] for c in REQUEST.split(", "))], REQUEST)
    return R.page_candidates(df)


def test_rules_are_loaded_in_order_with_defaults(spark):
    rows = table(
        spark,
        ("b", "validate", "require_title", None, None, None, None),
        ("a", "validate", "language_is_en", "{}", "warn", True, 100),
        ("c", "validate", "min_text_len", '{"min":3}', "odd", True, 1),
        ("off", "validate", "require_title", "{}", "error", False, 1),
        ("n", "normalize", "collapse_whitespace", "{}", "error", True, 1),
    )
    loaded = R.load_rules(rows, "validate")
    assert [(r.rule_id, r.severity, r.priority) for r in loaded] == [("c", "error", 1), ("a", "warn", 100), ("b", "error", 100)]


@pytest.mark.parametrize(
    "kind, params",
    [("nope", {}), ("min_text_len", {}), ("min_text_len", {"min": -1}), ("min_text_len", {"min": True}), ("allowed_page_type", {"allowed": []}), ("derive_summary", {"maxChars": 0}), ("canonical_url", {"stripParams": [1]})],
)
def test_bad_parameters(kind, params):
    with pytest.raises(R.RuleError):
        R.checked_params(kind, params)


def test_parameter_defaults():
    assert R.checked_params("canonical_url", {}) == {"stripParams": [], "lowercaseHost": True, "dropFragment": True}
    assert R.checked_params("derive_summary", None) == {"maxChars": 280}


def test_normalize_threads_the_page_through(spark):
    rows = table(
        spark,
        ("1", "normalize", "collapse_whitespace", "{}", "error", True, 1),
        ("2", "normalize", "derive_summary", '{"maxChars": 5}', "error", True, 2),
        ("3", "normalize", "canonical_url", json.dumps({"stripParams": ["utm"]}), "error", True, 3),
        ("4", "normalize", "require_title", "{}", "error", True, 4),
        ("5", "normalize", "collapse_whitespace", "{}", "error", True, 5),
    )
    page = R.normalize(candidate(spark, html="  one   two three \n\n\n\nx"), R.load_rules(rows, "normalize")).collect()[0]
    assert page["text"] == "one two three\n\nx"
    assert page["summary"] == "one t"
    assert page["canonical_url"] == "https://e.org/a"
    assert [(o["rule_id"], o["status"], o["detail"]) for o in page["outcomes"]] == [
        ("1", "applied", None), ("2", "applied", None), ("3", "applied", "https://e.org/a"), ("4", "skipped", "not a normalize rule"), ("5", "skipped", None),
    ]


def test_unparseable_url_is_left_alone(spark):
    rows = table(spark, ("1", "normalize", "canonical_url", "{}", "error", True, 1))
    page = R.normalize(candidate(spark, url="no url"), R.load_rules(rows, "normalize")).collect()[0]
    assert (page["canonical_url"], page["outcomes"][0]["status"]) == ("no url", "skipped")


def test_validate_outcomes(spark):
    rows = table(
        spark,
        ("1", "validate", "require_title", "{}", "error", True, 1),
        ("2", "validate", "min_text_len", '{"min":10}', "warn", True, 2),
        ("3", "validate", "allowed_page_type", '{"allowed":["x"]}', "error", True, 3),
        ("4", "validate", "language_is_en", "{}", "warn", True, 4),
        ("5", "validate", "near_duplicate_hash", "{}", "error", True, 5),
    )
    loaded = R.load_rules(rows, "validate")
    page = R.validate(candidate(spark, title="  ", language="de"), loaded).collect()[0]
    assert [(o["status"], o["detail"]) for o in page["outcomes"]] == [
        ("fail", "missing title"), ("warn", "text length 4 < 10"), ("fail", "page_type article not allowed"), ("warn", "language de != en"), ("skipped", "not a validate rule"),
    ]
    assert page["passed"] is False
    assert R.validate(candidate(spark, page_type="x", html="short"), loaded).collect()[0]["passed"] is True


PAGE = "page_id string, source_id string, content_hash string, canonical_url string, seq long"


def sequential(pages, stored, kinds):
    """One page after another, as a store would see them."""
    kept, actions = list(stored), {}
    for page_id, source, content, url, _ in sorted(pages, key=lambda p: p[4]):
        action = "insert"
        for kind in kinds:
            field, value = (2, content) if kind == "near_duplicate_hash" else (3, url)
            if any(k[1] == source and k[field] == value for k in kept):
                action = "skip" if field == 2 else "merge"
                break
        actions[page_id] = action
        if action != "skip":
            kept.append((page_id, source, content, url, 0))
    return actions


@pytest.mark.parametrize("kinds", [["near_duplicate_hash", "same_canonical_url"], ["same_canonical_url", "near_duplicate_hash"], ["same_canonical_url"], ["near_duplicate_hash"]])
@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_dedup_equals_one_by_one(spark, kinds, hot_rows):
    chance = random.Random(11)
    pages = [(f"p{n:02d}", chance.choice("st"), f"h{chance.randint(0, 8)}", f"u{chance.randint(0, 8)}", n) for n in range(60)]
    stored = [("old1", "s", "h1", "u-x", 0), ("old2", "t", "h-x", "u2", 0)]
    rules = [R.Rule(str(i), "dedup", kind, {}) for i, kind in enumerate(kinds)]
    done = R.dedup(spark.createDataFrame(pages, PAGE), spark.createDataFrame(stored, PAGE), rules, hot_rows)
    assert {r["page_id"]: r["action"] for r in done.collect()} == sequential(pages, stored, kinds)


def test_more_dedup_rules_read_no_more(spark, tmp_path):
    rows = [("a", "s", "u1", "h1", 1), ("b", "s", "u1", "h2", 2), ("c", "s", None, "h1", 3), ("d", "s", "u2", None, 4)]
    spark.createDataFrame(rows, "page_id string, source_id string, canonical_url string, content_hash string, seq long").write.parquet(f"{tmp_path}/p")
    pages = spark.read.parquet(f"{tmp_path}/p")
    kinds = ["same_canonical_url", "near_duplicate_hash"]

    def done(n):
        return R.dedup(pages, pages.filter("page_id = 'none'"), [R.Rule(str(i), "dedup", kinds[i % 2], {}) for i in range(n)])

    def scans(n):
        return done(n)._jdf.queryExecution().executedPlan().toString().count("FileScan")

    assert scans(2) == scans(200)
    for n in (2, 200):
        got = {r["page_id"]: (r["action"], r["merge_into"], len(r["outcomes"])) for r in done(n).collect()}
        assert got == {"a": ("insert", None, n), "b": ("merge", "a", 1), "c": ("skip", None, 2), "d": ("insert", None, n)}


def test_dedup_outcomes_stop_at_the_first_hit(spark):
    stored = spark.createDataFrame([("old", "s", "h", "u", 0)], PAGE)
    rules = [R.Rule("0", "dedup", "require_title", {}), R.Rule("1", "dedup", "near_duplicate_hash", {}), R.Rule("2", "dedup", "same_canonical_url", {})]
    pages = spark.createDataFrame([("a", "s", "h", "u", 1), ("b", "s", "h2", "u", 2), ("c", "other", "h", "u", 3)], PAGE)
    got = {r["page_id"]: ([(o["status"], o["detail"]) for o in r["outcomes"]], r["merge_into"]) for r in R.dedup(pages, stored, rules).collect()}
    skipped = ("skipped", "not a dedup rule")
    assert got["a"] == ([skipped, ("applied", "duplicate of old")], None)
    assert got["b"] == ([skipped, ("pass", None), ("applied", "merge into old")], "old")
    assert got["c"] == ([skipped, ("pass", None), ("pass", None)], None)


def test_conflicts_by_tier(spark):
    rows = [
        ("clear", "x", 1, "a", 1), ("clear", "y", 2, "b", 2),
        ("tie", "x", 1, "a", 1), ("tie", "y", 1, "b", 2), ("tie", "z", 3, "c", 3),
        ("same", "x", 2, "b", 2), ("same", "x", 2, "a", 1),
    ]
    df = spark.createDataFrame(rows, "fact string, value string, tier int, page_id string, seq long")
    got = {r["fact"]: (r["unresolved"], r["value"], r["page_id"], r["losers"]) for r in R.resolve_by_tier(df, ["fact"]).collect()}
    assert got == {"clear": (False, "x", "a", 1), "tie": (True, None, None, 3), "same": (False, "x", "a", 1)}


def test_write_flow(spark):
    rows = table(
        spark,
        ("v", "validate", "require_title", "{}", "error", True, 1),
        ("d", "dedup", "near_duplicate_hash", "{}", "error", True, 1),
    )
    requests = spark.createDataFrame(
        [
            ("new1", "s", "https://e.org/1", "same", "T", "article", "en", 1),
            ("new2", "s", "https://e.org/2", "body", "T", "article", "en", 2),
            ("new3", "s", "https://e.org/3", "body", "T", "article", "en", 3),
            ("new4", "s", "https://e.org/4", "other", None, "article", "en", 4),
            ("new5", "s", "https://e.org/5", "changed", "T", "article", "en", 5),
        ],
        REQUEST,
    )
    stored = spark.createDataFrame([("k1", "s", "https://e.org/1", "same"), ("k5", "s", "https://e.org/5", "before")], "page_id string, source_id string, url string, html string")
    stored = stored.select("page_id", "source_id", "url", F.col("url").alias("canonical_url"), F.sha2("html", 256).alias("content_hash"))
    done = R.write_flow(requests, stored, rows)
    assert {r["page_id"]: r["verdict"] for r in done.collect()} == {"k1": "unchanged", "new2": "stored", "new3": "deduped", "new4": "rejected", "k5": "stored"}
    events = R.rule_events(done, F.current_timestamp())
    assert [r["page_id"] for r in R.pages_failing_validation(events).collect()] == ["new4"]


def written_one_by_one(requests, stored, kinds):
    """Requests `(id, url, canonical, hash, seq, passed)` of one source, one after another."""
    pages = {url: [page, hash_, canonical] for page, url, canonical, hash_ in stored}
    told = {}
    for page, url, canonical, hash_, seq, passed in sorted(requests, key=lambda r: r[4]):
        if url in pages and pages[url][1] == hash_:
            told[seq] = (pages[url][0], "unchanged")
        elif not passed:
            told[seq] = (pages[url][0] if url in pages else page, "rejected")
        elif url in pages:
            pages[url][1] = hash_
            told[seq] = (pages[url][0], "stored")
        else:
            action = "insert"
            for kind in kinds:
                if kind == "near_duplicate_hash" and any(p[1] == hash_ for p in pages.values()):
                    action = "skip"
                elif kind == "same_canonical_url" and any(p[2] == canonical for p in pages.values()):
                    action = "merge"
                if action != "insert":
                    break
            if action != "skip":
                pages[url] = [page, hash_, canonical]
            told[seq] = (page, "deduped" if action == "skip" else "stored")
    return told


@pytest.mark.parametrize(
    "kinds", [["near_duplicate_hash", "same_canonical_url"], ["same_canonical_url", "near_duplicate_hash"], ["same_canonical_url"]]
)
def test_repeated_urls_are_settled_in_order(spark, kinds):
    chance = random.Random(len(kinds))
    requests, stored = [], []
    for source in range(60):
        urls, hashes = chance.randint(1, 6), chance.randint(1, 4)
        for url in range(urls):
            if chance.random() < 0.3:
                stored.append((f"old{url}", f"s{source}", f"u{url}", f"c{url // 2}", f"h{chance.randrange(hashes)}"))
        for number in range(chance.randint(1, 14)):
            url = chance.randrange(urls)
            requests.append(
                (f"r{number}", f"s{source}", f"u{url}", f"c{url // 2}", f"h{chance.randrange(hashes)}", number * 3, chance.random() < 0.8)
            )
    checked = spark.createDataFrame(
        requests, "page_id string, source_id string, url string, canonical_url string, content_hash string, seq long, passed boolean"
    )
    store = spark.createDataFrame(stored, "page_id string, source_id string, url string, canonical_url string, content_hash string")
    got = {(r["source_id"], r["seq"]): (r["page_id"], r["verdict"]) for r in W.settle(checked, store, kinds, block_rows=7).collect()}
    expected = {}
    for source in {r[1] for r in requests}:
        own = [(r[0], *r[2:]) for r in requests if r[1] == source]
        old = [(p, u, c, h) for p, s, u, c, h in stored if s == source]
        expected |= {(source, seq): told for seq, told in written_one_by_one(own, old, kinds).items()}
    assert got == expected


def test_empty_batches_are_settled(spark):
    checked = spark.createDataFrame(
        [], "page_id string, source_id string, url string, canonical_url string, content_hash string, seq long, passed boolean"
    )
    assert W.settle(checked, checked, ["near_duplicate_hash"]).collect() == []
