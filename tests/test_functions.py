from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brightloom.functions import scalars as S
from brightloom.functions import text as X
from brightloom.functions import urls as U


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def ts(text):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize(
    "payload, field, expected",
    [
        ('{"source":"web"}', "source", "web"),
        ('{"source":5,"x":"y"}', "source", "x"),
        ("{}", "source", None),
        ('{"source"', "source", None),
        ('{"a":1, "source" : ""}', "source", ""),
    ],
)
def test_string_field_is_a_text_scan(spark, payload, field, expected):
    assert value(spark, S.scan_string_field(F.lit(payload), field)) == expected


@pytest.mark.parametrize(
    "payload, expected",
    [('{"level":2}', 2), ('{"level": -4}', -4), ('{"level":3.7}', 3), ('{"level":"5"}', None), ("{}", None), ('{"level"}', None), ('{"level":1-2}', None)],
)
def test_int_field_is_a_text_scan(spark, payload, expected):
    assert value(spark, S.scan_int_field(F.lit(payload), "level")) == expected


def test_hash_needs_every_part(spark):
    parts = [F.lit(1), F.lit("t"), ts("2024-01-01 00:00:00.123456"), F.lit("{}")]
    import hashlib

    assert value(spark, S.server_content_hash(*parts)) == hashlib.sha256(b"1\nt\n1704067200123\n{}").hexdigest()
    assert value(spark, S.client_content_hash(*parts)) == hashlib.sha256(b"1\nt\n2024-01-01T00:00:00.1234560Z\n{}").hexdigest()
    assert value(spark, S.server_content_hash(parts[0], F.lit(None).cast("string"), parts[2], parts[3])) is None


def test_labels_and_small_scalars(spark):
    assert value(spark, S.ticker_label(F.lit("app.fight.enemy_killed"), "app.")) == "enemy killed"
    assert value(spark, S.ticker_label(F.lit("app.plain_name"), "app.")) == "plain_name"
    assert value(spark, S.chip_label(F.lit("app.fight.enemy_killed"), "app.")) == "fight enemy_killed"
    assert value(spark, S.chip_label(F.lit("other.x"), "app.")) == "other.x"
    assert value(spark, S.elapsed_label(ts("2024-01-01 00:00:00"), ts("2024-01-01 02:01:05.9"))) == "121:05"
    assert value(spark, S.elapsed_label(ts("2024-01-02"), ts("2024-01-01"))) == "00:00"
    assert value(spark, S.elapsed_label(F.lit(None).cast("timestamp"), ts("2024-01-01"))) == "--:--"
    assert value(spark, S.fraction(F.lit(3), F.lit(0))) == 0.0
    assert value(spark, S.fraction(F.lit(3), F.lit(4))) == 0.75
    assert value(spark, S.tier_boost(F.lit(2))) == 0.025
    assert value(spark, S.tier_boost(F.lit(0))) == 0.0
    assert value(spark, S.tier_boost(F.lit(None).cast("int"))) == 0.0
    assert value(spark, S.freshness(ts("2024-01-01"), ts("2024-03-31"))) == pytest.approx(0.5)
    assert value(spark, S.freshness(ts("2025-01-01"), ts("2024-03-31"))) == 1.0
    assert value(spark, S.token_estimate(F.lit("abcde"))) == 2
    assert value(spark, S.snippet(F.lit("x" * 301))) == "x" * 300 + "…"
    assert value(spark, S.snippet(F.lit("x" * 300))) == "x" * 300
    assert value(spark, S.decode_base64(F.lit("***"))) is None
    assert list(value(spark, S.parse_tags(F.lit('["a","b"]')))) == ["a", "b"]
    assert list(value(spark, S.parse_tags(F.lit("no json")))) == []
    assert value(spark, S.canonical_json(F.lit('{"b":1,"a":{"d":2,"c":[1]}}'))) == '{"a":{"c":[1],"d":2},"b":1}'
    assert value(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert value(spark, S.outbox_batch_key(F.lit("a-b-c"), F.lit(3))) == "outbox-abc-3"
    assert value(spark, S.retry_delay_seconds(F.lit(9), F.lit(0.5))) == 15.0
    assert value(spark, S.retry_delay_seconds(F.lit(2), F.lit(0.5))) == 1.0
    outcomes = [value(spark, S.delivery_outcome(F.lit(code))) for code in (200, 401, 403, 500, 404, 302)]
    assert outcomes == ["success", "auth", "auth", "transient", "permanent", "permanent"]
    keys = ["ok-1:x._", "", "bad key", "x" * 129]
    assert [value(spark, S.is_idempotency_key(F.lit(k))) for k in keys] == [True, False, False, False]


def test_text_functions(spark):
    nbsp = " "
    assert value(spark, X.collapse_whitespace(F.lit(f"  a \t b {nbsp}\n\n\n\nc\r\n d  "))) == "a b\n\nc\n d"
    assert value(spark, X.first_paragraph(F.lit(f"\n {nbsp}\n\n  first one \n\nsecond"), 280)) == "first one"
    assert value(spark, X.first_paragraph(F.lit("abcd efgh"), 5)) == "abcd"
    assert value(spark, X.first_paragraph(F.lit(" \n\n "), 5)) == ""
    assert value(spark, X.normalize_name(F.lit("The  Élan, of A-1!"))) == "lan of a 1"
    assert value(spark, X.normalize_name(F.lit("Theory"))) == "theory"
    assert list(value(spark, X.index_tokens(F.lit("Ünïcode x2, naïve—Straße")))) == ["unicode", "x2", "naive", "straße"]
    assert list(value(spark, X.query_tokens(F.lit("Naïve x"), strict_ascii=True))) == ["na", "ve", "x"]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://Ex.COM:443/a?utm=1&b=2#f", "https://ex.com/a?b=2"),
        ("http://ex.com?utm=1", "http://ex.com/"),
        ("https://ex.com:8443/A/b", "https://ex.com:8443/A/b"),
        ("https://ex.com/?q=a%20b", "https://ex.com/?q=a+b"),
        ("not a url", None),
        (" https://ex.com/a/./b/../c/%2E%2e/d/.. \n", "https://ex.com/a/"),
        ("https://ex.com/../../x/.", "https://ex.com/x/"),
        ("https://ex.com/a//b/", "https://ex.com/a//b/"),
        ("https://ex.com/a..b/.c/...", "https://ex.com/a..b/.c/..."),
        ("HTTP://Us:Pw@Ex.com:080/é b\\c", "http://Us:Pw@ex.com/%C3%A9%20b/c"),
        ("https://@ex.com", "https://ex.com/"),
        ("https:\\\\ex.com\\a", "https://ex.com/a"),
        ("https:ex.com/a", "https://ex.com/a"),
        ("https://[2001:DB8::1]:444/x", "https://[2001:db8::1]:444/x"),
        ("https://ex.com:70000/", None),
        ("https://e x.com/", None),
        ("https://", None),
        ("mailto:A@b.c", "mailto:A@b.c"),
        ("MAILTO:a@b.c?utm=1&subject=x#f", "mailto:a@b.c?subject=x"),
        ("https://ex.com/%zz?%zz=1", "https://ex.com/%zz?%25zz=1"),
        ("https://ex.com/a?utm=1", "https://ex.com/a"),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert value(spark, U.canonical_url(F.lit(url).cast("string"), ["utm"])) == expected


def test_canonical_url_keeps_the_fragment_on_demand(spark):
    assert value(spark, U.canonical_url(F.lit("https://ex.com?a b#c d"), [], drop_fragment=False)) == "https://ex.com/?a%20b#c%20d"


def test_canonical_url_keeps_query_text_without_params(spark):
    assert value(spark, U.canonical_url(F.lit("https://ex.com/?q=a%20b#f"), [])) == "https://ex.com/?q=a%20b"


@pytest.mark.parametrize(
    "url, ok",
    [
        ("https://site.org/wiki/Page", True),
        ("https://SITE.org:443/wiki/Page", True),
        ("https://site.org/wiki/Talk:Page", False),
        ("https://site.org/other/Page", False),
        ("http://site.org/wiki/Page", False),
        ("https://else.org/wiki/Page", False),
        ("::::", False),
    ],
)
def test_admission(spark, url, ok):
    column = U.is_admissible(F.lit(url), F.lit("https://site.org"), F.array(F.lit("/wiki/")), F.array(F.lit("Talk:")))
    assert value(spark, column) is ok


def test_admission_without_prefixes(spark):
    none = F.array().cast("array<string>")
    assert value(spark, U.is_admissible(F.lit("https://s.org/x"), F.lit("https://s.org"), none, none)) is True


def test_absolute_urls(spark):
    rows = [("../x?y#z", "https://e.org/a/b/c"), ("#f", "https://e.org/p"), ("mailto:a@b.c", "https://e.org/"), ("http://[bad", "https://e.org/"), ("a b", "https://E.org"), ("./y", "https://u:p@e.org/a/")]
    got = [r[0] for r in spark.createDataFrame(rows, "h string, b string").select(U.absolute_url("h", "b")).collect()]
    assert got == ["https://e.org/a/x?y#z", "https://e.org/p#f", "mailto:a@b.c", None, "https://e.org/a%20b", "https://u:p@e.org/a/y"]


def test_default_timezone_is_utc(spark):
    assert value(spark, S.utc_day(ts("2024-01-01 23:59:59"))) == datetime(2024, 1, 1).date()
