"""URL functions: parts, canonical form, admission and resolution."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.functions.shaping import let

_URL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\\s]+)([^?#]*)(\\?[^#]*)?(#.*)?$"
_DEFAULT_PORT = "^(http://.*):80$|^(https://.*):443$"


def is_url(url: Column) -> Column:
    return url.isNotNull() & url.rlike(_URL)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def origin(url: Column) -> Column:
    """Scheme and host in lower case, without a default port; NULL when not a URL."""
    raw = F.lower(F.concat(_part(url, 1), F.lit("://"), _part(url, 2)))
    return F.when(is_url(url), F.regexp_replace(raw, _DEFAULT_PORT, "$1$2"))


def path(url: Column) -> Column:
    raw = _part(url, 3)
    return F.when(is_url(url), F.when(raw == "", F.lit("/")).otherwise(raw))


# Schemes with a host and a path of segments, their ports, and what each part escapes.
_HOST_SCHEMES = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_HOST_URL = "(?is)^(" + "|".join(_HOST_SCHEMES) + "):[/\\\\]*([^/\\\\?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$"
_OTHER_URL = "(?s)^([A-Za-z][A-Za-z0-9+.-]*):([^?#]*)(\\?[^#]*)?(#.*)?$"
_AUTHORITY = "(?s)^(?:(.*)@)?(\\[[0-9A-Fa-f:.]+\\]|[^\\x00-\\x20\"#%/:<>?@\\[\\\\\\]^`{|}\\x7f]+)(?::0*([0-9]{0,5}))?$"
_ESCAPED_IN_PATH = "\\x00-\\x20\"#<>?^`{}\\x7f-\\x{10FFFF}"
_ESCAPED_IN_QUERY = "\\x00-\\x20\"#<>'\\x7f-\\x{10FFFF}"
_ESCAPED_IN_FRAGMENT = "\\x00-\\x20\"<>`\\x7f-\\x{10FFFF}"
_HERE, _UP = "(?i)^(\\.|%2e)$", "(?i)^(\\.|%2e){2}$"


def _escaped(text: Column, unsafe: str) -> Column:
    """Percent-encode the characters of a class; only text that has one is taken apart."""
    runs = F.regexp_extract_all(text, F.lit(f"([{unsafe}]+|[^{unsafe}]+)"), F.lit(1))
    encode = lambda run: F.when(run.rlike(f"^[{unsafe}]"), F.replace(F.url_encode(run), F.lit("+"), F.lit("%20"))).otherwise(run)
    return F.when(text.rlike(f"[{unsafe}]"), F.array_join(F.transform(runs, encode), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """Absolute path with its dot segments resolved; one at the end leaves an empty segment."""

    def enter(done: Column, segment: Column) -> Column:
        above = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment.rlike(_UP), above).when(segment.rlike(_HERE), done).otherwise(F.concat(done, F.array(segment)))

    def resolve(segments: Column) -> Column:
        last = F.element_at(segments, -1)
        ends_open = last.rlike(_HERE) | last.rlike(_UP)
        done = F.aggregate(segments, F.array().cast("array<string>"), enter)
        closed = F.concat(done, F.when(ends_open, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
        return F.concat(F.lit("/"), F.array_join(closed, "/"))

    slashed = F.regexp_replace(F.translate(path, "\\", "/"), "^/", "")
    dotted = slashed.rlike("(?i)(^|/)(\\.|%2e){1,2}(/|$)")
    return F.when(dotted, let(F.split(slashed, "/"), resolve)).otherwise(F.concat(F.lit("/"), slashed))


def _query(raw: Column, strip_params: list[str], unsafe: str) -> Column:
    query = F.substring(raw, F.lit(2), F.length(raw))
    if strip_params:
        pairs = F.filter(F.split(query, "&"), lambda p: p != "")
        kept = F.filter(pairs, lambda p: ~_form_decoded(F.substring_index(p, "=", 1)).isin(strip_params))
        query = F.array_join(F.transform(kept, _form_encoded_pair), "&")
    else:
        query = _escaped(query, unsafe)
    return F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))


def canonical_url(url: Column, strip_params: list[str], drop_fragment: bool = True) -> Column:
    """URL in its standard form, without the listed query parameters; NULL when not a URL.

    Outer blanks and line breaks are taken out, scheme and host come in lower case, default
    ports and an empty query go, dot segments are resolved, what may not stand in a part is
    percent-encoded, and user names stay. Once parameters are to be stripped, the rest of the
    query is written again in form encoding, stripped or not. Schemes without a host
    (`mailto:`) keep their path as written. Host names are not converted to their ASCII form.
    """

    def standard(text: Column) -> Column:
        def part(group: int) -> Column:
            return F.regexp_extract(text, _HOST_URL, group)

        scheme, authority = F.lower(part(1)), part(2)
        user = F.regexp_extract(authority, _AUTHORITY, 1)
        host = F.lower(F.regexp_extract(authority, _AUTHORITY, 2))
        port = F.regexp_extract(authority, _AUTHORITY, 3)
        standard_port = F.lit(False)
        for name, number in _HOST_SCHEMES.items():
            standard_port = standard_port | ((scheme == name) & (port == number))
        valid = authority.rlike(_AUTHORITY) & (F.coalesce(F.try_to_number(port, F.lit("99999")), F.lit(0)) <= 65535)
        return F.when(
            valid,
            F.concat(
                scheme,
                F.lit("://"),
                F.when(F.ltrim(user, F.lit(":")) == "", F.lit("")).otherwise(F.concat(F.replace(user, F.lit("@"), F.lit("%40")), F.lit("@"))),
                host,
                F.when((port == "") | standard_port, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
                _escaped(_without_dots(part(3)), _ESCAPED_IN_PATH),
                _query(part(4), strip_params, _ESCAPED_IN_QUERY),
                F.lit("") if drop_fragment else _escaped(part(5), _ESCAPED_IN_FRAGMENT),
            ),
        )

    def opaque(text: Column) -> Column:
        def part(group: int) -> Column:
            return F.regexp_extract(text, _OTHER_URL, group)

        query = _query(part(3), strip_params, _ESCAPED_IN_QUERY.replace("'", ""))
        fragment = F.lit("") if drop_fragment else _escaped(part(4), _ESCAPED_IN_FRAGMENT)
        return F.concat(F.lower(part(1)), F.lit(":"), part(2), query, fragment)

    def form(text: Column) -> Column:
        with_host = F.lower(F.substring_index(text, ":", 1)).isin(*_HOST_SCHEMES)
        return F.when(with_host, F.when(text.rlike(_HOST_URL), standard(text))).when(text.rlike(_OTHER_URL), opaque(text))

    return let(F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\n\\r]", ""), form)


def _form_decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _form_encoded_pair(pair: Column) -> Column:
    name = F.substring_index(pair, "=", 1)
    value = F.substring(pair, F.length(name) + F.lit(2), F.length(pair))
    return F.concat(F.url_encode(_form_decoded(name)), F.lit("="), F.url_encode(_form_decoded(value)))


def is_admissible(url: Column, base_url: Column, path_prefixes: Column, excluded_prefixes: Column) -> Column:
    """Whether a crawled URL belongs to a source.

    Same origin; on one of the path prefixes (none means all); and the path after that
    prefix does not start with an excluded namespace. Text that is no URL is not admitted.
    """

    def on_site(url_path: Column) -> Column:
        on_prefix = F.filter(path_prefixes, lambda p: F.startswith(url_path, p))
        allowed = (F.size(path_prefixes) == 0) | (F.size(on_prefix) > 0)
        prefix = F.coalesce(F.try_element_at(on_prefix, F.lit(1)), F.lit(""))
        rest = F.substring(url_path, F.length(prefix) + F.lit(1), F.length(url_path))
        return let(rest, lambda title: allowed & ~F.exists(excluded_prefixes, lambda p: F.startswith(title, p)))

    return F.coalesce((origin(url) == origin(base_url)) & let(path(url), on_site), F.lit(False))


def _resolve(href: str, base: str) -> str | None:
    try:
        joined = urljoin(base.strip(), href.strip())
        parts = urlsplit(joined)
        if not parts.scheme:
            return None
        if parts.scheme not in ("http", "https"):
            return joined
        if not parts.hostname:
            return None
        port = f":{parts.port}" if parts.port and parts.port != {"http": 80, "https": 443}[parts.scheme] else ""
    except ValueError:
        return None
    user = parts.netloc.rpartition("@")[0]
    host = (f"{user}@" if user.strip(":") else "") + (f"[{parts.hostname}]" if ":" in parts.hostname else parts.hostname)
    encoded_path = quote(parts.path or "/", safe="/%:=&~+!$,;'@()*[]|")
    encoded_query = quote(parts.query, safe="/%:=&~+!$,;@()*[]?|{}`^\\")
    encoded_fragment = quote(parts.fragment, safe="/%:=&~+!$,;'@()*[]?|{}^\\#")
    return urlunsplit((parts.scheme, host + port, encoded_path, encoded_query, encoded_fragment))


@F.pandas_udf(T.StringType())
def absolute_url(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
    """Reference resolved against its page's URL, NULL when it cannot be resolved.

    Schemes other than http are kept: a mail link is a link.
    """
    return pd.Series([None if h is None or b is None else _resolve(h, b) for h, b in zip(hrefs, bases)], dtype=object)
