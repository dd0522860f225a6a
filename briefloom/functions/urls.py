"""URL columns: canonical form, validity, resolution against a base, link encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from briefloom.functions.core import let, let_sql, sql_string
from briefloom.functions.text import normalize_text, strip_text

# Query keys which only track, and schemes which keep `//` even without a host.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ("ref", "source", "si", "fbclid", "gclid")
_SLASH_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero",
    "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
)

# scheme, authority, path, query, fragment (RFC 3986, appendix B)
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, HOST, PATH, QUERY, FRAGMENT = 1, 2, 3, 4, 5


def url_part(url: Column, part: int) -> Column:
    return F.regexp_extract(url, _PARTS, part)


def _decoded(x: str) -> str:
    # a stray percent sign is data, not an escape
    return f"try_url_decode(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"


def _encoded(x: str) -> str:
    return f"replace(replace(url_encode({x}), '*', '%2A'), '%7E', '~')"


_KEY, _VALUE = "substring_index(p, '=', 1)", "substr(p, length(substring_index(p, '=', 1)) + 2)"
_PAIRS = f"""transform(filter(split(h.query, '&'), p -> p <> ''),
    p -> named_struct('k', {_decoded(_KEY)}, 'v', if(contains(p, '='), {_decoded(_VALUE)}, '')))"""
_KEPT = f"""filter({_PAIRS}, p -> NOT startswith(p.k, '{TRACKING_PREFIX}') AND p.k NOT IN ({', '.join(map(sql_string, TRACKING_KEYS))}))"""
_QUERY = f"if(h.query = '', '', array_join(transform({_KEPT}, p -> concat({_encoded('p.k')}, '=', {_encoded('p.v')})), '&'))"
# cut the address at `#` and `?`, split what is left in head (scheme, authority) and path, and put it together again
_CANONICAL = rf"""u -> if(u = '', '', transform(array(substring_index(u, '#', 1)), b -> transform(array(named_struct(
    'base', substring_index(b, '?', 1),
    'head', regexp_extract(substring_index(b, '?', 1), r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/]*)?', 0),
    'query', substr(b, length(substring_index(b, '?', 1)) + 2),
    'fragment', trim(substr(u, length(b) + 2)))), h -> transform(array(named_struct(
    'scheme', lower(regexp_extract(h.head, '^[^:/]+', 0)),
    'host', lower(regexp_extract(h.head, '//(.*)$', 1)),
    'path', coalesce(nullif(trim(TRAILING '/' FROM substr(h.base, length(h.head) + 1)), ''), '/'),
    'query', {_QUERY})), q -> concat(
    if(q.scheme = '', 'https:', concat(q.scheme, ':')),
    if(q.host <> '' OR startswith(q.path, '//') OR (startswith(q.path, '/')
      AND q.scheme IN ('', {', '.join(map(sql_string, _SLASH_SCHEMES))})), '//', ''),
    q.host, q.path, if(q.query = '', '', concat('?', q.query)), if(h.fragment = '', '', concat('#', h.fragment))))[0])[0])[0])"""


def canonicalize_url(url: Column, *, normalized: bool = False) -> Column:
    """One spelling per address: lower-case scheme and host, no tracking keys, no slash at the end; fragment kept."""
    return let_sql(url if normalized else normalize_text(url), _CANONICAL)


def _tail(query: Column, fragment: Column) -> Column:
    return F.concat(
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def is_valid_source_url(url: Column) -> Column:
    """http(s) with a host."""
    return strip_text(url).rlike(r"^(?i)https?://[^/?#]+")


def _drop_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc))
        .otherwise(F.array_append(acc, s)),
    )
    # a last `.` or `..` names a directory
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise("")
    return F.concat(F.lit("/"), F.array_join(folded, "/"), tail)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page `base`."""
    return let(F.struct(base.alias("base"), strip_text(href).alias("href")), lambda p: _resolve(p["base"], p["href"]))


def _resolve(base: Column, href: Column) -> Column:
    origin = F.concat(url_part(base, SCHEME), F.lit("://"), url_part(base, HOST))
    base_path = url_part(base, PATH)
    base_dir = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), "[^/]*$", "")
    path, query, fragment = url_part(href, PATH), url_part(href, QUERY), url_part(href, FRAGMENT)
    tail = _tail(query, fragment)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(base_dir, path))
    clean = let(full, lambda f: F.when(f.rlike(r"(^|/)\.{1,2}(/|$)"), _drop_dots(f)).otherwise(f))
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(url_part(base, SCHEME), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, base_path, tail))
        .otherwise(F.concat(origin, clean, tail))
    )


def infer_docs_link(text: Column, page_url: Column, hints: Column) -> Column:
    """First hint (array of keyword, url) whose keyword the text holds gives the link, else the page itself."""
    hit = let(F.lower(text), lambda v: F.filter(hints, lambda h: F.contains(v, F.lower(h["keyword"]))))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["url"], page_url)


@F.pandas_udf(T.StringType())
def _encode_link(url: pd.Series) -> pd.Series:
    from urllib.parse import quote, urlsplit

    # Characters each part may carry as they are.
    safe = {"path": "/%:@-._~!$&'()*+,;=", "query": "=&%:@-._~!$'()*+,;/?", "fragment": "=%:@-._~!$&'()*+,;/?"}

    def encode(value):
        if value is None:
            return None
        try:
            parts = urlsplit("".join(ch for ch in value if ch.isprintable()))
        except ValueError:
            return None
        if parts.scheme not in ("http", "https") or not parts.netloc:
            return None
        return parts._replace(**{name: quote(getattr(parts, name), safe=keep) for name, keep in safe.items()}).geturl()

    return url.map(encode, na_action="ignore")


def normalize_link_url(url: Column) -> Column:
    """Link fit for a document block: percent-encoded, NULL unless http(s) with a host."""
    trimmed = strip_text(url)
    return _encode_link(F.nullif(trimmed, F.lit("")))


def fingerprint(title: Column, url: Column, source_name: Column, source_type: Column) -> Column:
    """Identity of an item across runs: title, address and source; text and date do not count."""
    return F.sha2(
        F.concat_ws(
            "\u0001",
            F.lower(normalize_text(title)),
            canonicalize_url(url),
            F.lower(normalize_text(source_name)),
            F.lower(normalize_text(source_type)),
        ),
        256,
    )
