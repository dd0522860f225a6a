"""Text columns: normalising, cutting, term matching, title keys, snippet cleaning."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, functions as F

from briefloom.functions.core import let, let_sql, sql_holds, sql_string

# (?U) lets \s cover NBSP and ideographic space; the four separators below count as space for the source data too.
_SPACE = r"(?U)[\s\x1C-\x1F]+"

# A character reference: numeric, or a name; the semicolon may be missing. Then plain text up to the next ampersand.
_PIECES = r"(?s)&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[^\t\n\f <&#;]{1,32};?)|&|[^&]+"
# Names which were allowed without a semicolon may be followed by other letters.
_OPEN_NAMES = tuple(sorted(k for k in html5 if not k.endswith(";")))
# Code points 80 to 9F stand for the characters of code page 1252 where it has one.
_PAGE_1252 = tuple(bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(0x80, 0xA0))

# Every character which is white space; trimmed as a set, which looks at the ends of a text only.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_text(c: Column) -> Column:
    """NULL to empty, any run of white space to one space, no space at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(c), _SPACE, " "))


def strip_text(c: Column) -> Column:
    return F.trim(text_or_empty(c), F.lit(WHITE_SPACE))


def rstrip_text(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_SPACE))


def cut(c: Column, n: int) -> Column:
    """First n code points."""
    return F.substring(c, 1, n)


def trim_desc(c: Column, n: int = 220) -> Column:
    """Cut to n code points and mark the cut. Works on the raw text, before `normalize_text`."""
    c = text_or_empty(c)
    return F.when(F.length(c) > n, F.concat(rstrip_text(cut(c, n)), F.lit("..."))).otherwise(c)


def truncate_text(c: Column, n: int) -> Column:
    """Cut to at most n code points, the mark included."""
    return let(c, lambda v: F.when(F.length(v) > n, F.concat(rstrip_text(cut(v, n - 3)), F.lit("..."))).otherwise(v))


def holds(lowered: Column, terms: Sequence[str], *, whole_words: bool = False) -> Column:
    """True when a lower-case text holds one of the terms. The text is used once per term: bind it with `let`."""
    if not terms:
        return F.lit(False)
    if whole_words:
        words = "|".join(f"\\Q{t.lower()}\\E" for t in terms)
        return lowered.rlike(f"(?U)\\b(?:{words})\\b")
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(t.lower())) for t in terms))


def contains_any(lowered: Column, terms: Sequence[str], *, whole_words: bool = False) -> Column:
    """True when a lower-case text holds one of the terms; plain substring match unless `whole_words`."""
    if whole_words:
        return let(lowered, lambda v: holds(v, terms, whole_words=True))
    return let_sql(lowered, f"v -> {sql_holds('v', terms)}")


def infer_tags(text: Column, terms: Sequence[str]) -> Column:
    """Terms found in the text, in list order."""
    found = ", ".join(f"if(contains(v, {sql_string(t.lower())}), {sql_string(t)}, NULL)" for t in terms)
    return let_sql(F.lower(normalize_text(text)), f"v -> array_compact(array({found}))")


def priority(text: Column, terms: Sequence[str]) -> Column:
    """Index of the first term in list order which the text holds, else 999."""
    if not terms:
        return F.lit(999)
    arms = " ".join(f"WHEN contains(v, {sql_string(t.lower())}) THEN {i}" for i, t in enumerate(terms))
    return let_sql(F.lower(text), f"v -> CASE {arms} ELSE 999 END")


def matches_keywords(title: Column, summary: Column, keywords: Sequence[str] | Column) -> Column:
    """True when title or summary holds a keyword. Keywords may be a per-row array column."""
    lowered = F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(summary)))
    if isinstance(keywords, Column):
        found = let(lowered, lambda v: F.exists(keywords, lambda k: F.contains(v, F.lower(k))))
        return F.coalesce(found, F.lit(False))
    return contains_any(lowered, keywords)


def title_key_ascii(c: Column, n: int) -> Column:
    return cut(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), n)


def title_key_alnum(c: Column) -> Column:
    """Title key which keeps letters and digits of every script."""
    return cut(F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}]+", ""), 120)


def _char(code: Column) -> Column:
    """The character of a numeric reference; outside Unicode, surrogates and 0 give U+FFFD, controls and non-characters nothing."""
    valid = F.greatest(F.least(code, F.lit(0x10FFFF)), F.lit(1))
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(valid.between(0xD800, 0xDFFF), 1).otherwise(valid)), 8, "0")), "UTF-32")
    dropped = code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when((code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(code.between(0x80, 0x9F), F.get(F.array(*[F.lit(c) for c in _PAGE_1252]), (code - 0x80).cast("int")))
        .when(dropped, F.lit("")).otherwise(plain)
    )


def _resolved(piece: Column) -> Column:
    hexadecimal = F.lower(F.substring(piece, 3, 1)) == "x"
    digits = F.regexp_replace(F.regexp_replace(piece, "[&#xX;]", ""), "^0+", "")
    # eight digits are beyond Unicode in either base
    code = F.when(F.length(digits) > 7, F.lit(0x110000)).when(digits == "", F.lit(0)).otherwise(
        F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    )
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    name = F.substring(piece, F.lit(2), F.length(piece))
    opens = F.from_json(F.lit(json.dumps({k: html5[k] for k in _OPEN_NAMES})), "map<string,string>")

    def longest_open(n: Column) -> Column:
        sizes = F.filter(F.sequence(F.length(n), F.lit(1), F.lit(-1)), lambda i: F.element_at(opens, F.substring(n, F.lit(1), i)).isNotNull())
        size = F.get(sizes, F.lit(0))
        return F.concat(F.element_at(opens, F.substring(n, F.lit(1), size)), F.substring(n, size + 1, F.length(n)))

    return (
        F.when(~F.startswith(piece, F.lit("&")) | (piece == "&"), piece)
        .when(F.startswith(piece, F.lit("&#")), _char(code))
        .otherwise(F.coalesce(F.element_at(names, name), longest_open(name), piece))
    )


def unescape_entities(c: Column) -> Column:
    """Character references to characters, in one pass from left to right: nothing is resolved twice and no reference stops a job.

    Numeric references follow the HTML rules for bad code points; names are those of HTML5. What is no reference stays as it is.
    """
    return let(c, lambda v: F.when(F.contains(v, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(v, F.lit(_PIECES), F.lit(0)), _resolved), "")).otherwise(v))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")


def clean_snippet(c: Column) -> Column:
    """Readable text of a feed snippet: references, comments, tags and collector prefixes removed."""
    plain = strip_text(strip_tags(unescape_entities(text_or_empty(c))))
    prefix = r"(?iU)^(RSS fallback|Search match for [^|]+|Collected from [^.]+ listing page\.)\s*\|?\s*"
    return normalize_text(F.regexp_replace(plain, prefix, ""))


def release_excerpt(body: Column) -> Column:
    """Release notes as one plain line; a fixed sentence where nothing is left."""
    text = F.regexp_replace(text_or_empty(body), r"```[\s\S]*?```", " ")
    text = F.regexp_replace(F.replace(text, F.lit("`"), F.lit("")), r"[*>#-]+", " ")
    return F.coalesce(F.nullif(normalize_text(text), F.lit("")), F.lit("Release details are available on the source page."))


def safe_float(c: Column, default: Column | float = 0.0) -> Column:
    """Cast to double, or the default where the value is no number; number suffixes such as `1d` are none."""
    default = default if isinstance(default, Column) else F.lit(default)
    suffixed = F.coalesce(c.cast("string").rlike(r"^\s*[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?[dDfF]\s*$"), F.lit(False))
    return F.coalesce(F.when(~suffixed, c.try_cast("double")), default)


def number_text(x: Column) -> Column:
    """A double as its shortest decimal text, `.0` included: 1.0E7 is 10000000.0."""
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(x)
    return F.when(F.contains(x.cast("string"), F.lit("E")) & (size >= 1e-4) & (size < 1e16), plain).otherwise(x.cast("string"))


def value_text(v: Column) -> Column:
    """A JSON value as the text it would be shown with; nothing is `None`."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "None")
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), number_text(F.try_variant_get(v, "$", "double")))
        .when(kind.isin("STRING", "BIGINT"), F.try_variant_get(v, "$", "string"))
        .otherwise(F.to_json(v))
    )
