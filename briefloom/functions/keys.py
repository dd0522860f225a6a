"""Identity keys of items: which rows tell the same story."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from briefloom.functions.core import let, let_sql
from briefloom.functions.text import normalize_text, title_key_ascii
from briefloom.functions.urls import canonicalize_url

# Fixed value: a version named after the model family, as a word of its own.
_MODEL_VERSION = r"(?U)\bgpt[- ](\d+(?:\.\d+)?)\b"
LONG_TITLE = 24
INDEX_WIDTH = 96


_CONTENT_KEY = rf"""g -> transform(array(named_struct(
    'all', lower(concat_ws(' ', g.title, g.rest, g.url)),
    'key', substr(regexp_replace(lower(g.title), '[^a-z0-9]+', ''), 1, 120))), k -> transform(array(
    if(contains(k.all, 'openai'), regexp_extract(k.all, r'{_MODEL_VERSION}', 1), '')), version -> CASE
    WHEN version <> '' THEN concat('release-family:openai-gpt-', version)
    WHEN length(k.key) >= {LONG_TITLE} THEN concat('title:', k.key)
    WHEN g.url <> '' THEN concat('url:', g.url)
    WHEN k.key <> '' THEN concat('title:', k.key)
    ELSE '' END)[0])[0]"""


def _model_version(lowered: Column) -> Column:
    return F.nullif(F.regexp_extract(lowered, _MODEL_VERSION, 1), F.lit(""))


def content_dedupe_key(
    title: Column,
    url: Column,
    source_name: Column | None = None,
    summary: Column | None = None,
    desc: Column | None = None,
    *,
    normalized: bool = False,
) -> Column:
    """Release family, else long title, else address, else short title, else empty.

    `normalized` tells that texts and address already went through `normalize_text` and `canonicalize_url`.
    """
    empty = F.lit("")
    norm = (lambda c: c) if normalized else normalize_text
    texts = [empty if c is None else norm(c) for c in (source_name, summary, desc)]
    given = F.struct(
        norm(title).alias("title"),
        (url if normalized else canonicalize_url(url)).alias("url"),
        F.concat_ws(" ", *texts).alias("rest"),
    )

    return let_sql(given, _CONTENT_KEY)


def model_family_key(title: Column, source_name: Column, source_type: Column) -> Column:
    """Family of a model checkpoint, so that copies of one checkpoint meet; NULL for other rows."""
    family = F.nullif(F.regexp_extract(F.lower(title), r"gemma[- ]4[- ]([a-z0-9]+)", 1), F.lit(""))
    named = (source_type == "model_release") & (F.lower(source_name) == "hugging face")
    return F.when(named & family.isNotNull(), F.concat(F.lit("gemma-4-"), family))


def release_family_key(title: Column, source_name: Column, url: Column) -> Column:
    """Family of a model release, from the title alone; NULL for other rows."""
    version = _model_version(F.lower(title))
    vendor = F.contains(F.lower(source_name), F.lit("openai")) | F.contains(F.lower(url), F.lit("openai.com"))
    return F.when(vendor & version.isNotNull(), F.concat(F.lit("openai-gpt-"), version))


def title_index_key(title: Column) -> Column:
    """96-character title key where the title is long enough to identify a story, else NULL."""
    return let(title_key_ascii(title, INDEX_WIDTH), lambda key: F.when(F.length(key) >= LONG_TITLE, key))


def item_key(item_title: Column, url: Column, source_name: Column, desc: Column, model: Column, release: Column) -> Column:
    """De-dup key of a normalised item before titles are indexed: release family, model family, content key."""
    return F.coalesce(
        F.concat(F.lit("release-family:"), release),
        F.concat(F.lit("model-family:"), model),
        content_dedupe_key(item_title, url, source_name, None, desc, normalized=True),
    )


