"""Scores, ranks and classes of items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from briefloom import lexicon as lx
from briefloom.functions.core import let, let_sql, sql_holds, sql_string
from briefloom.functions.text import contains_any, holds, normalize_text, text_or_empty


def lookup(c: Column, table: Mapping[str, int], default: int) -> Column:
    out = reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(default)))
    return out.otherwise(F.lit(default))


def source_quality_score(source_type: Column) -> Column:
    return lookup(source_type, lx.SOURCE_SCORE, lx.SOURCE_SCORE["unknown"])


def display_rank(source_type: Column) -> Column:
    """Reading order of a report. Not the order of `source_quality_score`."""
    return lookup(source_type, lx.DISPLAY_RANK, lx.DISPLAY_RANK["unknown"])


def release_item_rank(title: Column) -> Column:
    """0 for an introduction, 3 for a system card, 1 for the rest."""
    return let(
        F.lower(normalize_text(title)),
        lambda v: F.when(F.contains(v, F.lit("system card")), 3)
        .when(v.startswith("[official] introducing ") | v.startswith("introducing "), 0)
        .otherwise(1),
    )


def haystack(*cols: Column) -> Column:
    """Lower-case text of several normalised columns, one space between them."""
    return F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in cols]))


def has_core_provider(lowered: Column, providers: Sequence[str] = lx.CORE_PROVIDERS) -> Column:
    return contains_any(lowered, providers)


def provider_priority(lowered: Column, providers: Sequence[str] = lx.CORE_PROVIDERS) -> Column:
    return F.when(has_core_provider(lowered, providers), 0).otherwise(1)


def impact_score(lowered: Column, source_type: Column, lexicon: lx.Lexicon = lx.AI) -> Column:
    """Weight of named events and of provider incidents; official and research rows get a bonus on top."""

    def points(terms: Sequence[str], n: int) -> str:
        return f"if({sql_holds('v', terms)}, {n}, 0)"

    weight = (
        f"v -> {points(lexicon.named_events, 80)} + if({sql_holds('v', lexicon.providers)}, "
        f"{points(lexicon.high_impact, 35)} + {points(lexicon.incident, 30)}, 0)"
    )
    trusted = source_type.isin("official_news", "research")
    return let(let_sql(lowered, weight), lambda n: n + F.when((n > 0) & trusted, 10).otherwise(0))


def _first_class(lowered: Column, classes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    arms = " ".join(f"WHEN {sql_holds('v', terms)} THEN {sql_string(name)}" for name, terms in classes)
    return let_sql(lowered, f"v -> CASE {arms} END")


def provider_key(source_name: Column, title: Column, url: Column, classes=lx.PROVIDER_KEYS) -> Column:
    return _first_class(haystack(source_name, title, url), classes)


def provider_label(source_name: Column, headline: Column, classes=lx.PROVIDER_LABELS) -> Column:
    # Fixed value: the last fallback label.
    return F.coalesce(
        _first_class(haystack(source_name, headline), classes), F.nullif(source_name, F.lit("")), F.lit("這個來源")
    )


def is_patch_noise(name: Column, tag: Column, body: Column) -> Column:
    """A patch version with a patch marker and nothing of high signal."""
    tag_l = F.lower(text_or_empty(tag))
    noise = let(haystack(name, tag, body), lambda v: holds(v, lx.PATCH_MARKERS) & ~holds(v, lx.PATCH_HIGH_SIGNAL))
    return tag_l.rlike(r"^v?\d+\.\d+\.\d+$") & noise


def recent_feature_signal(title: Column, summary: Column, phrases: Sequence[str] = lx.FEATURE_SIGNAL) -> Column:
    return contains_any(haystack(title, summary), phrases)


def render_bucket(
    source_type: Column, title: Column, summary: Column, source_name: Column, providers=lx.RENDER_PROVIDERS
) -> Column:
    """Appendix section: provider news 0, other 1, community 2 or 3, repositories 4."""
    kind = F.lower(F.trim(text_or_empty(source_type)))
    return let(
        F.struct(kind.alias("kind"), contains_any(haystack(title, summary, source_name), providers).alias("provider")),
        lambda r: F.when(r["kind"].isin("github_repo", "github_release"), 4)
        .when((r["kind"] == "community") & r["provider"], 2)
        .when(r["kind"] == "community", 3)
        .when(r["provider"], 0)
        .otherwise(1),
    )
