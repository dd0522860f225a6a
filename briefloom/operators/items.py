"""Raw rows to items (P7), and the row filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from briefloom import lexicon as lx
from briefloom.functions import dates, keys, score, text, urls
from briefloom.functions.core import let
from briefloom.functions.text import holds, normalize_text

_OPTIONAL = {
    "tags": "array<string>", "keyword_match": "string", "recent_feature_signal": "boolean", "category": "string",
}


def with_optional_columns(raw: DataFrame) -> DataFrame:
    """Add the columns a source may leave out."""
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in raw.columns}
    return raw.withColumns(missing) if missing else raw


def trim_descriptions(raw: DataFrame, n: int = 220) -> DataFrame:
    return raw.withColumn("desc", text.trim_desc(F.col("desc"), n))


def normalize_items(
    raw: DataFrame, *, default_source_name: str = "unknown", default_source_type: str = "unknown"
) -> DataFrame:
    """Text, address, defaults, parsed date and family keys. Tags and priority follow in `with_tags`."""
    c = F.col
    # three projections, each using the texts of the one before, so no text is normalised twice
    out = with_optional_columns(raw).withColumns(
        {
            "title": normalize_text(c("title")),
            "url": normalize_text(c("url")),
            "desc": normalize_text(c("desc")),
            "source_name": F.coalesce(F.nullif(normalize_text(c("source_name")), F.lit("")), F.lit(default_source_name)),
            "source_type": F.coalesce(F.nullif(normalize_text(c("source_type")), F.lit("")), F.lit(default_source_type)),
            "published_at_raw": F.nullif(normalize_text(c("published_at_raw")), F.lit("")),
            "tags": F.coalesce(c("tags"), F.array().cast("array<string>")),
        }
    )
    out = out.withColumns(
        {
            "url": urls.canonicalize_url(c("url"), normalized=True),
            "published_at": dates.parse_published_at(c("published_at_raw"), normalized=True),
        }
    )
    return out.withColumns(
        {
            "model_family_key": keys.model_family_key(c("title"), c("source_name"), c("source_type")),
            "release_family_key": keys.release_family_key(c("title"), c("source_name"), c("url")),
        }
    )


def with_tags(items: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Tags where a source gave none, and the priority, from title and description."""
    body = F.concat_ws(" ", "title", "desc")
    if not terms:
        return items.withColumn("priority", F.lit(999))
    return items.withColumns(
        {
            "tags": F.when(F.size("tags") > 0, F.col("tags")).otherwise(text.infer_tags(body, terms)),
            "priority": text.priority(body, terms),
        }
    )


# --- predicates over normalised items -------------------------------------------------------------------------


def has_title_url() -> Column:
    return (F.col("url") != "") & (F.col("title") != "")


def body_text() -> Column:
    """What the predicates look at: lower-case title and description."""
    return score.haystack(F.col("title"), F.col("desc"))


def _judged(body: Column | None, judge: Callable[[Column], Column]) -> Column:
    # a staged column can be named many times; the expression itself is bound once
    return let(body_text(), judge) if body is None else judge(body)


def is_low_signal(lexicon: lx.Lexicon = lx.AI, *, body: Column | None = None) -> Column:
    """Generic community posts, and teaching or marketing pieces of news sources. `body`: a staged `body_text()`."""
    short = (F.length("title") < 18) | (
        F.lower("title").startswith("[reddit") & (F.size(F.split("title", " ")) <= 3)
    )

    def teaching(v: Column) -> Column:
        academy = F.contains(F.lower("url"), F.lit(lx.ACADEMY_URL)) & ~holds(v, lx.ACADEMY_ALLOW)
        return academy | (holds(v, lexicon.promo) & ~holds(v, lexicon.promo_allow))

    return (
        F.when(F.col("source_type") == "community", short)
        .when(F.col("source_type").isin("official_news", "news"), _judged(body, teaching))
        .otherwise(False)
    )


def is_relevant(lexicon: lx.Lexicon = lx.AI, *, whole_words: bool = False, body: Column | None = None) -> Column:
    """Provider incidents stay, negative terms go, trusted sources and feature news stay, else a positive term decides."""
    signal = F.coalesce(F.col("recent_feature_signal"), F.lit(False))

    def judge(v: Column) -> Column:
        def has(terms: Sequence[str]) -> Column:
            return holds(v, terms, whole_words=whole_words)

        return (
            F.when(has(lexicon.providers) & has(lexicon.incident) & has(lexicon.incident_context), True)
            .when(has(lexicon.negative), False)
            .when(F.col("source_type").isin(*lexicon.trusted_types), True)
            .when((F.col("source_type") == "community") & signal, True)
            .otherwise(has(lexicon.positive))
        )

    return _judged(body, judge)


def is_recent(max_age_days: int, now: Column, *, require_date: bool = False) -> Column:
    """Not older than the window; later dates pass, undated rows pass unless a date is required."""
    fresh = F.col("published_at") >= now - F.make_dt_interval(F.lit(max_age_days))
    return F.coalesce(fresh, F.lit(not require_date))


def impact(lexicon: lx.Lexicon = lx.AI) -> Column:
    return score.impact_score(_whole_text(), F.col("source_type"), lexicon)


def is_high_impact(now: Column, days: int = 30, lexicon: lx.Lexicon = lx.AI) -> Column:
    return (impact(lexicon) > 0) & is_recent(days, now, require_date=True)


def is_appendix_eligible() -> Column:
    signal = F.coalesce(F.col("recent_feature_signal"), F.lit(False)) | (F.coalesce(F.col("keyword_match"), F.lit("")) != "")
    return (F.col("source_type") != "community") | signal


def _whole_text() -> Column:
    return score.haystack(F.col("title"), F.col("desc"), F.col("source_name"), F.col("url"))


# --- filters ----------------------------------------------------------------------------------------------------


def require_title_url(items: DataFrame) -> DataFrame:
    return items.filter(has_title_url())


def drop_low_signal(items: DataFrame, lexicon: lx.Lexicon = lx.AI) -> DataFrame:
    return items.filter(~is_low_signal(lexicon))


def keep_relevant(items: DataFrame, lexicon: lx.Lexicon = lx.AI, *, whole_words: bool = False) -> DataFrame:
    return items.filter(is_relevant(lexicon, whole_words=whole_words))


def relevant_raw(raw: DataFrame, lexicon: lx.Lexicon = lx.AI) -> DataFrame:
    """Relevance of raw rows, judged on their normalised form; the rows themselves stay raw."""
    judged = raw.withColumns({"_raw": F.struct(*raw.columns)})
    judged = normalize_items(judged).filter(is_relevant(lexicon))
    return judged.select("_raw.*")


def keep_recent(items: DataFrame, max_age_days: int, now: Column, *, require_date: bool = False) -> DataFrame:
    return items.filter(is_recent(max_age_days, now, require_date=require_date))


def high_impact_archive(items: DataFrame, now: Column, days: int = 30, lexicon: lx.Lexicon = lx.AI) -> DataFrame:
    return items.filter(is_high_impact(now, days, lexicon))


def drop_invalid_urls(report_items: DataFrame) -> DataFrame:
    return report_items.filter(urls.is_valid_source_url(F.col("url")))
