"""Joins between report rows and items. Items are reduced to one row per key first, so no key is hot on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from briefloom.functions import text, urls
from briefloom.operators import items as it


def with_match_keys(df: DataFrame) -> DataFrame:
    """Add `url_key` (canonical address) and `title_key` (letters and digits of every script) where they are not there."""
    if {"url_key", "title_key"} <= set(df.columns):
        return df
    return df.withColumns({"url_key": urls.canonicalize_url(F.col("url")), "title_key": text.title_key_alnum(F.col("title"))})


def match_items(
    report_items: DataFrame, items: DataFrame, columns: Sequence[str], by: Sequence[str] = ("report_id",), seq: str = "seq"
) -> DataFrame:
    """Add `matched`, the item with the same address (last one counts), else with the same title (first one counts)."""
    by = list(by)
    keyed = with_match_keys(items)
    row = F.struct(*columns)
    by_url = keyed.filter("url_key != ''").groupBy(*by, "url_key").agg(F.max_by(row, seq).alias("_u"))
    by_title = keyed.filter("title_key != ''").groupBy(*by, "title_key").agg(F.min_by(row, seq).alias("_t"))
    return (
        with_match_keys(report_items)
        .join(by_url, [*by, "url_key"], "left")
        .join(by_title, [*by, "title_key"], "left")
        .withColumn("matched", F.coalesce("_u", "_t"))
        .drop("_u", "_t")
    )


def hydrate_metadata(
    report_items: DataFrame, items: DataFrame, by: Sequence[str] = ("report_id",), seq: str = "seq"
) -> DataFrame:
    """Fill source name, source type and date of report rows from the matching item where they are empty."""
    wanted = ["source_name", "source_type", "published_at_raw", "published_at"]
    out = match_items(report_items, items, wanted, by, seq)

    def filled(col: str):
        known = F.coalesce(F.col(col), F.lit(""))
        return F.when(~known.isin("", "unknown"), F.col(col)).otherwise(F.coalesce(F.col(f"matched.{col}"), F.col(col)))

    undated = F.coalesce("published_at_raw", F.lit("")) == ""
    dates_ = {
        c: F.when(undated, F.coalesce(F.col(f"matched.{c}"), F.col(c))).otherwise(F.col(c))
        for c in ("published_at_raw", "published_at")
    }
    return out.withColumns({"source_name": filled("source_name"), "source_type": filled("source_type"), **dates_}).select(
        *report_items.columns
    )


def _without(df: DataFrame, report_items: DataFrame, by: Sequence[str]) -> DataFrame:
    by = list(by)
    keys = with_match_keys(report_items)
    for key in ("url_key", "title_key"):
        df = df.join(keys.filter(F.col(key) != "").select(*by, key).distinct(), [*by, key], "left_anti")
    return df


def without_reported(items: DataFrame, report_items: DataFrame, by: Sequence[str] = ("report_id",)) -> DataFrame:
    """Items whose address and title the report does not hold. Keeps `url_key` and `title_key`.

    Two anti joins on equal keys; one join on "address or title" would compare every pair.
    """
    return _without(with_match_keys(items), report_items, by)


def report_has_item(items: DataFrame, report_items: DataFrame, by: Sequence[str] = ("report_id",), seq: str = "seq") -> DataFrame:
    """Items which the report holds, by address or title."""
    absent = without_reported(items, report_items, by).select(*by, seq)
    return items.join(absent, [*by, seq], "left_anti")


def appendix(pool: DataFrame, report_items: DataFrame, by: Sequence[str] = ("report_id",)) -> DataFrame:
    """Eligible pool rows whose address is not in the report and whose lower-case title is not either."""
    by = list(by)
    rows = pool.filter(it.is_appendix_eligible()).withColumn("_title", F.lower(text.strip_text(F.col("title"))))
    known_urls = report_items.filter(F.coalesce("url", F.lit("")) != "").select(*by, "url").distinct()
    known_titles = (
        report_items.select(*by, F.lower(text.strip_text(F.col("title"))).alias("_title")).filter("_title != ''").distinct()
    )
    return rows.join(known_urls, [*by, "url"], "left_anti").join(known_titles, [*by, "_title"], "left_anti").select(*pool.columns)
