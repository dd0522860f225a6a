"""Counts and summaries over items."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from briefloom import lexicon as lx
from briefloom.functions import dates
from briefloom.operators import items as it
from briefloom.operators.rank import top_k

# Texts of the source mix.
NO_SOURCES = "未提供來源分類"


def source_counts(items: DataFrame, by: Sequence[str] = (), order: str = "seq") -> DataFrame:
    return (
        items.filter(F.coalesce("source_type", F.lit("")) != "")
        .groupBy(*by, "source_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    )


def source_mix(items: DataFrame, by: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """`name count 則` per source type, most common first, ties by first arrival, as one text per group."""
    counts = source_counts(items, by, order)
    entry = F.struct((-F.col("n")).alias("k"), F.col("first_seen"), F.format_string("%s %d 則", "source_type", "n").alias("t"))
    listed = counts.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(entry))["t"], "、").alias("mix"))
    return listed.withColumn("mix", F.when(F.col("mix") == "", NO_SOURCES).otherwise(F.col("mix")))


def hot_sources(items: DataFrame, k: int = 4, by: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """The k most frequent source names."""
    counts = (
        items.filter(F.coalesce("source_name", F.lit("")) != "")
        .groupBy(*by, "source_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    )
    return top_k(counts, k, [F.col("n").desc(), F.col("first_seen"), F.col("source_name")], by, "hot_rank")


def infer_now(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Latest parsed date; NULL where no row has one."""
    return raw.groupBy(*by).agg(F.max(dates.parse_published_at(F.col("published_at_raw"))).alias("now"))


def star_delta(stars: DataFrame, since: Column, by: Sequence[str] = ("repo",)) -> DataFrame:
    """Stars since a moment per repository; NULL if a row has no time stamp. Unreadable ones are not counted."""
    ts = dates.parse_published_at(F.col("starred_at"))
    missing = F.count_if(F.coalesce(F.col("starred_at"), F.lit("")) == "")
    return stars.groupBy(*by).agg(F.when(missing == 0, F.count_if(ts >= since)).alias("star_delta"))


def run_metrics(
    raw: DataFrame, ranked: DataFrame, chosen: DataFrame | Column, by: Sequence[str] = ("run_id",), *, relevant: Column, recent: Column,
    archive: Column,
) -> DataFrame:
    """Counters of one run, a row per group of `raw`.

    `relevant` is a condition on raw rows; `recent` and `archive` are conditions on ranked rows, and `chosen` is one too or a frame of
    its own. `older_than_window`: dated ranked rows whose address is not among the recent ones. Each frame is read once: flags are
    counted, ranked rows per address first, so that no row is looked up among others.
    """
    by = list(by)
    dated = F.col("published_at").isNotNull()
    flags = {"_recent": recent, "_archive": archive, "_chosen": chosen if isinstance(chosen, Column) else F.lit(False)}
    per_address = ranked.select(*by, "url", dated.alias("_dated"), *[c.alias(n) for n, c in flags.items()]).groupBy(*by, "url").agg(
        F.count(F.lit(1)).alias("ranked_count"), F.count_if("_recent").alias("recent_count"), F.count_if("_archive").alias("high_impact_archive_count"),
        F.count_if("_chosen").alias("_by_flag"), F.count_if(~F.col("_dated")).alias("undated"), F.count_if("_dated").alias("_dated"),
    )
    older = F.when((F.col("recent_count") == 0) | F.col("url").isNull(), F.col("_dated")).otherwise(0)
    counts = ("raw_count", "_relevant", "ranked_count", "recent_count", "high_impact_archive_count", "history_or_limit_count", "undated", "older_than_window")
    parts = [
        raw.groupBy(*by).agg(F.count(F.lit(1)).alias("raw_count"), F.count_if(relevant).alias("_relevant")),
        per_address.withColumns({"older_than_window": older, "history_or_limit_count": F.col("_by_flag")}).drop("url", "_dated", "_by_flag"),
    ]
    if not isinstance(chosen, Column):
        parts.append(chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("history_or_limit_count")))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = every.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).filter("raw_count > 0")
    return out.withColumns({"irrelevant_dropped": F.col("raw_count") - F.col("_relevant"), "trimmed_count": F.col("raw_count")}).drop("_relevant")


def observe_counts(df: DataFrame, name: str, lexicon: lx.Lexicon = lx.AI) -> tuple[DataFrame, Observation]:
    """Counters which ride along with whatever action consumes the frame; no extra job."""
    seen = Observation(name)
    watched = df.observe(
        seen,
        F.count(F.lit(1)).alias("raw_count"),
        F.count_if(~it.is_relevant(lexicon)).alias("irrelevant_dropped"),
        F.count_if(F.col("published_at").isNull()).alias("undated"),
    )
    return watched, seen
