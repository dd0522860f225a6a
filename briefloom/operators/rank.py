"""Ranking and top-k. Every order ends in a unique column, so results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from briefloom import lexicon as lx
from briefloom.functions import score
from briefloom.operators import items as it, order as order_

# Spark prunes `row_number <= k` before the shuffle up to this k (spark.sql.optimizer.windowGroupLimitThreshold).
_PRUNED_K = 1000
_SLICES = 64


def top_k(
    df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = (), rank_col: str = "rank",
    spread: Sequence[str] = (),
) -> DataFrame:
    """First k rows per group with their rank.

    Up to k = 1000 Spark keeps only k rows per group and task before it shuffles, so a hot group costs no more than
    another. For larger k each group is first cut in slices (hash of `spread`), then the slices' survivors are ranked.
    Without groups it is one distributed top-k.
    """
    order = list(order)
    if not by:
        return df.orderBy(*order).limit(k).withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    if k > _PRUNED_K:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(_SLICES)))
        part = Window.partitionBy(*by, "_slice").orderBy(*order)
        df = sliced.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= k).drop("_n", "_slice")
    whole = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(whole)).filter(F.col(rank_col) <= k)


def rank_order(tie: str = "position") -> list[Column]:
    return [
        F.col("priority").asc(),
        F.col("_provider").asc(),
        F.col("_impact").desc(),
        F.col("_quality").desc(),
        F.col("published_at").desc_nulls_last(),
        F.col(tie).asc(),
    ]


def rank_items(
    items: DataFrame, limit: int, lexicon: lx.Lexicon = lx.AI, by: Sequence[str] = (), tie: str = "position"
) -> DataFrame:
    """Priority, provider, impact, source quality, newest, earliest arrival; the best `limit` rows with `rank`."""
    scored = items.withColumns(
        {
            "_provider": score.provider_priority(it._whole_text(), lexicon.providers),
            "_impact": it.impact(lexicon),
            "_quality": score.source_quality_score(F.col("source_type")),
        }
    )
    return top_k(scored, limit, rank_order(tie), by).drop("_provider", "_impact", "_quality")


def display_order(tie: str) -> list[Column]:
    return [score.display_rank(F.col("source_type")).asc(), F.col("published_at").desc_nulls_last(), F.col(tie).asc()]


def display_sort(items: DataFrame, limit: int = 12, by: Sequence[str] = (), tie: str = "seq") -> DataFrame:
    """Reading order of a report: source class, then newest."""
    return top_k(items, limit, display_order(tie), by, "display_position")


def appendix_order(tie: str) -> list[Column]:
    c = F.col
    provider = score.has_core_provider(
        score.haystack(c("title"), c("summary"), c("source_name")), lx.RENDER_PROVIDERS
    )
    return [
        score.render_bucket(c("source_type"), c("title"), c("summary"), c("source_name")).asc(),
        F.when(provider, 0).otherwise(1).asc(),
        F.when(c("is_primary"), 0).otherwise(1).asc(),
        c("published_at").desc_nulls_last(),
        c(tie).asc(),
    ]


def appendix_sort(report_items: DataFrame, limit: int, by: Sequence[str] = (), tie: str = "position") -> DataFrame:
    """Appendix order: section, provider first, primary first, newest."""
    return top_k(report_items, limit, appendix_order(tie), by, "appendix_position")


def top_k_per_source(items: DataFrame, k: int, source: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First or newest k rows of each feed, page or repository."""
    return top_k(items, k, order, source, "source_position")


def distinct_source_officials(items: DataFrame, n: int = 2, by: Sequence[str] = (), tie: str = "seq") -> DataFrame:
    """Newest official row of each of the n publishers with the newest rows."""
    publisher = F.lower(F.trim(F.col("source_name")))
    newest = F.struct(
        F.coalesce(F.unix_micros("published_at"), F.lit(-(1 << 62))).alias("ts"), order_.first_most(items, tie).alias("tie")
    )
    best = (
        items.filter((F.col("source_type") == "official_news") & (publisher != ""))
        .groupBy(*by, publisher.alias("_publisher"))
        .agg(F.max_by(F.struct(*items.columns), newest).alias("_row"))
        .select("_row.*")
    )
    return top_k(best, n, [F.col("published_at").desc_nulls_last(), F.col(tie).asc()], by, "official_position")


def first_candidate(items: DataFrame, cls: str, by: Sequence[str] = (), tie: str = "seq") -> DataFrame:
    """Best row per class column (a source type or a provider key): display rank, newest, earliest."""
    return top_k(items.filter(F.col(cls).isNotNull()), 1, display_order(tie), [*by, cls], "_n").drop("_n")
