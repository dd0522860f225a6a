"""Cross-run de-duplication: what earlier runs reported, with a time to live counted from first sight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from briefloom.functions import urls
from briefloom.operators.rank import top_k

TTL_HOURS = 26
CAP = 2000


def fingerprint_of_item() -> Column:
    c = F.col
    return urls.fingerprint(c("title"), c("url"), c("source_name"), c("source_type"))


def _newest(history: DataFrame, cap: int) -> DataFrame:
    order = [F.col("seen_at").desc(), F.col("pos").desc(), F.col("fingerprint")]
    return top_k(history, cap, order, ["category"], "_n", spread=["fingerprint"]).drop("_n")


def active_history(history: DataFrame, now: Column, ttl_hours: float = TTL_HOURS, cap: int | None = CAP) -> DataFrame:
    """Entries not older than the time to live (equal age is active), the newest `cap` per category; None: all of them, unsorted."""
    age = F.unix_micros(now) - F.unix_micros("seen_at")
    active = history.filter(age <= F.lit(int(ttl_hours * 3_600_000_000)))
    return active if cap is None else _newest(active, cap)


def filter_new(
    items: DataFrame,
    history: DataFrame,
    limit: int,
    by: Sequence[str] = ("category",),
    rank: str = "rank",
    fingerprint: str = "fingerprint",
    shared: Sequence[str] = ("category",),
) -> tuple[DataFrame, DataFrame]:
    """First `limit` unseen rows per group in rank order, and per group the number of seen rows met on the way.

    `history` is the active history, common to all groups with the same `shared` columns. Repeats inside the batch
    count as seen. Copies of one fingerprint are reduced to the first before the join, so a fingerprint with many
    copies is no hot key.
    """
    by = list(by)
    known = history.select(*shared, F.col("fingerprint").alias(fingerprint)).distinct()
    first = (
        items.groupBy(*by, fingerprint)
        .agg(F.min_by(F.struct(*[c for c in items.columns if c not in (*by, fingerprint)]), rank).alias("_row"))
        .join(known, [*shared, fingerprint], "left_anti")
        .select(*by, fingerprint, "_row.*")
        .select(*items.columns)
    )
    fresh = top_k(first, limit, [F.col(rank)], by, "fresh_position")
    cut = fresh.groupBy(*by).agg(F.count(F.lit(1)).alias("fresh"), F.max(rank).alias("_last"))
    # past the last fresh row nothing is looked at; a group short of its limit is read to the end
    met = (F.col("fresh") < limit) | F.col("fresh").isNull() | (F.col(rank) <= F.col("_last"))
    metrics = (
        items.select(*by, rank)
        .join(cut, by, "left")
        .groupBy(*by)
        .agg(F.count_if(met).alias("_met"), F.coalesce(F.max("fresh"), F.lit(0)).alias("fresh"))
        .select(*by, "fresh", (F.col("_met") - F.col("fresh")).alias("skipped"))
    )
    return fresh, metrics


def all_seen_fallback(
    fresh: DataFrame, recent: DataFrame, limit: int, by: Sequence[str] = ("category",), rank: str = "rank"
) -> DataFrame:
    """Where a group has recent rows but no fresh one, its best recent rows; else the fresh rows."""
    by = list(by)
    empty = recent.join(fresh.select(*by).distinct(), by, "left_anti")
    again = top_k(empty, limit, [F.col(rank)], by, "fresh_position")
    return fresh.unionByName(again.select(*fresh.columns))


def remember(
    history: DataFrame, items: DataFrame, now: Column, cap: int = CAP, ttl_hours: float = TTL_HOURS, rank: str = "rank"
) -> DataFrame:
    """Active history plus the fingerprints it does not hold yet. Known entries keep their first sight."""
    active = active_history(history, now, ttl_hours, cap)
    new = (
        items.groupBy("category", "fingerprint")
        .agg(F.min(rank).cast("bigint").alias("pos"))
        .join(active.select("category", "fingerprint"), ["category", "fingerprint"], "left_anti")
        .select("category", "fingerprint", now.alias("seen_at"), "pos")
    )
    return _newest(active.select("category", "fingerprint", "seen_at", "pos").unionByName(new), cap)


def anti_history(items: DataFrame, history: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Rows whose fingerprint the active history does not hold."""
    return items.join(history.select(*by, "fingerprint"), [*by, "fingerprint"], "left_anti")
