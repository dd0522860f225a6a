"""Selection with quotas (D2) and simple set operations between item tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from briefloom import lexicon as lx
from briefloom.operators.rank import top_k


def _reachable(items: DataFrame, quotas, limit: int, by: Sequence[str], rank: str) -> DataFrame:
    """The rows the selection can reach, a bounded number per group.

    Per type: at most `sum(quotas)` addresses can be taken by other types, so the first quota + that many distinct
    addresses decide. For the fill: the first limit + that many distinct addresses. Nothing else can be picked.
    """
    taken = sum(q for _, q in quotas)
    cols = items.columns
    firsts = items.groupBy(*by, "source_type", "url").agg(F.min_by(F.struct(*cols), rank).alias("_row")).select("_row.*")
    per_type = top_k(firsts, max(q for _, q in quotas) + taken, [F.col(rank)], [*by, "source_type"], "_n").select(*cols)
    # both branches start from the same shuffle, so the rows are made once
    overall = firsts.groupBy(*by, "url").agg(F.min_by(F.struct(*cols), rank).alias("_row")).select("_row.*")
    fill = top_k(overall, limit + taken, [F.col(rank)], by, "_n").select(*cols)
    # a rank names one row of a group, so equal rows of both sides are one row
    return per_type.unionByName(fill).groupBy(*by, rank).agg(F.first(F.struct(*cols)).alias("_row")).select("_row.*")


def select_with_quotas(
    items: DataFrame,
    limit: int = 24,
    quotas: Sequence[tuple[str, int]] = lx.QUOTAS,
    required_types: Sequence[str] = lx.REQUIRED_TYPES,
    by: Sequence[str] = (),
    rank: str = "rank",
) -> DataFrame:
    """Pick by type quotas, fill in rank order, put a missing required type in front; adds `selected_position`.

    The choice is sequential (an address picked for one type is gone for the next), so the bounded set of reachable
    rows of a group is walked once; groups run in parallel.
    """
    by = list(by)
    rows = _reachable(items, quotas, limit, by, rank)
    group = by or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(1))
    slim = rows.select(*group, rank, "url", "source_type")
    schema = T.StructType(
        [slim.schema[c] for c in group] + [slim.schema[rank], T.StructField("selected_position", T.IntegerType())]
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank)
        ranks, found, types = pdf[rank].tolist(), pdf["url"].tolist(), pdf["source_type"].tolist()
        chosen: list[int] = []
        gone: set[str] = set()

        def take(i: int, front: bool = False) -> None:
            chosen.insert(0, i) if front else chosen.append(i)
            gone.add(found[i])

        for kind, quota in quotas:
            left = quota
            for i in range(len(ranks)):
                if left == 0 or len(chosen) >= limit:
                    break
                if types[i] == kind and found[i] not in gone:
                    take(i)
                    left -= 1
        full = len(chosen) >= limit
        for i in range(len(ranks)):
            if len(chosen) >= limit:
                break
            if found[i] not in gone:
                take(i)
        if not full:
            for kind in required_types:
                if not any(types[i] == kind for i in chosen):
                    first = next((i for i in range(len(ranks)) if types[i] == kind), None)
                    if first is not None and found[first] not in gone:
                        take(first, front=True)
        chosen = chosen[:limit]
        out = pdf.iloc[chosen][[*group, rank]].copy()
        out["selected_position"] = range(1, len(chosen) + 1)
        return out

    picked = slim.groupBy(*group).applyInPandas(walk, schema)
    out = rows.join(picked, [*group, rank])
    return out if by else out.drop("_all")


def difference(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of df without a partner in other."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*on), on, "left_anti")


def not_selected(
    recent: DataFrame, selected: DataFrame, limit: int = 12, by: Sequence[str] = (), rank: str = "rank"
) -> DataFrame:
    """Best recent rows whose address was not selected."""
    return top_k(difference(recent, selected, [*by, "url"]), limit, [F.col(rank)], by, "sample_position")


def stock_backfill(
    report_items: DataFrame, candidates: DataFrame, limit: int = 7, by: Sequence[str] = ("report_id",), tie: str = "seq"
) -> DataFrame:
    """Newest candidates, none of them in the report or alike another, until a report has `limit` rows.

    Candidates carry `url_key` and `title_key` and are already without rows the report has. A row can only be taken
    if fewer than `limit` earlier rows of its address (with other titles) and of its title (with other addresses)
    exist, and each taken row blocks fewer than 2 * limit such rows; so 2 * limit^2 rows per report decide exactly.
    """
    by = list(by)
    order = [F.col("published_at").desc_nulls_last(), F.col(tie).asc()]
    first = F.struct(F.coalesce(-F.unix_micros("published_at"), F.lit(1 << 62)).alias("t"), F.col(tie).alias("s"))
    cols = candidates.columns
    # an empty key matches nothing, so such a row stands for itself
    own = candidates.withColumns({f"_{k}": F.when(F.col(k) != "", F.col(k)).otherwise(F.concat(F.lit("\u0000"), F.col(tie).cast("string"))) for k in ("url_key", "title_key")})
    rows = own.groupBy(*by, "_url_key", "_title_key").agg(F.min_by(F.struct(*cols), first).alias("_row")).select("_row.*", "_url_key", "_title_key")
    rows = top_k(rows, limit, order, [*by, "_url_key"], "_n")
    rows = top_k(rows, limit, order, [*by, "_title_key"], "_n")
    rows = top_k(rows, 2 * limit * limit, order, by, "_n")
    have = report_items.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("_have"))
    rows = rows.join(have, by, "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    slim = rows.select(*by, "_n", "_have", "_url_key", "_title_key")
    schema = T.StructType([slim.schema[c] for c in by] + [slim.schema["_n"], T.StructField("position", T.IntegerType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[tuple[str, str]] = set()
        kept = []
        position = int(pdf["_have"].iloc[0])
        for row in pdf.sort_values("_n").itertuples(index=False, name=None):
            mine = {("u", row[-2]), ("t", row[-1])}
            if position >= limit:
                break
            if seen & mine:
                continue
            seen |= mine
            position += 1
            kept.append((*row[: len(by)], row[len(by)], position))
        return pd.DataFrame(kept, columns=[*by, "_n", "position"])

    picked = slim.groupBy(*by).applyInPandas(walk, schema)
    return rows.select(*by, "_n", *[c for c in cols if c not in (*by, "position")]).join(picked, [*by, "_n"]).drop("_n")


def renumber(df: DataFrame, order, by: Sequence[str], col: str = "position") -> DataFrame:
    """Dense positions from 1 within each (small) group."""
    return df.withColumn(col, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int"))
