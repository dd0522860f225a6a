"""Quotes: from price bars, from exchange responses, and the choice among providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from briefloom.functions.text import safe_float, text_or_empty
from briefloom.operators.rank import top_k


def _rounded(**cols) -> list:
    return [F.round(c, 2).alias(name) for name, c in cols.items()]


def daily_bars(bars: DataFrame, *, last_bar: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Per symbol and day: close of the last bar; open, low and high of the first bar (or of the last one).

    One aggregate with map-side combine, so a symbol with very many bars is no hot key.
    """
    pick = F.max_by if last_bar else F.min_by
    return bars.groupBy(*by, "symbol", F.to_date("ts").alias("day")).agg(
        *[pick(c, "ts").alias(c) for c in ("open", "low", "high")], F.max_by("close", "ts").alias("close")
    )


def quotes_from_bars(
    bars: DataFrame, source: str = "bars", *, last_bar: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """Quote of the latest day per symbol; the change is against the close of the day before, else zero.

    `bars`: symbol, ts, open, low, high, close. Rows without a symbol are dropped.
    """
    valid = bars.filter(text_or_empty(F.col("symbol")) != "")
    numbers = {c: safe_float(F.col(c)) for c in ("open", "low", "high", "close")}
    days = daily_bars(valid.withColumns(numbers), last_bar=last_bar, by=by)
    # a symbol has one row per day here, so its window is short
    in_time = Window.partitionBy(*by, "symbol").orderBy("day")
    rows = top_k(days.withColumn("prev", F.lag("close").over(in_time)), 1, [F.col("day").desc()], [*by, "symbol"], "_n")
    change = F.col("close") - F.coalesce("prev", "close")
    return rows.select(
        *by, "symbol",
        *_rounded(price=F.col("close"), change=change, low=F.col("low"), high=F.col("high"), open=F.col("open"), close=F.col("close")),
        F.lit(source).alias("source"),
    )


def quotes_from_exchange_json(raw: DataFrame, source: str = "exchange", by: Sequence[str] = ()) -> DataFrame:
    """Quote from the first entry of an exchange response (`symbol`, `payload`); prices not above zero are rejected."""
    entry = F.get(
        F.from_json("payload", "msgArray ARRAY<STRUCT<z: STRING, y: STRING, l: STRING, h: STRING, o: STRING>>")["msgArray"], F.lit(0)
    )
    rows = raw.select(*by, "symbol", entry.alias("e")).filter(F.col("e").isNotNull())
    e = F.col("e")
    rows = rows.withColumn("price", safe_float(F.coalesce(F.nullif(e["z"], F.lit("")), e["y"])))
    price = F.col("price")
    rows = rows.filter(price > 0)
    named = {n: safe_float(e[k], price) for n, k in (("prev", "y"), ("low", "l"), ("high", "h"), ("open", "o"))}
    return rows.select(
        *by, "symbol",
        *_rounded(
            price=price, change=price - named["prev"], low=named["low"], high=named["high"], open=named["open"], close=price
        ),
        F.lit(source).alias("source"),
    )


def quote_fallback(*providers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per symbol the quote of the first provider, in the given order, which has one."""
    union = None
    for i, quotes in enumerate(providers):
        part = quotes.withColumn("_provider", F.lit(i))
        union = part if union is None else union.unionByName(part)
    columns = [c for c in union.columns if c not in (*by, "symbol", "_provider")]
    best = union.groupBy(*by, "symbol").agg(F.min_by(F.struct(*columns), "_provider").alias("_row"))
    return best.select(*by, "symbol", "_row.*")


def quote_sequence(quotes: DataFrame, by: Sequence[str] = ("report_id",)) -> DataFrame:
    """Number the few quotes of a report by symbol."""
    return quotes.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy("symbol")))
