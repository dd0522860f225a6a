"""Rendering reports to rows: a short message per report, and a list of document blocks per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from briefloom import lexicon as lx
from briefloom.functions import keys, score, text, urls
from briefloom.operators import rank as rk
from briefloom.operators.dedup import first_per_key
from briefloom.operators.report import BY, ITEM_COLUMNS, Style
from briefloom.schemas import RUN

# Limits, colours and texts of both outputs.
MESSAGE_ITEMS = 3
MESSAGE_LIMITS = {"summary": 220, "item_summary": 90, "item_insight": 110, "outlook": 1200, "description": 4096}
COLORS = {"ai": 0x3498DB, "stock": 0x2ECC71}
LINE = "----------------"
NO_QUOTES = "本輪未取得資料"
LINK_TEXT = "🔗 查看原文"
MAX_BLOCKS = 100
SNIPPET = 180


# --- quotes -----------------------------------------------------------------------------------------------------


def quote_text(symbol: Column, price: Column, change: Column, low: Column, high: Column) -> Column:
    """Quote lines; all-digit symbols are local and drop `.00`."""
    local = symbol.rlike("^[0-9]+$")

    def number(c: Column) -> Column:
        shown = F.format_string("%.2f", c)
        return F.when(local, F.regexp_replace(shown, r"\.00$", "")).otherwise(shown)

    delta = F.coalesce(change, F.lit(0.0))
    signed = F.when(
        local, F.concat(F.when(delta >= 0, "+").otherwise("-"), number(F.abs(delta)))
    ).otherwise(F.format_string("%+.2f", delta))
    span = F.when(low.isNull() | high.isNull(), F.lit("-")).otherwise(F.concat(number(low), F.lit("-"), number(high)))
    return F.concat(
        F.lit("**"), symbol, F.lit("**\n現:"), F.when(price.isNull(), F.lit("-")).otherwise(number(price)),
        F.lit(" | 變:"), signed, F.lit("\n區:"), span,
    )


def _market(quotes: DataFrame, market: str) -> DataFrame:
    line = quote_text(F.col("symbol"), F.col("price"), F.col("change"), F.col("low"), F.col("high"))
    listed = F.array_sort(F.collect_list(F.struct("seq", line.alias("t"))))["t"]
    return quotes.filter(F.col("market") == market).groupBy(*BY).agg(F.array_join(listed, "\n\n").alias(f"_{market}"))


# --- message ----------------------------------------------------------------------------------------------------


def _content_key() -> Column:
    c = F.col
    return keys.content_dedupe_key(c("title"), c("url"), c("source_name"), c("summary"))


def render_message(
    reports: DataFrame, rows: DataFrame, style: Style, quotes: DataFrame | None = None, links: DataFrame | None = None
) -> DataFrame:
    """One message per report: quotes (stock), summary, first three stories, outlook, rest count, link."""
    unique = first_per_key(rows, _content_key(), "position", BY)
    total = unique.groupBy(*BY).agg(F.count(F.lit(1)).alias("_total"))
    shown = rk.top_k(unique, MESSAGE_ITEMS, [F.col("position")], BY, "_n")

    def optional(mark: str, col: str, limit: str) -> Column:
        body = F.concat(F.lit(mark), text.truncate_text(F.col(col), MESSAGE_LIMITS[limit]))
        return F.when(F.coalesce(col, F.lit("")) != "", body)

    lines = F.concat_ws(
        "\n", F.lit(LINE), F.concat(F.lit("**["), "title", F.lit("]("), "url", F.lit(")**")),
        optional("• ", "summary", "item_summary"), optional("> 💡 ", "insight", "item_insight"),
    )
    body = shown.groupBy(*BY).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_n", lines.alias("t"))))["t"], "\n").alias("_items")
    )
    out = reports.join(body, BY, "left").join(total, BY, "left")
    rest = F.coalesce("_total", F.lit(0)) - MESSAGE_ITEMS
    report = F.concat_ws(
        "\n",
        optional("📌 **摘要**\n", "summary", "summary"),
        F.col("_items"),
        F.when(
            F.coalesce("outlook", F.lit("")) != "",
            F.concat("outlook_label", F.lit("\n"), text.truncate_text(F.col("outlook"), MESSAGE_LIMITS["outlook"])),
        ),
        F.when(rest > 0, F.concat(F.lit("\n📎 其餘 "), rest.cast("string"), F.lit(" 則延伸內容與來源細節請看 Notion。"))),
    )
    parts = [F.nullif(text.strip_text(report), F.lit(""))]
    if style.kind == "stock":
        for market in ("us", "tw"):
            col = f"_{market}"
            out = out.withColumn(col, F.lit(None).cast("string")) if quotes is None else out.join(_market(quotes, market), BY, "left")
        parts = [
            F.lit("🇺🇸 **美股**"), F.coalesce("_us", F.lit(NO_QUOTES)), F.lit(LINE),
            F.lit("🇹🇼 **台股**"), F.coalesce("_tw", F.lit(NO_QUOTES)), F.lit(LINE), *parts,
        ]
    if links is not None:
        out = out.join(links.select(*BY, "link"), BY, "left")
        parts.append(F.when(F.coalesce("link", F.lit("")) != "", F.concat(F.lit(style.link_text + "("), "link", F.lit(")"))))
    return out.select(
        *BY, F.lit(style.title).alias("title"),
        text.cut(F.concat_ws("\n", *parts), MESSAGE_LIMITS["description"]).alias("description"),
        F.lit(COLORS[style.kind]).alias("color"),
    )


# --- blocks -----------------------------------------------------------------------------------------------------


def render_items(rows: DataFrame) -> DataFrame:
    """Rows in reading order (`shown`): primary rows as they are, then the appendix by section, one row per story.

    At most `MAX_BLOCKS` rows of a report can be shown (every row has a block), so only those are ordered.
    """
    c = F.col
    snippet = text.truncate_text(text.clean_snippet(text.strip_text(c("summary"))), SNIPPET)
    stripped = {k: text.strip_text(c(k)) for k in ("title", "url", "insight", "source_name", "source_type")}
    extra = (
        rows.filter(~c("is_primary"))
        .withColumns({**stripped, "summary": snippet})
        .filter((c("title") != "") & (c("url") != ""))
    )
    union = rows.filter("is_primary").unionByName(extra).withColumn("_key", _content_key())
    order = F.struct(
        (~c("is_primary")).alias("late"),
        F.when(c("is_primary"), c("position")).otherwise(0).alias("own"),
        *[o.alias(f"o{i}") for i, o in enumerate(_appendix_key())],
        c("position").alias("tie"),
    )
    unique = first_per_key(union.withColumn("_order", order), "_key", "_order", BY)
    return rk.top_k(unique, MAX_BLOCKS, [c("_order")], BY, "shown").select(*ITEM_COLUMNS, "shown")


def _appendix_key() -> list[Column]:
    """Appendix order as ascending values; undated rows last. Primary rows are ordered by position alone."""
    c = F.col
    provider = score.has_core_provider(score.haystack(c("title"), c("summary"), c("source_name")), lx.RENDER_PROVIDERS)
    values = [
        score.render_bucket(c("source_type"), c("title"), c("summary"), c("source_name")),
        F.when(provider, 0).otherwise(1),
        F.coalesce(-F.unix_micros("published_at"), F.lit(1 << 62)),
    ]
    return [F.when(c("is_primary"), F.lit(0)).otherwise(v) for v in values]


def text_runs(body: Column, link: Column | None = None) -> Column:
    """The rich text of a block: its text, where there is some, then the run of its link."""
    def run(shown: Column, address: Column, marked: bool) -> Column:
        color = F.lit("blue" if marked else None).cast("string")
        return F.struct(shown.alias("text"), address.cast("string").alias("link"), F.lit(marked).alias("bold"), F.lit(marked).alias("italic"), color.alias("color"))

    own = F.when(F.coalesce(body, F.lit("")) != "", run(body, F.lit(None), False))
    linked = F.lit(None).cast(RUN) if link is None else F.when(link.isNotNull(), run(F.lit(LINK_TEXT), link, True))
    return F.array_compact(F.array(own, linked))


def item_blocks(background: str) -> Column:
    """Blocks of one row: heading, then source line, summary and call-out where there is something to say."""
    c = F.col

    def known(label: str, col: str) -> Column:
        return F.when(~F.coalesce(col, F.lit("")).isin("", "unknown"), F.concat(F.lit(label), col))

    meta = F.concat_ws(
        " | ", known("來源: ", "source_name"), known("分類: ", "source_type"),
        F.when(F.coalesce("published_at_raw", F.lit("")) != "", F.concat(F.lit("時間: "), "published_at_raw")),
    )
    insight = F.when(F.coalesce("insight", F.lit("")) != "", F.concat(F.lit("深度洞察: "), "insight", F.lit("\n\n"))).otherwise("")

    def block(kind: str, body: Column, color: str | None = None, link: Column | None = None) -> Column:
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("type"), F.lit(color).cast("string").alias("color"), body.alias("text"),
            (nothing if link is None else link).alias("link"), text_runs(body, link).alias("runs"),
        )

    callout = "blue_background" if "blue" in background else "gray_background"
    return F.array_compact(
        F.array(
            block("heading_3", c("title")),
            F.when(meta != "", block("paragraph", meta, "gray")),
            F.when(F.coalesce("summary", F.lit("")) != "", block("bulleted_list_item", c("summary"))),
            F.when((insight != "") | c("link_url").isNotNull(), block("callout", insight, callout, c("link_url"))),
        )
    )


def block_budget(rows: DataFrame, used: Column, size: str = "n_blocks", order: str = "shown", limit: int = MAX_BLOCKS) -> DataFrame:
    """Rows in order until the next one would pass the limit; `used` counts the blocks outside the rows."""
    running = Window.partitionBy(*BY).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_running", F.sum(size).over(running)).filter(F.col("_running") + used <= limit).drop("_running")


def render_blocks(reports: DataFrame, rows: DataFrame, style: Style) -> DataFrame:
    """Block rows of every report, at most 100 each, in order of `pos`."""
    background = style.background
    has_summary = F.coalesce("summary", F.lit("")) != ""
    has_outlook = F.coalesce("outlook", F.lit("")) != ""
    used = reports.select(
        *BY, (F.lit(2) + F.when(has_summary, 1).otherwise(0) + F.when(has_outlook, 2).otherwise(0)).alias("_used")
    )
    shown = render_items(rows).withColumn("link_url", urls.normalize_link_url(F.col("url")))
    shown = shown.withColumn("_blocks", item_blocks(background)).withColumn("n_blocks", F.size("_blocks"))
    shown = block_budget(shown.join(used, BY), F.col("_used"))
    body = shown.select(*BY, F.lit(1).alias("_part"), "shown", F.posexplode("_blocks").alias("_i", "_b")).select(
        *BY, "_part", "shown", "_i", "_b.*"
    )

    def fixed(kind: str, body_: Column, color: Column, keep: Column) -> Column:
        return F.when(keep, F.struct(
            F.lit(kind).alias("type"), color.cast("string").alias("color"), body_.cast("string").alias("text"),
            F.lit(None).cast("string").alias("link"), text_runs(body_.cast("string")).alias("runs"),
        ))

    none, always = F.lit(None), F.lit(True)
    head = F.array_compact(
        F.array(
            fixed("heading_2", F.lit(style.heading), F.lit(background), always),
            fixed("divider", none, none, always),
            fixed("paragraph", F.col("summary"), F.lit("gray"), has_summary),
        )
    )
    tail = F.array_compact(
        F.array(
            fixed("divider", none, none, has_outlook),
            fixed("quote", F.concat("outlook_label", F.lit(": "), "outlook"), none, has_outlook),
        )
    )

    def frame(part: int, blocks: Column) -> DataFrame:
        return reports.select(*BY, F.lit(part).alias("_part"), F.lit(0).alias("shown"), F.posexplode(blocks).alias("_i", "_b")).select(
            *BY, "_part", "shown", "_i", "_b.*"
        )

    union = frame(0, head).unionByName(body).unionByName(frame(2, tail))
    order = Window.partitionBy(*BY).orderBy("_part", "shown", "_i")
    return union.withColumn("pos", F.row_number().over(order)).select(*BY, "pos", "type", "color", "text", "link", "runs")
