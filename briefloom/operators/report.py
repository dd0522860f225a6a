"""Composing reports: local synthesis, landed model responses, coverage, insights (one job for all reports)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from briefloom import lexicon as lx
from briefloom.functions import brief, dates, keys, score, text, urls
from briefloom.functions.core import sql_string
from briefloom.operators import aggregates, items as it, joins, rank as rk, select as sel


@dataclass(frozen=True)
class Style:
    """Fixed texts and limits of one kind of report."""

    kind: str
    title: str
    outlook_label: str
    outlook: str
    item_limit: int
    prompt_limit: int
    task: str
    instructions: tuple[str, ...]
    heading: str
    prefix: str
    background: str
    link_text: str


# Titles, labels, outlooks, prompts and limits.
STOCK = Style(
    kind="stock",
    title="投資情報報告",
    outlook_label="🕵️ 專家總結",
    outlook="先確認價格來源是否處於交易時段，再針對高關聯新聞做基本面與事件驅動拆解，避免把延遲報價和舊聞直接餵進投資判斷。",
    item_limit=7,
    prompt_limit=12,
    task="analyze_stock_market",
    instructions=(
        "回傳 JSON，禁止輸出 markdown 或額外說明。",
        "summary 要總結盤勢、新聞主線與風險。",
        "items 最多 7 筆，每筆要有 title,url,summary,insight。",
        "insight 至少 2 句：先說事件代表的市場或產業意義，再補一個後續要觀察的估值、供應鏈、需求或風險訊號。",
        "outlook 要給後續觀察重點，避免過度肯定的投資建議。",
    ),
    heading="投資與產業分析報告",
    prefix="[投資情報]",
    background="blue_background",
    link_text="📒 [**在 Notion 查看完整深度分析報告**]",
)
AI = Style(
    kind="ai",
    title="AI 技術前沿情報",
    outlook_label="🔮 未來展望",
    outlook="接下來應優先追官方發布、GitHub release、arXiv 與 Hugging Face 指標變化，再把社群熱度當次要訊號，而不是主排序依據。",
    item_limit=12,
    prompt_limit=24,
    task="analyze_ai_tech",
    instructions=(
        "回傳 JSON，禁止輸出 markdown 或額外說明。",
        "summary 要總結今天值得看的模型、agent、SDK、GitHub 專案、論文與官方消息。",
        "items 最多 12 筆，每筆要有 title,url,summary,insight。",
        "insight 至少 2 句：先說這則更新為何重要，再補一句它對產品化、商業化、開發流程或生態系的後續影響。",
        "優先挑選官方發布、GitHub release、快速成長的專案、研究論文，不要挑法律糾紛或社會新聞。",
        "若有版本號、模型名稱、產品名，必須完整保留。",
        "outlook 要指出接下來值得追蹤的官方來源或技術方向。",
    ),
    heading="AI 前沿技術觀察報告",
    prefix="[AI 技術]",
    background="gray_background",
    link_text="📒 [**在 Notion 查看完整 AI 技術情報**]",
)

ITEM_COLUMNS = [
    "report_id", "position", "is_primary", "title", "url", "summary", "insight", "source_name", "source_type",
    "published_at_raw", "published_at",
]
MATCH_KEYS = ["url_key", "title_key"]
BY = ["report_id"]


def _with_brief(items: DataFrame, style: Style) -> DataFrame:
    c = F.col
    made = brief.brief_item(
        style.kind, c("title"), c("url"), c("desc"), c("source_name"), c("source_type"), c("published_at_raw")
    )
    return items.withColumn("_brief", made)


def _news_rows(items: DataFrame, style: Style, position: Column) -> DataFrame:
    """Report rows made of items: own title and source, brief summary and insight."""
    return _with_brief(items, style).withColumns(
        {
            "summary": F.coalesce(
                F.nullif(F.col("_brief.summary"), F.lit("")), F.nullif(F.col("desc"), F.lit("")), F.lit(brief.NO_SUMMARY)
            ),
            "insight": F.col("_brief.insight"),
            "position": position.cast("int"),
            "is_primary": F.lit(True),
        }
    ).drop("_brief")


def brief_rows(items: DataFrame, style: Style) -> DataFrame:
    """The seven brief columns in place of the item's own (used for appendix rows)."""
    names = ("title", "url", "summary", "insight", "source_name", "source_type", "published_at_raw")
    made = {name: F.col(f"_brief.{name}") for name in names}
    return _with_brief(items, style).withColumns({**made, "is_primary": F.lit(False)}).drop("_brief")


# --- headers and fallback ---------------------------------------------------------------------------------------


def _quote_moves(quotes: DataFrame) -> DataFrame:
    # quotes which were read keep their own texts; computed ones have two places of change
    own = {c: F.col(c) if c in quotes.columns else F.lit(None).cast("string") for c in ("price_text", "change_text")}
    price = F.coalesce(own["price_text"], text.number_text(F.col("price").cast("double")), F.lit("None"))
    change = F.coalesce(own["change_text"], F.when(F.col("change").isNotNull(), F.format_string("%+.2f", F.col("change").cast("double"))), F.lit("None"))
    move = F.format_string("%s %s (%s)", F.coalesce("symbol", F.lit("None")), price, change)
    listed = F.array_sort(F.collect_list(F.struct("seq", move.alias("t"))))
    return quotes.groupBy(*BY).agg(F.array_join(listed["t"], "; ").alias("_moves"))


def fallback_report(
    items: DataFrame, style: Style, quotes: DataFrame | None = None, reports: DataFrame | None = None, rank: str = "rank"
) -> tuple[DataFrame, DataFrame]:
    """Header and first rows of every report by local synthesis. `reports` names reports which may have no item."""
    reports = items.select(*BY).distinct() if reports is None else reports.select(*BY).distinct()
    counts = items.groupBy(*BY).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("string")
    head = reports.join(counts, BY, "left")
    if style.kind == "stock":
        head = head.join(aggregates.source_mix(items, BY, rank), BY, "left")
        if quotes is None:
            head = head.withColumn("_moves", F.lit(None).cast("string"))
        else:
            head = head.join(_quote_moves(quotes), BY, "left")
        summary = F.concat(
            F.lit("本輪共整理 "), n, F.lit(" 則市場相關消息，來源分布為 "), F.coalesce("mix", F.lit(aggregates.NO_SOURCES)),
            F.lit("。 關注標的即時報價包含："), F.coalesce(F.nullif("_moves", F.lit("")), F.lit("本輪未取得報價")), F.lit("。"),
        )
    else:
        hot = aggregates.hot_sources(items, 4, BY, rank).groupBy(*BY).agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("hot_rank", "source_name")))["source_name"], "、").alias("_hot")
        )
        head = head.join(hot, BY, "left")
        summary = F.concat(
            F.lit("本輪共整理 "), n, F.lit(" 則 AI 情報，主要來源涵蓋 "), F.coalesce(F.nullif("_hot", F.lit("")), F.lit("無")),
            F.lit("。 目前為本地合成模式，重點在保留來源脈絡與後續可追蹤性。"),
        )
    header = head.select(
        *BY, F.lit(style.title).alias("title"), summary.alias("summary"), F.lit(style.outlook).alias("outlook"),
        F.lit(style.outlook_label).alias("outlook_label"), F.lit("fallback").alias("mode"),
    )
    first = rk.top_k(items, style.item_limit, [F.col(rank)], BY, "_n")
    if style.kind == "ai":
        rows = _news_rows(first, style, F.col("_n"))
    else:
        insight = F.concat(
            F.lit("來源屬於 "), "source_name", F.lit(" / "), "source_type",
            F.lit("。 目前是離線合成模式，建議將此則與最新財報、法說會或價格走勢交叉驗證。"),
        )
        rows = first.withColumns(
            {
                "summary": F.coalesce(F.nullif("desc", F.lit("")), F.lit(brief.NO_SUMMARY)),
                "insight": insight,
                "position": F.col("_n").cast("int"),
                "is_primary": F.lit(True),
            }
        )
    return header, rows.select(*ITEM_COLUMNS)


def collect_report(header: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per report with its rows as an ordered array (for sinks)."""
    fields = [c for c in ITEM_COLUMNS if c != "report_id"]
    nested = rows.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    return header.join(nested, BY, "left")


def prompt_requests(items: DataFrame, style: Style, quotes: DataFrame | None = None, rank: str = "rank") -> DataFrame:
    """One request text per report for an external model."""
    first = rk.top_k(items, style.prompt_limit, [F.col(rank)], BY, "_n")
    fields = ["title", "url", "desc", "source_name", "source_type", F.col("published_at_raw").alias("published_at"), "tags", "priority"]
    news = F.array_sort(F.collect_list(F.struct("_n", F.struct(*fields).alias("item"))))["item"]
    out = first.groupBy(*BY).agg(news.alias("news"))
    parts = [F.lit(style.task).alias("task"), F.lit("zh-TW").alias("language")]
    if style.kind == "stock" and quotes is not None:
        cols = [c for c in quotes.columns if c not in ("report_id", "seq", "market", "price_text", "change_text")]
        stocks = F.array_sort(F.collect_list(F.struct("seq", F.struct(*cols).alias("q"))))["q"]
        out = out.join(quotes.groupBy(*BY).agg(stocks.alias("stocks")), BY, "left")
        parts.append(F.col("stocks"))
    parts += [F.col("news"), F.array(*[F.lit(x) for x in style.instructions]).alias("instructions")]
    return out.select(*BY, F.to_json(F.struct(*parts)).alias("request"))


# --- landed responses -------------------------------------------------------------------------------------------


def _stripped_sql(x: str) -> str:
    return f"trim(BOTH {sql_string(text.WHITE_SPACE)} FROM coalesce({x}, ''))"


def _leaf_text_sql(v: str, default: str) -> str:
    kind, as_text = f"schema_of_variant({v})", _stripped_sql(f"try_variant_get({v}, '$', 'string')")

    def inner(key: str) -> str:
        kind_of = f"schema_of_variant(try_variant_get({v}, '$.{key}', 'variant'))"
        return f"if({kind_of} = 'STRING', nullif({_stripped_sql(f"try_variant_get({v}, '$.{key}', 'string')")}, ''), NULL)"

    return f"""CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN {sql_string(default)}
        WHEN {kind} = 'BOOLEAN' THEN initcap({as_text})
        WHEN startswith({kind}, 'OBJECT') THEN coalesce({inner('text')}, {inner('content')}, {inner('value')}, to_json({v}))
        ELSE {as_text} END"""


def _text_sql(v: str) -> str:
    """Any value as one list of leaves. Lists in lists read like one list, as joins of joins are one join: they are unpacked level by
    level, as deep as they go; what is no list is a list of one."""
    brackets = rf"""regexp_replace(regexp_replace(to_json({v}), r'"(?:[^"\\]|\\.)*"', ''), r'[^\[\]]', '')"""
    depth = (
        f"aggregate(split({brackets}, ''), named_struct('now', 0, 'most', 0), (a, c) -> named_struct('now', a.now + if(c = '[', 1, if(c = ']', -1, 0)), "
        "'most', greatest(a.most, a.now + if(c = '[', 1, 0))), a -> a.most)"
    )
    is_list = "startswith(schema_of_variant(y), 'ARRAY')"
    flat = (
        f"aggregate(sequence(1, {depth}), array({v}), (acc, i) -> flatten(transform(acc, y -> "
        f"if(y IS NOT NULL AND {is_list}, try_variant_get(y, '$', 'array<variant>'), array(y)))))"
    )
    # a leaf has no white space at its ends, nor have leaves joined by blanks
    leaves = f"if(startswith(schema_of_variant({v}), 'ARRAY'), {flat}, array({v}))"
    return f"array_join(filter(transform({leaves}, z -> {_leaf_text_sql('z', '')}), p -> p <> ''), ' ')"


def safe_text(v: Column, default: str = "") -> Column:
    """Readable text of any JSON value: text inside objects, joined lists of any depth, JSON text as last resort."""
    return F.get(safe_texts([v], default), F.lit(0))


def safe_texts(values: Sequence[Column], default: str = "") -> Column:
    """`safe_text` of many values as one array: the walk is in the plan once, however many fields are read."""
    walk = f"v -> CASE WHEN v IS NULL OR is_variant_null(v) THEN {sql_string(default)} ELSE {_text_sql('v')} END"
    return F.call_function("transform", F.array(*values), F.expr(walk))


def _json_body(response: Column) -> Column:
    body = text.strip_text(response)
    inner = F.regexp_replace(body, "^`+|`+$", "")
    at = F.instr(inner, "json")
    unmarked = F.when(at > 0, F.concat(F.substring(inner, F.lit(1), at - 1), F.substring(inner, at + 4, F.length(inner)))).otherwise(inner)
    return F.when(body.startswith("```"), text.strip_text(unmarked)).otherwise(body)


def parse_responses(responses: DataFrame, style: Style) -> tuple[DataFrame, DataFrame]:
    """Response texts to headers and rows. Responses without a usable row give nothing: use the fallback there."""
    parsed = responses.select(*BY, F.try_parse_json(_json_body(F.col("response"))).alias("_p")).filter(
        F.schema_of_variant("_p").startswith("OBJECT")
    )
    entries = F.slice(F.try_variant_get("_p", "$.items", "array<variant>"), 1, style.item_limit)

    def texts(of: str, names: Sequence[str]) -> Column:
        # behind a generator, so that filters on a text do not compute all of them again below it
        return F.explode(F.array(safe_texts([F.try_variant_get(of, f"$.{n}", "variant") for n in names]))).alias("t")

    fields = ("title", "url", "summary", "insight", "source_name", "source_type", "published_at")
    read = {name: F.col("t")[i] for i, name in enumerate(fields)}
    known = {name: F.coalesce(F.nullif(read[name], F.lit("")), F.lit("unknown")).alias(name) for name in ("source_name", "source_type")}
    rows = (
        parsed.select(*BY, F.posexplode(entries).alias("_pos", "_i"))
        .filter(F.schema_of_variant("_i").startswith("OBJECT"))
        .select(*BY, "_pos", texts("_i", fields))
        .select(
            *BY, (F.col("_pos") + 1).alias("position"), F.lit(True).alias("is_primary"), *[read[n].alias(n) for n in fields[:4]],
            *known.values(), F.nullif(read["published_at"], F.lit("")).alias("published_at_raw"),
        )
        .filter((F.col("title") != "") & urls.is_valid_source_url(F.col("url")))
        .withColumn("published_at", dates.parse_published_at(F.col("published_at_raw")))
        .select(*ITEM_COLUMNS)
    )
    said = parsed.select(*BY, texts("_p", ("summary", "outlook")))
    header = said.join(rows.select(*BY).distinct(), BY, "left_semi").select(
        *BY, F.lit(style.title).alias("title"), F.col("t")[0].alias("summary"), F.col("t")[1].alias("outlook"),
        F.lit(style.outlook_label).alias("outlook_label"), F.lit(None).cast("string").alias("mode"),
    )
    return header, rows


def responses_or_fallback(
    responses: DataFrame | None, items: DataFrame, style: Style, quotes: DataFrame | None = None,
    reports: DataFrame | None = None, rank: str = "rank",
) -> tuple[DataFrame, DataFrame]:
    """Parsed responses, and the fallback for every report without one."""
    header, rows = fallback_report(items, style, quotes, reports, rank)
    if responses is None:
        return header, rows
    # a response only counts for a report which had news
    answered = responses.join(items.select(*BY).distinct(), BY, "left_semi")
    good_header, good_rows = parse_responses(answered, style)
    known = good_header.select(*BY)
    return (
        good_header.unionByName(header.join(known, BY, "left_anti")),
        good_rows.unionByName(rows.join(known, BY, "left_anti")),
    )


# --- coverage ---------------------------------------------------------------------------------------------------


def _coverage_columns(df: DataFrame) -> DataFrame:
    c = F.col
    trusted = F.when(urls.is_valid_source_url(c("url")), c("url")).otherwise("")
    return joins.with_match_keys(df).withColumns(
        {
            "provider": score.provider_key(c("source_name"), c("title"), c("url")),
            "content_key": keys.content_dedupe_key(c("title"), trusted, c("source_name"), c("summary")),
            "trusted_key": urls.canonicalize_url(trusted),
            "shown": score.display_rank(c("source_type")),
        }
    )


def coverage_candidates(news: DataFrame, style: Style = AI, rank: str = "rank") -> DataFrame:
    """At most 3 + 2 + 4 rows per report which must be covered: per required type, official publisher, provider."""
    c = F.col
    types = rk.first_candidate(
        news.withColumn("_cls", F.when(c("source_type").isin(*lx.REQUIRED_TYPES), c("source_type"))), "_cls", BY, rank
    )
    order_of = {t: i for i, t in enumerate(lx.REQUIRED_TYPES)}
    types = types.withColumn("ask", score.lookup(c("_cls"), order_of, 9)).withColumn("reason", F.lit("type"))
    officials = rk.distinct_source_officials(news, 2, BY, rank).withColumns(
        {"ask": F.lit(10) + c("official_position"), "reason": F.lit("official")}
    )
    providers = rk.first_candidate(
        news.withColumn("_cls", score.provider_key(c("source_name"), c("title"), c("url"))), "_cls", BY, rank
    )
    provider_of = {name: i for i, (name, _) in enumerate(lx.PROVIDER_KEYS)}
    providers = providers.withColumn("ask", F.lit(20) + score.lookup(c("_cls"), provider_of, 9)).withColumn("reason", F.lit("provider"))
    columns = [*news.columns, "ask", "reason"]
    return types.select(*columns).unionByName(officials.select(*columns)).unionByName(providers.select(*columns))


def enforce_coverage(report_items: DataFrame, news: DataFrame, style: Style = AI, rank: str = "rank") -> DataFrame:
    """Put missing sources in front, keep one row per story, order for display, cut to the report's limit.

    What is missing depends on rows put in before, so the few rows of a report (its own and at most 9 candidates) are
    walked in order; reports run in parallel. An address which is not http(s) never enters a key.
    """
    report_items, news = joins.with_match_keys(report_items), joins.with_match_keys(news)
    wanted = coverage_candidates(news.join(report_items.select(*BY).distinct(), BY, "left_semi"), style, rank)
    wanted = _news_rows(wanted, style, F.col("ask")).withColumn("is_new", F.lit(True))
    have = report_items.withColumns({"is_new": F.lit(False), "reason": F.lit(""), "ask": F.col("position")})
    columns = [*ITEM_COLUMNS, *MATCH_KEYS, "is_new", "reason", "ask"]
    rows = _coverage_columns(have.select(*columns).unionByName(wanted.select(*columns)))
    slim = rows.select(
        "report_id", "is_new", "ask", "reason", "source_type", "provider", "url_key", "title_key", "content_key", "trusted_key",
        "shown", F.unix_micros("published_at").alias("ts"),
    )
    schema = T.StructType(
        [slim.schema["report_id"], slim.schema["is_new"], slim.schema["ask"], T.StructField("new_position", T.IntegerType())]
    )
    limit, providers, required = style.item_limit, tuple(n for n, _ in lx.PROVIDER_KEYS), lx.REQUIRED_TYPES

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows_ = pdf.sort_values(["is_new", "ask"]).to_dict("records")
        own = [r for r in rows_ if not r["is_new"]]

        def known(row, among) -> bool:
            return any(
                (row["url_key"] and row["url_key"] == o["url_key"]) or (row["title_key"] and row["title_key"] == o["title_key"])
                for o in among
            )

        have_types = {r["source_type"] for r in own}
        have_providers = {r["provider"] for r in own}
        asked = []
        for r in rows_:
            if not r["is_new"]:
                continue
            if r["reason"] == "type" and required[r["ask"]] in have_types:
                continue
            if r["reason"] == "official" and known(r, own):
                continue
            if r["reason"] == "provider" and (providers[r["ask"] - 20] in have_providers or known(r, own)):
                continue
            asked.append(r)
        ordered = list(own)
        for r in reversed(asked):
            if not known(r, ordered):
                ordered.insert(0, r)
        seen: set[tuple[str, str]] = set()
        kept = []
        for r in ordered:
            mine = {("content", r["content_key"])} | ({("url", r["trusted_key"])} if r["trusted_key"] else set())
            if r["content_key"] and not seen & mine:
                seen |= mine
                kept.append(r)
        kept.sort(key=lambda r: (r["shown"], float("inf") if pd.isna(r["ts"]) else -r["ts"]))
        kept = kept[:limit]
        return pd.DataFrame(
            {
                "report_id": [r["report_id"] for r in kept],
                "is_new": [r["is_new"] for r in kept],
                "ask": [r["ask"] for r in kept],
                "new_position": range(1, len(kept) + 1),
            }
        )

    placed = slim.groupBy(*BY).applyInPandas(walk, schema)
    return (
        rows.join(placed, ["report_id", "is_new", "ask"])
        .withColumn("position", F.col("new_position"))
        .select(*ITEM_COLUMNS, *MATCH_KEYS)
    )


# --- post-processing --------------------------------------------------------------------------------------------


def fill_insight(report_items: DataFrame, items: DataFrame, style: Style, seq: str = "rank") -> DataFrame:
    """Brief insight where a row has none, from the matching item, else from the row itself."""
    wanted = ["title", "url", "desc", "source_name", "source_type", "published_at_raw"]
    out = joins.match_items(report_items, items, wanted, BY, seq)

    def pick(item_col: str, own: str) -> Column:
        return F.when(F.col("matched").isNotNull(), F.col(f"matched.{item_col}")).otherwise(F.col(own))

    made = brief.brief_item(
        style.kind, pick("title", "title"), pick("url", "url"), pick("desc", "summary"), pick("source_name", "source_name"),
        pick("source_type", "source_type"), pick("published_at_raw", "published_at_raw"),
    )
    empty = F.coalesce("insight", F.lit("")) == ""
    return out.withColumn("insight", F.when(empty, made.getField("insight")).otherwise(F.col("insight"))).select(*report_items.columns)


def expand_insights(report_items: DataFrame, style: Style) -> DataFrame:
    c = F.col
    return report_items.withColumn(
        "insight", brief.with_follow_up(style.kind, c("title"), c("insight"), c("source_name"), c("source_type"))
    )


def post_process(report_items: DataFrame, news: DataFrame, style: Style, rank: str = "rank") -> DataFrame:
    """Complete the rows of reports; a report without rows stays as it is."""
    # addresses and titles do not change on the way, so their keys are made once
    report_items, news = joins.with_match_keys(report_items), joins.with_match_keys(news)
    columns = [*ITEM_COLUMNS, *MATCH_KEYS]
    if style.kind == "ai":
        rows = joins.hydrate_metadata(report_items, news, BY, rank)
        rows = enforce_coverage(rows, news, style, rank)
    else:
        rows = it.drop_invalid_urls(report_items)
        had_rows = report_items.select(*BY).distinct()
        free = it.drop_invalid_urls(joins.without_reported(news.join(had_rows, BY, "left_semi"), rows))
        more = sel.stock_backfill(rows, free, style.item_limit, BY, rank)
        rows = rows.select(*columns).unionByName(_news_rows(more, style, F.col("position")).select(*columns))
        rows = sel.renumber(rows, ["position", "url"], BY)
        rows = joins.hydrate_metadata(rows, news, BY, rank)
    return expand_insights(fill_insight(rows, news, style, rank), style).select(*ITEM_COLUMNS)
