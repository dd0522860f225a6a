"""The whole pipeline (D9): raw tables to reports, messages, blocks, history and metrics, for many runs in one job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from briefloom import lexicon as lx
from briefloom.functions import dates
from briefloom.operators import aggregates, dedup, history as hist, items as it, joins, rank as rk, render, report
from briefloom.operators import select as sel
from briefloom.session import durable

RUN = ["run_id"]


@dataclass(frozen=True)
class Config:
    """Limits and term lists. The numbers are fixed values of the published behaviour."""

    max_desc: int = 220
    stock_ranked: int = 48
    ai_ranked: int = 60
    stock_fresh: int = 12
    ai_fresh: int = 30
    ai_selected: int = 24
    stock_days: int = 7
    ai_days: int = 7
    archive_days: int = 30
    history_ttl_hours: float = 26
    history_cap: int = 2000
    not_selected_sample: int = 12
    exact_dedup: bool = False
    stock_lexicon: lx.Lexicon = field(default=lx.STOCK)
    ai_lexicon: lx.Lexicon = field(default=lx.AI)


def _as_report(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("report_id", F.concat("run_id", F.lit(f":{kind}")))


def _fresh(ranked: DataFrame, recent: DataFrame, history: DataFrame | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """Unseen recent rows and the skip counts; without history just the best rows."""
    if history is None:
        return rk.top_k(recent, limit, [F.col("rank")], RUN, "fresh_position"), ranked.select(*RUN).distinct().withColumn(
            "skipped", F.lit(0).cast("bigint")
        )
    fresh, met = hist.filter_new(recent, history, limit, ["category", *RUN])
    fresh = hist.all_seen_fallback(fresh, recent, limit, ["category", *RUN])
    return fresh, met.select(*RUN, "skipped")


def build_reports(
    raw_items: DataFrame,
    quotes: DataFrame | None,
    now: Column,
    config: Config = Config(),
    *,
    history: DataFrame | None = None,
    responses: DataFrame | None = None,
    links: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All output tables of the given runs.

    raw_items: run_id, category (`stock_news` or `ai_news`), raw item columns. quotes: run_id, market, seq, quote
    columns. history: HISTORY shared by all runs, or None for no cross-run de-dup. responses: report_id, response.
    links: report_id, link. Tables: report, report_item, message, block, fresh, skipped, history, metrics; prompt (the request texts
    for an external model), not_selected (the best recent rows which were not chosen), document (the titles of the block documents).
    """
    raw = it.with_optional_columns(raw_items)
    trimmed = it.trim_descriptions(raw, config.max_desc)
    runs = raw.select(*RUN).distinct()
    out: dict[str, list[DataFrame]] = {k: [] for k in ("report", "report_item", "message", "block", "fresh", "skipped", "prompt", "not_selected", "document")}
    seen: list[DataFrame] = []
    metrics = None
    for kind, category in (("stock", "stock_news"), ("ai", "ai_news")):
        ai = kind == "ai"
        style = report.AI if ai else report.STOCK
        lexicon = config.ai_lexicon if ai else config.stock_lexicon
        source = trimmed.filter(F.col("category") == category)
        ranked = dedup.deduplicate_and_rank(
            source, lexicon, config.ai_ranked if ai else config.stock_ranked,
            default_source_name="unknown" if ai else "news", default_source_type="news", exact=config.exact_dedup,
            relevant_only=ai, by=RUN,
        ).withColumn("fingerprint", hist.fingerprint_of_item())
        # from here on a run is a few dozen rows; cut the lineage so the raw tables are read once
        ranked = durable(ranked)
        # recency looks at the ranked rows only: an old row may use up a place
        recent = it.keep_recent(ranked, config.ai_days if ai else config.stock_days, now, require_date=True)
        known = None
        if history is not None:
            active = hist.active_history(
                history.filter(F.col("category") == category), now, config.history_ttl_hours, config.history_cap
            )
            known = active.select("category", "fingerprint")
        fresh, skipped = _fresh(ranked, recent, known, config.ai_fresh if ai else config.stock_fresh)
        # every fresh row counts as seen, also those which are not selected below
        seen.append(fresh.select(*RUN, "category", "rank", "seq", "fingerprint"))
        pool = recent
        if ai:
            fresh = sel.select_with_quotas(fresh, config.ai_selected, by=RUN).withColumn("rank", F.col("selected_position"))
            archive = it.high_impact_archive(ranked, now, config.archive_days, lexicon)
            pool = dedup.merge_unique_items(recent, archive, order=("rank",), by=RUN)
            # archive rows follow the recent ones
            pool = pool.withColumn("rank", F.col("merge_order._part") * config.ai_ranked + F.col("rank"))
            # of the raw rows only what the relevance rule looks at is normalised
            judged = it.normalize_items(source).select(*RUN, it.is_relevant(lexicon).alias("_relevant"))
            metrics = aggregates.run_metrics(
                judged, ranked, fresh, relevant=F.col("_relevant"), recent=it.is_recent(config.ai_days, now, require_date=True),
                archive=it.is_high_impact(now, config.archive_days, lexicon),
            )
        fresh = durable(joins.with_match_keys(fresh))
        news = _as_report(fresh, kind)
        heads = _as_report(runs, kind)
        own_quotes = None if quotes is None or ai else _as_report(quotes, kind)
        header, rows = report.responses_or_fallback(responses, news, style, own_quotes, heads)
        rows = durable(report.post_process(rows, news, style))
        extra = joins.appendix(_as_report(pool, kind), rows)
        extra = report.brief_rows(extra.withColumn("position", F.col("rank").cast("int")), style)
        every = rows.unionByName(extra.select(*report.ITEM_COLUMNS))
        out["report"].append(header)
        out["report_item"].append(every)
        out["message"].append(render.render_message(header, rows, style, own_quotes, links))
        out["block"].append(render.render_blocks(header, every, style))
        out["fresh"].append(fresh.select(*RUN, "category", "rank", "seq", "title", "url", "source_name", "source_type", "fingerprint"))
        prompts = news if "tags" in news.columns else it.with_tags(news, lexicon.priority)
        out["prompt"].append(report.prompt_requests(prompts, style, own_quotes))
        missed = sel.not_selected(recent, fresh, config.not_selected_sample, RUN)
        out["not_selected"].append(missed.select(*RUN, F.lit(category).alias("category"), "sample_position", "title", "url"))
        out["document"].append(heads.select("report_id", dates.report_title(style.prefix, now).alias("title")))
        out["skipped"].append(skipped.select(*RUN, F.lit(category).alias("category"), "skipped"))
    tables = {}
    for name, parts in out.items():
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        tables[name] = table
    tables["metrics"] = metrics
    if history is not None:
        tables["history"] = hist.remember(history, seen[0].unionByName(seen[1]), now, config.history_cap, config.history_ttl_hours)
    return tables
