"""Short summaries and insights of items, from ordered rules. Rules are data; each list compiles to one CASE."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from briefloom.functions import score
from briefloom.functions.core import let, let_sql, sql_holds, sql_string
from briefloom.functions.text import cut, normalize_text, rstrip_text, strip_text, text_or_empty, truncate_text


@dataclass(frozen=True)
class Rule:
    """All conditions (field, terms) must hold; `=field` asks for equality instead of a substring."""

    when: tuple[tuple[str, tuple[str, ...]], ...]
    text: str


# Texts and trigger terms, in the order in which they are tried.
AI_SUMMARY_RULES = (
    Rule((("=source_type", ("github_repo",)),), "GitHub 熱門專案，聚焦 {headline}。"),
    Rule((("=source_type", ("github_release",)),), "GitHub Release 更新重點：{headline}。"),
    Rule(
        (("headline", ("mythos", "glasswing")),),
        "Anthropic 的 Claude Mythos Preview / Project Glasswing 指向高風險 AI 資安能力：模型可協助找出與修補重大漏洞，但也提高攻擊自動化外溢風險。",
    ),
    Rule(
        (("headline", ("nec", "workforce", "collaborate")), ("headline", ("anthropic",))),
        "Anthropic 與 NEC 宣布合作，重點是擴大日本企業導入 AI 工程與人才培訓能力。",
    ),
    Rule((("=source_type", ("model_release",)),), "模型更新重點：{headline}{extras}。"),
    Rule((("=source_type", ("community",)),), "社群近期討論焦點：{headline}。"),
    Rule((("=source_type", ("research",)),), "研究論文重點：{headline}。"),
    Rule((("usable", ("yes",)),), "{sentence}"),
    Rule((("=source_type", ("official_news",)),), "官方公告重點：{headline}。"),
    Rule((), "近期值得追蹤的更新：{headline}。"),
)
AI_INSIGHT_RULES = (
    Rule(
        (("headline", ("mythos", "glasswing")),),
        "這是 frontier model 能力邊界與資安治理同時升級的訊號，重點不只是新模型，而是 AI 已能在漏洞發現、利用與修補流程中接近專家級表現。"
        " 後續要追 Anthropic 的存取控管、第三方測試結果、各大軟體維護者修補進度，以及是否出現未授權使用或外洩事件。",
    ),
    Rule(
        (("body", ("unauthorized access", "breach", "data leak")), ("=provider", ("Anthropic",))),
        "這類事件會直接檢驗高能力模型的存取控管是否跟得上產品宣稱，尤其當模型本身具備資安攻防能力時，外洩風險會被放大。"
        " 接下來要看 Anthropic 是否揭露影響範圍、供應商環境問題、稽核結果與後續安全補強。",
    ),
    Rule((("headline", ("advisor",)),), "{provider} 正在把規劃與執行拆成雙模型協作，這代表長流程 Agent workflow 開始走向分層控制。"),
    Rule(
        (("headline", ("managed agent",)),),
        "{provider} 把 agent runtime 官方化，代表競爭重點已從單純模型能力延伸到可直接落地的執行基礎設施。",
    ),
    Rule(
        (("headline", ("ant cli", "claude code")),),
        "{provider} 正把 API、CLI 與工程流程串起來，這會加速 AI 能力往終端、自動化腳本與本地開發環境滲透。",
    ),
    Rule(
        (("headline", ("notebook", "notebooklm")),),
        "{provider} 正把聊天、檔案與研究流程收斂成專案容器，這有助於提升長任務的上下文延續性與知識管理效率。",
    ),
    Rule(
        (("headline", ("mythos", "cyber", "glasswing")),),
        "{provider} 開始把模型能力往高風險垂直場景做產品分層，顯示安全與專業領域模型會成為下一階段差異化重點。",
    ),
    Rule(
        (("headline", ("chatgpt",)), ("headline", ("$100",))),
        "OpenAI 正把高強度 ChatGPT / Codex 工作負載往更高價位方案分層，反映專業用戶的生產力需求已足以支撐更進一步的商業化。",
    ),
    Rule(
        (("headline", ("100 per month",)),),
        "OpenAI 正把高強度 ChatGPT / Codex 工作負載往更高價位方案分層，反映專業用戶的生產力需求已足以支撐更進一步的商業化。",
    ),
    Rule(
        (("headline", ("3d model", "simulation")),),
        "{provider} 正把回覆形式從純文字擴展到可操作的視覺化內容，產品定位會更接近能直接幫使用者完成理解與演示的工作介面。",
    ),
    Rule(
        (("=source_type", ("official_news",)),),
        "{source} 這則官方更新的核心是「{headline}」，重點在它是否改變模型能力、開發者工具或企業導入路徑。",
    ),
    Rule((("=source_type", ("news",)),), "這則媒體報導可作為 {provider} 官方動向的外部驗證，適合搭配原始公告一起判讀。"),
    Rule(
        (("=source_type", ("model_release",)),),
        "{headline} 代表近期模型供給的變化，值得和其他主流模型能力、部署成本與任務定位一起比較。",
    ),
    Rule(
        (("=source_type", ("research",)),),
        "這篇研究可視為後續技術方向訊號，適合和產品更新一起觀察，判斷哪些能力可能先進入產品化。",
    ),
    Rule(
        (("=source_type", ("community",)),),
        "這則社群討論能補足 {provider} 官方公告之外的實作體感，但仍要和一手來源交叉驗證。",
    ),
    Rule(
        (("=source_type", ("github_repo", "github_release")),),
        "這則開源動態可補充 {provider} 生態系進展，適合作為主線產品之外的延伸觀察。",
    ),
    Rule((), "這則內容來自 {source}，建議結合原文一起判斷它在本輪資訊中的重要性。"),
)
AI_FOLLOW_UP_RULES = (
    Rule(
        (("headline", ("agent", "codex", "cloudflare", "workflow", "sdk", "api")),),
        "若後續文件、SDK 與部署路徑也同步補齊，通常代表這波更新會從單點公告進一步外溢成開發者工作流的主線能力。",
    ),
    Rule(
        (("=source_type", ("official_news",)), ("headline", ("mythos", "glasswing", "cybersecurity", "zero-day", "breach"))),
        "後續可觀察模型存取政策、漏洞揭露節奏與主要合作夥伴的修補成果，這會決定它是防禦工具突破還是資安治理壓力測試。",
    ),
    Rule(
        (("=source_type", ("official_news",)),),
        "接下來可觀察 {provider} 是否同步擴充 API、定價或企業功能，這會決定它是短期宣傳還是長線產品推進。",
    ),
    Rule(
        (("=source_type", ("model_release",)),),
        "後續值得比較的是推理成本、部署門檻與任務定位，這三者通常比單次 benchmark 更能決定採用速度。",
    ),
    Rule(
        (("=source_type", ("research",)),),
        "若後續很快出現 SDK、產品功能或開源實作跟進，通常代表這條技術線正在從研究走向工程落地。",
    ),
    Rule(
        (("=source_type", ("github_repo", "github_release")),),
        "若社群很快出現外掛、整合範本或雲端部署方案，代表這個方向可能正在形成可持續的工具鏈需求。",
    ),
    Rule((), "接下來可觀察官方文件、開發者回饋與實際整合案例是否持續增加，這比單篇新聞更能判斷影響能否延續。"),
)
STOCK_SUMMARY_RULES = (
    Rule((("usable", ("yes",)),), "{sentence}"),
    Rule((("=source_type", ("official_news",)),), "公司或官方來源更新重點：{headline}。"),
    Rule((("=source_type", ("news",)),), "市場新聞焦點：{headline}。"),
    Rule((), "近期值得追蹤的投資線索：{headline}。"),
)
STOCK_INSIGHT_RULES = (
    Rule(
        (("headline", ("valuation", "估值", "funding", "募資", "raises", "hits")),),
        "這則消息通常不只反映單一公司熱度，還會影響同賽道的估值錨點與市場對成長性的預期。"
        " 接下來可觀察同業估值、後續融資條件與客戶採用速度是否同步上修。",
    ),
    Rule(
        (("headline", ("nvidia", "tsmc", "ai chips", "semiconductor", "晶片", "gpu", "risc-v")),),
        "這類消息的重點通常在供應鏈與架構路線是否開始轉向，因為那會影響上游資本支出與下游客戶綁定。"
        " 後續可再看設計贏單、量產節點與生態系夥伴是否跟進，才能判斷題材是否會轉成實際營收。",
    ),
    Rule(
        (("detail", ("guidance", "earnings", "revenue", "訂單", "需求", "產能")),),
        "這則訊號值得和公司指引、訂單能見度與庫存狀況一起看，才能分辨是一次性消息還是基本面拐點。"
        " 若後續財報或法說同步支持，市場才更可能把它重新定價到估值模型裡。",
    ),
    Rule(
        (),
        "{source} 這則更新可先視為產業熱點或情緒訊號，真正關鍵仍是它是否帶動需求、毛利或資本支出的預期修正。"
        " 後續建議搭配財報、法說會與同業走勢交叉驗證，避免只因單篇新聞就高估持續性。",
    ),
)
STOCK_FOLLOW_UP_RULES = (
    Rule(
        (("headline", ("nvidia", "tsmc", "semiconductor", "chip", "晶片", "gpu", "risc-v")),),
        "若後續供應鏈訂單、設計定案與量產時程也同步改善，這類題材才更有機會從概念熱度轉成實際獲利貢獻。",
    ),
    Rule(
        (("=source_type", ("official_news",)),),
        "後續可觀察公司是否在財報、法說或訂單指引中重申同方向訊號，這會比單次公告更能支持估值重估。",
    ),
    Rule((), "接下來建議搭配同業股價、財報與需求指標一起看，確認這則消息帶來的是短期情緒反應還是基本面變化。"),
)
NO_SUMMARY = "原始來源未提供摘要。"
_TITLE_MARK = r"(?iU)^\[(Official|HF Model|HF Paper|GitHub Release|GitHub)\]\s*"
_SENTENCE_END = ("。", ".", "!", "?")


def compile_rules(rules: Sequence[Rule], fields: Mapping[str, Column], values: Mapping[str, Column]) -> Column:
    """First rule whose conditions hold gives the text. `fields` are lower-case texts, `values` fill the braces."""

    def condition(rule: Rule) -> str:
        tests = [
            f"s.f_{field[1:]} IN ({', '.join(map(sql_string, terms))})" if field.startswith("=") else sql_holds(f"s.f_{field}", terms)
            for field, terms in rule.when
        ]
        return " AND ".join(tests) or "true"

    def fill(template: str) -> str:
        pieces = [p for p in re.split(r"(\{\w+\})", template) if p]
        return "concat(" + ", ".join(f"s.v_{p[1:-1]}" if re.fullmatch(r"\{\w+\}", p) else sql_string(p) for p in pieces) + ")"

    given = F.struct(
        *[c.alias("f_" + name) for name, c in fields.items()], *[c.alias("v_" + name) for name, c in values.items()]
    )
    arms = " ".join(f"WHEN {condition(r)} THEN {fill(r.text)}" for r in rules)
    return let_sql(given, f"s -> CASE {arms} END")


def brief_title(title: Column) -> Column:
    """Title without its collector mark, at most 110 characters."""
    return truncate_text(F.regexp_replace(normalize_text(title), _TITLE_MARK, ""), 110)


def _sentence(details: Column, n: int) -> Column:
    def close(head: Column) -> Column:
        ended = F.substring(head, -1, 1).isin(*_SENTENCE_END)
        return F.when(ended, head).otherwise(F.concat(head, F.lit("。")))

    return let(rstrip_text(cut(details, n)), close)


def _first(*cols: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _model_extras(details: Column) -> Column:
    task = F.nullif(F.regexp_extract(details, r"(?iU)Task:\s*([^|]+)", 1), F.lit(""))
    downloads = F.nullif(F.regexp_extract(details, r"(?iU)Downloads:\s*([0-9,]+)", 1), F.lit(""))
    listed = F.concat_ws(
        "，", F.concat(F.lit("任務類型為 "), F.trim(task)), F.concat(F.lit("下載量約 "), F.trim(downloads))
    )
    return F.coalesce(F.concat(F.lit("，"), F.nullif(listed, F.lit(""))), F.lit(""))


def brief_summary_ai(headline: Column, details: Column, source_type: Column) -> Column:
    lowered = F.lower(headline)
    usable = (details != "") & ~F.contains(F.lower(details), F.lit("collected from"))
    return compile_rules(
        AI_SUMMARY_RULES,
        {"headline": lowered, "source_type": source_type, "usable": F.when(usable, "yes").otherwise("no")},
        {"headline": headline, "extras": _model_extras(details), "sentence": _sentence(details, 160)},
    )


def brief_insight_ai(headline: Column, details: Column, source_name: Column, source_type: Column) -> Column:
    source = F.coalesce(_first(source_name, source_type), F.lit("來源"))
    return let(
        score.provider_label(source_name, headline),
        lambda provider: compile_rules(
            AI_INSIGHT_RULES,
            {
                "headline": F.lower(headline),
                "body": score.haystack(headline, details),
                "provider": provider,
                "source_type": source_type,
            },
            {"headline": headline, "provider": provider, "source": source},
        ),
    )


def brief_summary_stock(headline: Column, details: Column, source_type: Column) -> Column:
    return compile_rules(
        STOCK_SUMMARY_RULES,
        {"source_type": source_type, "usable": F.when(F.length(details) >= 28, "yes").otherwise("no")},
        {"headline": headline, "sentence": _sentence(details, 180)},
    )


def brief_insight_stock(headline: Column, details: Column, source_name: Column, source_type: Column) -> Column:
    return compile_rules(
        STOCK_INSIGHT_RULES,
        {"headline": F.lower(headline), "detail": F.lower(details)},
        {"source": F.coalesce(_first(source_name, source_type), F.lit("這則來源"))},
    )


def brief_item(
    kind: str, title: Column, url: Column, desc: Column, source_name: Column, source_type: Column, published_at: Column
) -> Column:
    """Struct of the seven output columns of an item or report row; `kind` is `ai` or `stock`."""
    unknown = F.lit("unknown")
    given = F.struct(
        normalize_text(title).alias("title"),
        brief_title(title).alias("headline"),
        normalize_text(desc).alias("details"),
        F.coalesce(F.nullif(normalize_text(source_name), F.lit("")), unknown).alias("source_name"),
        F.coalesce(F.nullif(normalize_text(source_type), F.lit("")), unknown).alias("source_type"),
    )

    def build(g: Column) -> Column:
        headline, details, name, kind_ = g["headline"], g["details"], g["source_name"], g["source_type"]
        if kind == "ai":
            summary = brief_summary_ai(headline, details, kind_)
            insight = brief_insight_ai(headline, details, name, kind_)
        else:
            summary = brief_summary_stock(headline, details, kind_)
            insight = brief_insight_stock(headline, details, name, kind_)
        return F.struct(
            g["title"].alias("title"), normalize_text(url).alias("url"), summary.alias("summary"), insight.alias("insight"),
            name.alias("source_name"), kind_.alias("source_type"),
            F.nullif(normalize_text(published_at), F.lit("")).alias("published_at_raw"),
        )

    return let(given, build)


def needs_follow_up(insight: Column) -> Column:
    """A non-empty insight of fewer than two sentences or 72 characters."""

    def test(v: Column) -> Column:
        sentences = F.size(F.filter(F.split(v, "[。！？!?]+"), lambda s: F.trim(s) != ""))
        return (v != "") & ((sentences < 2) | (F.length(v) < 72))

    return let(normalize_text(insight), test)


def with_follow_up(kind: str, title: Column, insight: Column, source_name: Column, source_type: Column) -> Column:
    """Insight, with a second sentence where it needs one."""
    rules = AI_FOLLOW_UP_RULES if kind == "ai" else STOCK_FOLLOW_UP_RULES
    more = compile_rules(
        rules,
        {"headline": F.lower(text_or_empty(title)), "source_type": source_type},
        {"provider": score.provider_label(text_or_empty(source_name), text_or_empty(title))},
    )
    extended = strip_text(F.concat(rstrip_text(insight), F.lit(" "), more))
    return F.when(needs_follow_up(insight), extended).otherwise(insight)
