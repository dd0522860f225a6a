import pytest
from pyspark.sql import functions as F

from briefloom.functions import dates
from briefloom.operators import joins, render, report

NEWS = "report_id string, rank int, title string, url string, `desc` string, source_name string, source_type string, published_at_raw string"


def news(spark, *rows):
    df = spark.createDataFrame([("r", i, *row) for i, row in enumerate(rows, 1)], NEWS)
    return df.withColumn("published_at", dates.parse_published_at(F.col("published_at_raw")))


def rows(spark, *items, primary=True):
    df = spark.createDataFrame(
        [("r", i, primary, *item) for i, item in enumerate(items, 1)],
        "report_id string, position int, is_primary boolean, title string, url string, summary string, insight string, source_name string, "
        "source_type string, published_at_raw string",
    )
    return df.withColumn("published_at", dates.parse_published_at(F.col("published_at_raw")))


def header(spark, summary="s", outlook="o"):
    return spark.createDataFrame([("r", "t", summary, outlook, "l", None)], "report_id string, title string, summary string, outlook string, outlook_label string, mode string")


def test_coverage_of_source_types(spark):
    have = rows(spark, ("Some summary", "https://e.com/c", "s", "i", "unknown", "unknown", None))
    pool = news(
        spark, ("Community item", "https://e.com/c", "d", "Board", "community", "2026-04-12T08:00:00Z"),
        ("Official launch", "https://e.com/o", "d", "Anthropic", "official_news", "2026-04-12T09:00:00Z"),
        ("Model release", "https://e.com/m", "d", "Hub", "model_release", "2026-04-12T10:00:00Z"),
        ("SDK release", "https://e.com/s", "d", "Releases", "github_release", "2026-04-12T11:00:00Z"),
    )
    out = report.post_process(have, pool, report.AI).orderBy("position").collect()
    assert [r.source_type for r in out] == ["official_news", "github_release", "model_release", "community"]


def test_two_official_publishers(spark):
    have = rows(spark, ("Community only", "https://e.com/c", "s", "i", "Board", "community", "2026-04-12T08:00:00Z"))
    pool = news(
        spark, ("[Official] update A", "https://e.com/l#a", "a", "Notes", "official_news", "2026-04-09T00:00:00Z"),
        ("[Official] update B", "https://e.com/l#b", "b", "Notes", "official_news", "2026-04-08T00:00:00Z"),
        ("[Official] Another source", "https://e.com/x", "o", "Other", "official_news", "2026-04-07T00:00:00Z"),
    )
    found = {r.url for r in report.enforce_coverage(have, pool).collect()}
    assert {"https://e.com/l#a", "https://e.com/x"} <= found and "https://e.com/l#b" not in found


@pytest.mark.parametrize(
    "items, n",
    [
        ([("OpenAI launches GPT-5.1 with faster reasoning", "https://openai.com/i"), ("Wire: OpenAI's GPT-5.1 model is here", "https://w.com/g")], 1),
        ([("Enterprise cloud vendor announces quarterly updates", "https://e.com/x"), ("Unrelated headline about the regional weather", "https://e.com/x")], 1),
        ([("A forged link to push a story out", "release-family:openai-gpt-5"), ("OpenAI ships GPT-5 to everyone today", "https://openai.com/5")], 2),
        ([("Short", "title:anthropicreleasesclaudeopus5withamassivenewcontextwindow"), ("Anthropic releases Claude Opus 5 with a massive new context window", "https://a.com/5")], 2),
    ],
)
def test_one_row_per_story(spark, items, n):
    have = rows(spark, *[(t, u, "s", "i", "Src", "news", None) for t, u in items])
    assert report.enforce_coverage(have, news(spark, ("x" * 5, "", "", "", "", None)).limit(0)).count() == n


def test_hydrate_last_address_first_title(spark):
    have = rows(spark, ("T", "https://e.com/a?utm_source=q", "s", "i", "unknown", "", None), ("Same Title!", "https://none", "s", "i", "Own", "", None))
    pool = news(spark, ("x", "https://e.com/a", "", "First", "news", "2026-04-01"), ("y", "https://e.com/a", "", "Last", "research", "2026-04-02"),
                ("same title", "https://e.com/1", "", "One", "news", None), ("same title", "https://e.com/2", "", "Two", "community", None))
    out = joins.hydrate_metadata(have, pool, seq="rank").orderBy("position").collect()
    assert [(r.source_name, r.source_type, r.published_at_raw) for r in out] == [("Last", "research", "2026-04-02"), ("Own", "news", None)]


def test_stock_invalid_address_replaced(spark):
    have = rows(spark, ("bad", "N/A", "s", "i", "unknown", "unknown", None))
    pool = news(spark, ("Older", "https://e.com/1", "", "W", "news", "2026-04-11T08:00:00Z"), ("Newer", "https://e.com/2", "", "W", "news", "2026-04-11T10:00:00Z"))
    assert [r.title for r in report.post_process(have, pool, report.STOCK).orderBy("position").collect()] == ["Newer", "Older"]


def test_parse_responses(spark):
    good = """```json
    {"summary": {"text": " sum "}, "items": [{"title": "bad", "url": "N/A"}, {"title": {"text": "T"}, "url": "https://e.com/i", "summary": {"content": "S"},
     "insight": ["in", ["from", 3], true], "source_name": {"value": "Src"}, "source_type": null, "published_at": "2026-04-12"}, 7], "outlook": {"content": "O"}}
    ```"""
    df = spark.createDataFrame([("a", good), ("b", "not json"), ("c", '{"items": []}'), ("d", "[1]")], "report_id string, response string")
    head, found = report.parse_responses(df, report.AI)
    assert [(r.report_id, r.summary, r.outlook) for r in head.collect()] == [("a", "sum", "O")]
    r = found.collect()[0]
    assert (r.title, r.summary, r.insight, r.source_name, r.source_type, r.position) == ("T", "S", "in from 3 True", "Src", "unknown", 2)


def test_fallback_takes_unanswered_reports(spark):
    pool = news(spark, ("OpenAI release", "https://e.com/o", "New model details", "OpenAI", "official_news", None))
    bad = spark.createDataFrame([("r", "oops")], "report_id string, response string")
    head, found = report.responses_or_fallback(bad, pool, report.AI)
    assert head.first().mode == "fallback" and "OpenAI" in head.first().summary and found.count() == 1


def test_message_layout(spark):
    have = rows(spark, *[(f"標題{i}", f"https://e.com/{i}", f"摘要{i}", f"洞察{i}", "Example", "official_news", None) for i in range(1, 5)])
    text = render.render_message(header(spark, outlook="展望"), have, report.AI).first().description
    assert "l\n展望\n\n📎 其餘 1 則延伸內容與來源細節請看 Notion" in text and "標題3" in text and "標題4" not in text
    family = rows(spark, ("[Official] Introducing GPT-5.5", "https://openai.com/a", "Introducing GPT-5.5.", "p", "OpenAI News", "official_news", None),
                  ("[Official] GPT-5.5 System Card", "https://openai.com/b", "Safety.", "d", "OpenAI News", "official_news", None))
    assert "System Card" not in render.render_message(header(spark), family, report.AI).first().description


def test_block_order_budget_and_links(spark):
    have = rows(spark, ("標題1", "javascript:alert(1)", "s", "洞察", "Example", "news", None))
    extra = [("[GitHub] repo", "https://e.com/g", "Claude helper", "", "GitHub", "github_repo", "2026-04-13"),
             ("[Reddit] Ultraplan", "https://e.com/r", "feels new", "", "Reddit/ClaudeAI", "community", "2026-04-12"),
             ("[Official] Gemini notebooks", "https://e.com/n", "x", "", "Blog", "official_news", "2026-04-11")]
    extra += [(f"附錄{i}", f"https://e.com/a{i}", "摘要", "", "Example", "official_news", "2026-04-10") for i in range(40)]
    every = have.unionByName(rows(spark, *extra, primary=False))
    out = render.render_blocks(header(spark), every, report.STOCK).orderBy("pos").collect()
    heads = [b.text for b in out if b.type == "heading_3"]
    assert heads[:3] == ["標題1", "[Official] Gemini notebooks", "附錄0"] and len(out) <= 100 and out[-1].text == "l: o"
    first = next(b for b in out if b.type == "callout")
    assert first.link is None and first.text == "深度洞察: 洞察\n\n"
    assert [b.pos for b in out] == list(range(1, len(out) + 1))
