"""Bundles with broken files, feed forms, pages which did not land, link runs, quotes as they were read."""

from datetime import datetime

from briefloom.functions import text
from briefloom.operators import items as it, render, report
from briefloom.sources import html, pages, payloads
from briefloom.sources.tables import read_bundle, read_bundles
from pyspark.sql import functions as F


def test_bundles_of_any_shape(spark, tmp_path):
    good = """{"us_stocks": [{"symbol": "ZZT", "price": 41.50, "change": "-0.750", "range": "40-43"}, {"symbol": "BIG", "price": 12345678.5, "change": 2},
      {"symbol": "NIL", "price": null, "change": "flat"}],
      "ai_news": [{"title": "t1", "tags": ["x", null, 3], "metadata": {"keyword_match": "ultraplan", "recent_feature_signal": true, "own": {"a": [1]}}},
      {"title": "t2", "tags": "no list", "metadata": [1]}, {"title": "t3"}]}"""
    (tmp_path / "good.json").write_text(good)
    (tmp_path / "broken.json").write_text('{"ai_news": [{"title": "lost"')
    (tmp_path / "empty.json").write_text("{}")
    found = read_bundles(spark, str(tmp_path / "*.json"))
    rows = {r.title: r for r in found.items.withColumn("own", F.try_variant_get("metadata", "$.own.a", "string")).collect()}
    assert rows["t1"].tags == ["x", "3"] and rows["t1"].keyword_match == "ultraplan" and rows["t1"].recent_feature_signal and rows["t1"].own == "[1]"
    assert (rows["t2"].tags, rows["t2"].keyword_match, rows["t3"].tags, rows["t3"].metadata) == (None, None, None, None) and len(rows) == 3
    assert [(r.run_id.rsplit("/", 1)[1], "lost" in r.text) for r in found.rejects.collect()] == [("broken.json", True)]
    quotes = {r.symbol: r for r in found.quotes.collect()}
    assert (quotes["ZZT"].price, quotes["ZZT"].change, quotes["ZZT"].price_text, quotes["ZZT"].change_text, quotes["ZZT"].high) == (41.5, -0.75, "41.5", "-0.750", 43.0)
    assert (quotes["BIG"].price_text, quotes["BIG"].change_text, quotes["BIG"].change) == ("12345678.5", "2", 2.0)
    assert (quotes["NIL"].price, quotes["NIL"].price_text, quotes["NIL"].change, quotes["NIL"].change_text) == (None, "None", None, "flat")
    # what the bundle says of a community item decides whether it may be shown
    items, _ = read_bundle(spark, str(tmp_path / "*.json"))
    normal = it.normalize_items(items.withColumn("source_type", F.lit("community")))
    assert {r.title for r in normal.filter(it.is_appendix_eligible()).collect()} == {"t1"}
    tagged = {r.title: r.tags for r in it.with_tags(normal, ("t2",)).collect()}
    assert tagged == {"t1": ["x", "3"], "t2": ["t2"], "t3": []}


def test_header_shows_quotes_as_they_were_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"us_stocks": [{"symbol": "ZZT", "price": 41.50, "change": "-0.750"}, {"symbol": "NIL", "price": null, "change": null}]}')
    _, quotes = read_bundle(spark, str(tmp_path / "a.json"))
    one = spark.createDataFrame([("r",)], "report_id string")
    news = spark.createDataFrame([], "report_id string, rank int, title string, url string, `desc` string, source_name string, source_type string, published_at_raw string, published_at timestamp")
    head, _ = report.fallback_report(news, report.STOCK, quotes.withColumn("report_id", F.lit("r")), one)
    assert "ZZT 41.5 (-0.750); NIL None (None)。" in head.first().summary
    made = spark.createDataFrame([("r", 1, "A", 1e7, 0.125)], "report_id string, seq int, symbol string, price double, change double")
    head, _ = report.fallback_report(news, report.STOCK, made, one)
    assert "A 10000000.0 (+0.1" in head.first().summary


def test_numbers_as_text(spark):
    values = [0.0, 41.5, 1e7, 12345678.9, 1e15, 0.0005, 1e-5, -2.5e8, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.t for r in df.select(text.number_text(F.col("x")).alias("t")).collect()]
    assert got[:6] == [repr(v) for v in values[:6]] and got[7:] == [repr(-2.5e8), None]


ITEM = "<item><title>{0}</title><link>https://f.example.com/{0}</link>{1}</item>"


def feed(spark, body, **cols):
    row = {"payload_order": 0, "payload": body, **cols}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'bigint' if k == 'payload_order' else 'string'}" for k in row))


def test_feeds_with_other_names_for_things(spark):
    rdf = (
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/">'
        "<channel><title>c</title></channel>"
        + ITEM.format("a", "<dc:date>2026-04-12T02:30:00Z</dc:date><content:encoded>&lt;p&gt;whole text&lt;/p&gt;</content:encoded>")
        + ITEM.format("b", "<description>short</description><content:encoded>long</content:encoded>") + "</rdf:RDF>"
    )
    rss = "<rss><channel>" + ITEM.format("c", "<pubDate>Sun, 12 Apr 2026 02:30:00 GMT</pubDate>") + "</channel></rss>"
    got = {r.title: r for body in (rdf, rss) for r in payloads.feed_entries(feed(spark, body)).collect()}
    assert (got["a"].summary, got["a"].published) == ("<p>whole text</p>", "2026-04-12T02:30:00Z")
    assert got["b"].summary == "short" and got["c"].published.startswith("Sun")


def test_a_page_which_did_not_land_is_replaced_by_its_feed(spark):
    here, gone = "https://a.example.com/news", "https://b.example.com/news"
    web = spark.createDataFrame([(1, here, '<div><a href="/news/1">A long headline about agents</a><p>Apr 08, 2026</p></div>')], "page_id bigint, url string, html string")
    sources = spark.createDataFrame(
        [(here, "A", ["agents"], ["/news/"], "https://a.example.com/feed", None), (gone, "B", ["agents"], ["/news/"], "https://b.example.com/feed", "B Feed"),
         ("https://c.example.com/", "C", ["agents"], ["/news/"], None, None)],
        "url string, name string, keywords array<string>, link_prefixes array<string>, fallback_feed_url string, fallback_feed_source_name string",
    )
    body = "<rss><channel>" + ITEM.format("agents", "") + ITEM.format("other", "") + "</channel></rss>"
    feeds = feed(spark, body, source_id="https://a.example.com/feed").unionByName(feed(spark, body, source_id="https://b.example.com/feed"))
    out = pages.listings_or_feeds(html.read_pages(web, ("a",)), sources, feeds, landed=web).collect()
    assert sorted((r.source_name, r.title) for r in out) == [("A", "[Official] A long headline about agents"), ("B Feed", "[Official] agents")]
    assert sorted((r.source_name) for r in pages.listings_or_feeds(html.read_pages(web.limit(0), ("a",)), sources, feeds).collect()) == ["A", "B Feed"]


def test_link_runs_of_blocks(spark):
    rows = spark.createDataFrame(
        [("r", 1, True, "t", "https://e.com/1", "s", "why", "S", "news", None, datetime(2026, 4, 1)), ("r", 2, True, "u", "https://e.com/2", "", "", "S", "news", None, None),
         ("r", 3, True, "v", "javascript:x", "", "", "S", "news", None, None)],
        "report_id string, position int, is_primary boolean, title string, url string, summary string, insight string, source_name string, source_type string, published_at_raw string, published_at timestamp",
    )
    head = spark.createDataFrame([("r", "t", "s", "", "l", None)], "report_id string, title string, summary string, outlook string, outlook_label string, mode string")
    out = render.render_blocks(head, rows, report.AI).orderBy("pos").collect()
    calls = [[(x.text, x.link, x.bold, x.italic, x.color) for x in b.runs] for b in out if b.type == "callout"]
    link = lambda n: ("🔗 查看原文", f"https://e.com/{n}", True, True, "blue")
    assert calls == [[("深度洞察: why\n\n", None, False, False, None), link(1)], [link(2)]]
    assert [b.runs for b in out if b.type == "divider"] == [[]]
