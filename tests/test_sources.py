from datetime import datetime

from pyspark.sql import functions as F

from briefloom.operators import aggregates
from briefloom.sources import pages, payloads, quotes as qt
from briefloom.sources.html import read_pages

URL = "https://docs.example.com/log"


def nodes(spark, html, kinds):
    return read_pages(spark.createDataFrame([(1, URL, html)], "page_id bigint, url string, html string"), kinds)


def source(spark, **extra):
    row = {"url": URL, "name": "Notes", "keywords": ["ultraplan", "advisor", "agents", "notebooklm", "gpt", "realtime"]} | extra
    types = {"keywords": "array<string>", "link_prefixes": "array<string>", "link_hints": "array<struct<keyword:string,url:string>>"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types.get(k, 'string')}" for k in row))


def test_dated_sections_use_anchor_and_links(spark):
    html = """<h3 id="apr-9-2026">April 9, 2026</h3><ul><li>We've launched the advisor tool.</li></ul>
    <p><a href="/docs/managed-agents">Managed agents in public beta</a></p>"""
    out = pages.dated_sections(nodes(spark, html, ("a", "li")), source(spark)).orderBy("seq").collect()
    assert {r.url for r in out} == {URL + "#apr-9-2026", "https://docs.example.com/docs/managed-agents"}
    assert all(r.published_at_raw == "2026-04-09T00:00:00+00:00" for r in out)


def test_release_notes_version_heading_and_hint(spark):
    html = """<h2 id="v2192">2.1.92</h2><p>April 7, 2026</p><ul><li>/ultraplan now makes a default environment</li><li>Minor cleanup</li></ul>"""
    hints = [("ultraplan", "https://docs.example.com/ultraplan")]
    out = pages.docs_release_notes(nodes(spark, html, ("li", "p")), source(spark, link_hints=hints)).collect()
    assert [(r.url, r.published_at_raw) for r in out] == [("https://docs.example.com/ultraplan", "2026-04-07T00:00:00+00:00")]


def card(day, labels, text, link):
    soft = "".join(f'<div data-variant="soft">{x}</div>' for x in labels)
    return f"""<div class="grid grid-cols-[3rem_1fr] gap-x-4"><div><div data-variant="outline">{day}</div></div>
    <div><div class="flex">{soft}</div><div class="_Md _ChangelogMarkdown"><p>{text}</p><a href="{link}">More</a></div></div></div>"""


def test_cards_roll_back_the_year(spark):
    html = card("Jan 13", ["Feature", "v1/realtime"], "Added ranges for Realtime.", "/api#ip") + card("Dec 11", ["Feature"], "Released GPT-5.2.", "/m/gpt")
    now = F.lit("2026-04-12").cast("timestamp")
    out = pages.release_notes(nodes(spark, html, ("card", "li", "p")), source(spark), now).orderBy("seq").collect()
    assert [r.published_at_raw[:10] for r in out] == ["2026-01-13", "2025-12-11"]
    assert "v1/realtime" in out[0].title and out[0].url == "https://docs.example.com/api#ip"


def test_listing_dates_from_text_and_attribute(spark):
    link = '<a href="/app/n/" {}>Try notebooks with NotebookLM to keep track</a>'
    by_text = f"<div>{link.format('')}<p>Apr 08, 2026</p></div>"
    by_attr = "<div>" + link.format("data-ga4-analytics-lead-click='{\"publish_date\":\"2026-04-08|13:45\"}'") + "</div>"
    for html in (by_text, by_attr):
        out = pages.listing_anchors(nodes(spark, html, ("a",)), source(spark, link_prefixes=["/app/"])).collect()
        assert [(r.url, r.published_at_raw) for r in out] == [("https://docs.example.com/app/n/", "2026-04-08T00:00:00+00:00")]


def test_broken_markup_and_silent_elements(spark):
    html = "<p><b>one<br><p>two</p><script>no</script><!-- no --> three</div></b>&amp; four"
    assert nodes(spark, html, ("page",)).first().text == "one two three & four"


def feed(spark, body, **cols):
    row = {"payload_order": 0, "payload": body, **cols}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'bigint' if k == 'payload_order' else 'string'}" for k in row))


def test_feeds(spark):
    rss = "<rss><channel>" + "".join(
        f"<item><title>{t}</title><link>https://r.com/{i}</link><description>now rolling out</description><pubDate>Sun, 12 Apr 2026 02:30:00 GMT</pubDate></item>"
        for i, t in enumerate(["a", "", "c", "d", "e", "f"])
    ) + "</channel></rss>"
    top = payloads.subreddit_top(feed(spark, rss, subreddit="X")).orderBy("seq").collect()
    assert [r.title for r in top] == ["[Reddit r/X] a", "[Reddit r/X] c", "[Reddit r/X] d", "[Reddit r/X] e"]
    hits = payloads.subreddit_search(feed(spark, rss, subreddit="X", query="q")).orderBy("seq").collect()
    assert [r.title for r in hits] == ["[Reddit r/X] a", "[Reddit r/X] c"] and hits[0].recent_feature_signal and hits[0].keyword_match == "q"
    dim = spark.createDataFrame([("s", "Feed", ["ROLLING"])], "source_id string, name string, keywords array<string>")
    official = payloads.official_feed(feed(spark, rss, source_id="s"), dim, 2).orderBy("seq").collect()
    assert [r.title for r in official] == ["[Official] a", "[Official] c"]
    assert official[0].published_at_raw == "2026-04-12T02:30:00+00:00"


def test_releases_and_stars(spark):
    body = '[{"name":"Patch release: v5.5.3","tag_name":"v5.5.3","body":"Small patch release."},{"name":"v5","tag_name":"v5.0.0","body":"agent api"}]'
    raw = feed(spark, body, repo="o/r")
    assert payloads.repo_releases(raw).count() == 0
    assert [r.tags for r in payloads.repo_releases(raw, 2).collect()] == [["o/r"]]
    stars = [("a", "2026-04-10T00:00:00Z"), ("a", "2026-04-09T10:00:00Z"), ("a", "2026-04-01T10:00:00Z"), ("b", None), ("b", "2026-04-10T00:00:00Z")]
    out = aggregates.star_delta(spark.createDataFrame(stars, "repo string, starred_at string"), F.lit("2026-04-08").cast("timestamp"))
    assert {r.repo: r.star_delta for r in out.collect()} == {"a": 2, "b": None}


def test_quotes(spark):
    rows = [("A", datetime(2026, 4, 1, 10), 1.0, 0.5, 2.0, 1.5), ("A", datetime(2026, 4, 2, 10), 2.0, 1.5, 3.0, 2.5), ("A", datetime(2026, 4, 2, 11), 9.0, 8.0, 9.5, 3.0)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, low double, high double, close double")
    first = qt.quotes_from_bars(bars).first()
    assert (first.price, first.change, first.open, first.low) == (3.0, 1.5, 2.0, 1.5)
    assert qt.quotes_from_bars(bars, last_bar=True).first().open == 9.0
    raw = spark.createDataFrame([("1", '{"msgArray":[{"z":"-","y":"10"}]}'), ("2", '{"msgArray":[{"y":"10","l":"9.5"}]}'), ("3", "{}")], "symbol string, payload string")
    exchange = qt.quotes_from_exchange_json(raw, "x")
    assert [(r.symbol, r.price, r.low, r.high) for r in exchange.collect()] == [("2", 10.0, 9.5, 10.0)]
    both = qt.quote_fallback(exchange, qt.quotes_from_bars(bars.withColumn("symbol", F.lit("2")), "y"))
    assert [(r.symbol, r.source) for r in both.collect()] == [("2", "x")]


def test_pieces_follow_rows(spark, monkeypatch):
    """A table of one row group is read by one task: wide rows are made in pieces counted in rows, null and repeated keys too."""
    from briefloom.plans import driver_views

    monkeypatch.setattr(driver_views, "ROWS_PER_TASK", 10)
    rows = spark.range(1000).selectExpr("if(id % 50 = 0, null, id % 900) as key", "id").repartition(200)
    spread = driver_views.spread_rows(rows, "key")
    assert spread.rdd.getNumPartitions() == 100 and sorted(r.id for r in spread.collect()) == list(range(1000))


def test_texts_are_cut_where_they_are_read(spark, tmp_path):
    """What is trimmed off is in no shuffle: the rows are those of trimming afterwards, and `desc` is cut below every exchange."""
    from briefloom.operators import items as it
    from briefloom.plans import driver_views

    texts = ["t\n" + "word " * 500, "only a title", None, "\n" + "x" * 221, ""]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)] + [(None, "a\nb", None, None)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "2026-01-01 00:00:00")], "event_id bigint, ts string").write.parquet(f"{tmp_path}/events.parquet")
    early = driver_views.raw_items(spark, str(tmp_path), it.trim_descriptions)
    late = it.trim_descriptions(driver_views.raw_items(spark, str(tmp_path)))
    assert early.columns == late.columns and sorted(map(str, early.collect())) == sorted(map(str, late.collect()))
    tree = early._jdf.queryExecution().optimizedPlan().toString()
    assert "220" not in tree.split("RepartitionByExpression")[0] and "220" in tree.split("RepartitionByExpression")[1]
