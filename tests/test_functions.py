import html
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from briefloom.functions import brief, dates, keys, score, text, urls
from briefloom.operators import render
from briefloom.plans import driver_queries


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalize_text(spark):
    assert apply(spark, text.normalize_text, ["  a \n b 　c ", None, "\x1c"]) == ["a b c", "", ""]


def test_canonicalize_url(spark):
    cases = {
        "https://example.com/post/?utm_source=x&ref=y&id=1": "https://example.com/post?id=1",
        "https://example.com/release-notes/?utm_source=x#apr-9-2026": "https://example.com/release-notes#apr-9-2026",
        "HTTP://EX.com": "http://ex.com/",
        "example.com/x": "https:example.com/x",
        "title:abc": "title:abc",
        "/p/x/": "https:///p/x",
        "https://e.com/a b?q=a%20b&x=~*&é=1&blank=&nov": "https://e.com/a b?q=a+b&x=~%2A&%C3%A9=1&blank=&nov=",
        "https://e.com/%zz?a=%zz": "https://e.com/%zz?a=%25zz",
        "": "",
    }
    assert apply(spark, urls.canonicalize_url, list(cases)) == list(cases.values())


def test_resolve_url(spark):
    base = F.lit("https://h.com/a/b/c?x=1#z")
    cases = {
        "d": "https://h.com/a/b/d", "../d": "https://h.com/a/d", "/e/../f": "https://h.com/f", "#q": "https://h.com/a/b/c?x=1#q",
        "?y=2": "https://h.com/a/b/c?y=2", "//o.com/x": "https://o.com/x", "https://z.com": "https://z.com", "./d/.": "https://h.com/a/b/d/",
        "../../../d": "https://h.com/d", "": "https://h.com/a/b/c?x=1#z",
    }
    assert apply(spark, lambda v: urls.resolve_url(base, v), list(cases)) == list(cases.values())


def test_link_validity(spark):
    values = ["https://a.b/é x", "javascript:alert(1)", "N/A", " http://a.b ", "https:///x"]
    assert apply(spark, urls.normalize_link_url, values) == ["https://a.b/%C3%A9%20x", None, None, "http://a.b", None]
    assert apply(spark, urls.is_valid_source_url, values) == [True, False, False, True, False]


def test_parse_dates(spark):
    def utc(*a):
        return datetime(*a, tzinfo=timezone.utc).isoformat()

    cases = {
        "2026-04-11T12:00:00Z": utc(2026, 4, 11, 12), "2026-04-11": utc(2026, 4, 11), "2026-04-11T12:00": utc(2026, 4, 11, 12),
        "2026-04-11 12:00:00.123456789+0800": utc(2026, 4, 11, 4, 0, 0, 123456), "20260411": utc(2026, 4, 11),
        "20260411T1200Z": utc(2026, 4, 11, 12), "2026": None, "2026-04": None, "2026-4-7": utc(2026, 4, 7), "2026/4/7": utc(2026, 4, 7),
        "Apr 7, 2026": utc(2026, 4, 7), "april 07, 2026": utc(2026, 4, 7), "Sun, 12 Apr 2026 02:30:00 GMT": utc(2026, 4, 12, 2, 30),
        "12 Apr 2026 02:30 EST": utc(2026, 4, 12, 7, 30), "Sun, 12 Apr 26 02:30:00 +0530": utc(2026, 4, 11, 21), "2026-13-01": None, "x": None,
    }
    assert apply(spark, dates.normalize_datetime, list(cases)) == list(cases.values())
    assert apply(spark, dates.extract_date, ["on apr 7, 2026 or 2026-1-2", "Apr 7, 2026!", "x"]) == ["2026-1-2", "Apr 7, 2026", None]


def test_titles_and_snippets(spark):
    stamp = F.lit("2026-04-12 16:05:00").cast("timestamp")
    assert apply(spark, lambda v: dates.report_title(v, stamp), ["[AI]"]) == ["[AI] 2026-04-13 00:05"]
    snippet = 'Search match for "ultraplan" | <!-- SC_OFF --><div class="md"><p>Rolling out now</p></div>'
    assert apply(spark, text.clean_snippet, [snippet, "a &amp;lt; &#39;x&#x1F600;"]) == ["Rolling out now", "a &lt; 'x😀"]
    assert apply(spark, text.release_excerpt, ["```python\nx=1\n```\n- Small patch to fix `device_map`.", None])[0] == "Small patch to fix device_map."


def test_keys(spark):
    def key(title, url, source="", summary=""):
        df = spark.range(1).select(keys.content_dedupe_key(F.lit(title), F.lit(url), F.lit(source), F.lit(summary)).alias("k"))
        return df.first().k

    assert key("Tesla 增加資本支出", "https://t.com/a") != key("Tesla財報公佈", "https://t.com/b")
    assert key("OpenAI launches GPT-5.1 with faster reasoning", "https://x.com/a") == "release-family:openai-gpt-5.1"
    assert key("A title which is long enough to be a key", "https://x.com/a").startswith("title:")


def test_patch_noise(spark):
    rows = [("Patch release: v5.5.3", "v5.5.3", "Small patch release to fix parser bug."), ("Release v2.0.0", "v2.0.0", "New managed agent API.")]
    df = spark.createDataFrame(rows, "n string, t string, b string")
    assert [r.o for r in df.select(score.is_patch_noise(F.col("n"), F.col("t"), F.col("b")).alias("o")).collect()] == [True, False]


@pytest.mark.parametrize(
    "symbol, price, change, low, high, parts",
    [
        ("NVDA", 188.63, 5.61, 184.3, 190.0, ["現:188.63 | 變:+5.61", "區:184.30-190.00"]),
        ("0050", 80.75, 1.7, 79.9, 80.8, ["現:80.75 | 變:+1.70", "區:79.90-80.80"]),
        ("2330", 2000.0, 60.0, 1970.0, 2000.0, ["現:2000 | 變:+60", "區:1970-2000"]),
        ("2330", 2000.0, -60.5, None, None, ["變:-60.50", "區:-"]),
    ],
)
def test_quote_text(spark, symbol, price, change, low, high, parts):
    df = spark.createDataFrame([(symbol, price, change, low, high)], "s string, p double, c double, l double, h double")
    line = df.select(render.quote_text(*[F.col(x) for x in "spclh"]).alias("t")).first().t
    assert all(p in line for p in parts)


def test_briefs(spark):
    def one(kind, title, desc, name, source_type):
        b = brief.brief_item(kind, F.lit(title), F.lit("https://a.b"), F.lit(desc), F.lit(name), F.lit(source_type), F.lit(""))
        return spark.range(1).select(b.alias("b")).select("b.*").first()

    model = one("ai", "[HF Model] x/y (1 likes)", "Downloads: 1,200 | Task: any-to-any", "Hugging Face", "model_release")
    assert model.summary == "模型更新重點：x/y (1 likes)，任務類型為 any-to-any，下載量約 1,200。"
    leak = one("ai", "Claude access", "A data leak was reported", "Wire", "news")
    assert leak.insight.startswith("這類事件會直接檢驗")
    stock = one("stock", "TSMC expands", "short", "Wire", "news")
    assert stock.summary == "市場新聞焦點：TSMC expands。" and stock.insight.startswith("這類消息的重點")
    assert apply(spark, brief.needs_follow_up, ["", "一句。", "一" * 40 + "。" + "二" * 40 + "。"]) == [False, True, False]


def test_references_follow_the_html_rules(spark):
    import html
    import random

    from briefloom.functions import text as tx

    rng = random.Random(5)
    bits = ["&#9999999;", "&#xD800;", "&#38;lt;", "&eacute;", "&notit;", "&ampx", "&", "&&", "&#0;", "&#x80;", "&#128", "&#xFFFE;", "&#1;", "&#", "x", "&#99999999999999999999;", "&none;", "&#x;", "\n"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(1, 7))),) for _ in range(400)]
    for r in spark.createDataFrame(rows, "t string").select("t", tx.unescape_entities(F.col("t")).alias("u")).collect():
        assert r.u == html.unescape(r.t), r.t


def test_number_suffixes_are_no_numbers(spark):
    from briefloom.functions import text as tx

    rows = spark.createDataFrame([("1d",), ("1.5f",), ("2",), ("x",), (None,)], "v string").select(tx.safe_float(F.col("v"), -1.0).alias("n")).collect()
    assert [r.n for r in rows] == [-1.0, -1.0, 2.0, -1.0, -1.0]


def test_entity_query_reads_whole_texts(spark, tmp_path):
    texts = ["", "x" * 50 + " &amp;lt; &eacute", "&#233; " * 3000, "no reference " * 9000 + "&rarr;", "&&& &a &#; &#x;" * 20, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = driver_queries.QUERIES["entity_texts_whole"](spark, str(tmp_path)).collect()
    want = [None if t is None else html.unescape(t + driver_queries._REFERENCES) for t in texts]
    assert [r.text for r in sorted(out)] == want
