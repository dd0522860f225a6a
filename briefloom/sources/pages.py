"""Rules over page nodes: listings, dated sections, release notes, change-log cards, curated pages.

`sources` names the pages: url, name, keywords and, where a rule uses them, link_prefixes, limit, title_prefix and
link_hints (array of keyword, url). One row per page address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from briefloom.functions import dates, text, urls
from briefloom.functions.text import cut
from briefloom.operators.dedup import first_per_key
from briefloom.operators.order import sequence
from briefloom.sources.payloads import _raw, official_feed

PAGE = ["page_id"]
_DEFAULT_LIMIT = 4


def html_published_at(near: Column) -> Column:
    """First readable date among the attributes, time elements and texts of a node and its next three ancestors."""
    candidates = F.flatten(
        F.transform(near, lambda n: F.concat(n["attrs"], F.array_compact(F.array(n["time_at"], n["time_text"], n["text_date"]))))
    )

    def read(c: Column) -> Column:
        published = F.regexp_extract(c, r'"publish_date"\s*:\s*"([^"]+)"', 1)
        value = F.when(published != "", F.substring_index(published, "|", 1)).otherwise(c)
        return F.coalesce(dates.normalize_datetime(value), dates.normalize_datetime(dates.extract_date(value)))

    return F.get(F.filter(F.transform(candidates, read), lambda d: d.isNotNull()), F.lit(0))


def _with_source(nodes: DataFrame, sources: DataFrame, kinds: list[str]) -> DataFrame:
    optional = {
        "link_prefixes": "array<string>", "limit": "int", "title_prefix": "string",
        "link_hints": "array<struct<keyword: string, url: string>>",
    }
    for name, kind in optional.items():
        if name not in sources.columns:
            sources = sources.withColumn(name, F.lit(None).cast(kind))
    return nodes.filter(F.col("kind").isin(*kinds)).join(
        sources.select("url", "name", "keywords", *optional), "url"
    )


def listing_links(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Links of listing pages which lead to a source's articles: known prefix, telling text, first per address."""
    rows = _with_source(nodes, sources, ["a"])
    href = text.strip_text(F.col("href"))
    rows = rows.filter(
        F.exists("link_prefixes", lambda p: F.contains(href, p))
        & (F.length("text") >= 16)
        & text.matches_keywords(F.col("text"), F.lit(""), F.col("keywords"))
    ).withColumn("link", urls.resolve_url(F.col("url"), F.col("href")))
    return first_per_key(rows, "link", "node_pos", PAGE)


def _newest(rows: DataFrame, limit: int) -> DataFrame:
    """Newest rows of each page up to its own limit, in page order on ties."""
    bound = F.coalesce("limit", F.lit(limit))
    ranked = Window.partitionBy(*PAGE).orderBy(F.col("published").desc(), F.col("first"))
    return rows.withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") <= bound)


def _official(rows: DataFrame, place: Column, title: Column, link: Column, desc: Column) -> DataFrame:
    return _raw(
        rows, ["page_id"], seq=sequence(F.col("page_id"), place), title=F.concat(F.lit("[Official] "), title), url=link, desc=desc, source_name=F.col("name"),
        source_type="official_news", published_at_raw=F.col("published"),
    )


def listing_anchors(nodes: DataFrame, sources: DataFrame, limit: int = _DEFAULT_LIMIT) -> DataFrame:
    """Dated links of listing pages, newest first. An address is settled by its first link, dated or not."""
    rows = listing_links(nodes, sources).withColumn("published", html_published_at(F.col("near")))
    rows = _newest(rows.filter(F.col("published").isNotNull()).withColumn("first", F.col("node_pos")), limit)
    desc = F.concat(F.lit("Collected from "), "name", F.lit(" listing page."))
    return _official(rows, F.col("_n"), F.col("text"), F.col("link"), desc)


def listings_or_feeds(
    nodes: DataFrame, sources: DataFrame, feeds: DataFrame, limit: int = _DEFAULT_LIMIT, landed: DataFrame | None = None
) -> DataFrame:
    """Links of listing pages, and entries of the fallback feed for sources whose page did not land.

    `sources` may also have fallback_feed_url, fallback_feed_source_name and fallback_feed_keywords; name and keywords stand in for the
    last two. `feeds`: landed feed payloads by `source_id`, the address of the feed. `landed`: the addresses of landed pages (`url`);
    without it they are those with nodes. A page without any link has landed all the same, so name the pages where that may be.
    """
    rows = listing_anchors(nodes, sources, limit)
    found = (nodes if landed is None else landed).select("url").distinct()
    optional = {"fallback_feed_source_name": "string", "fallback_feed_keywords": "array<string>"}
    for name, kind in optional.items():
        if name not in sources.columns:
            sources = sources.withColumn(name, F.lit(None).cast(kind))
    absent = sources.join(found, "url", "left_anti").filter(F.coalesce("fallback_feed_url", F.lit("")) != "").select(
        F.col("fallback_feed_url").alias("source_id"), F.coalesce("fallback_feed_source_name", "name").alias("name"),
        F.coalesce("fallback_feed_keywords", "keywords").alias("keywords"),
    )
    return rows.unionByName(official_feed(feeds, absent, limit), allowMissingColumns=True)


def _longest(rows: DataFrame) -> DataFrame:
    """Longest description per page and address, earliest on ties; `first` is where the address first came up."""
    place = F.struct("pass", "node_pos")
    best = F.struct(F.length("desc").alias("n"), (-F.col("pass")).alias("p"), (-F.col("node_pos")).alias("q"))
    return (
        rows.groupBy("page_id", "link")
        .agg(F.max_by(F.struct(*rows.columns), best).alias("_row"), F.min(place).alias("first"))
        .select("_row.*", "first")
    )


def _section_link() -> Column:
    anchor = F.col("heading.id")
    return F.when(F.coalesce(anchor, F.lit("")) != "", F.concat("url", F.lit("#"), anchor)).otherwise(F.col("url"))


_SECTION = ["page_id", "name", "limit", "link", "title", "desc", "published", "pass", "node_pos"]


def _titled(prefix: Column, heading: Column) -> Column:
    return F.concat(prefix, F.lit(" "), heading, F.lit(": "), cut(F.col("text"), 96))


def dated_sections(nodes: DataFrame, sources: DataFrame, limit: int = _DEFAULT_LIMIT) -> DataFrame:
    """Bullets under dated headings, then telling links with a date nearby; longest text per address."""
    bullet = F.col("kind") == "li"
    # one pass over the nodes for both kinds of row
    rows = _with_source(nodes, sources, ["li", "a"]).filter(
        (F.col("text") != "")
        & (bullet | (F.length("text") >= 24))
        & text.matches_keywords(F.col("text"), F.lit(""), F.col("keywords"))
    )
    heading = F.when(bullet, F.col("heading.text")).otherwise(F.coalesce("previous_heading", F.lit("Update")))
    rows = rows.withColumn("shown_heading", heading)
    nearby = F.coalesce(
        html_published_at(F.col("near")), dates.normalize_datetime(F.get(F.col("near"), F.lit(1))["text_date"])
    )
    rows = rows.withColumn(
        "published", F.coalesce(dates.normalize_datetime(F.col("shown_heading")), F.when(~bullet, nearby))
    ).filter(F.col("published").isNotNull())
    rows = rows.withColumns(
        {
            "link": F.when(F.col("href").isNotNull(), urls.resolve_url(F.col("url"), F.col("href"))).otherwise(_section_link()),
            "title": _titled(F.coalesce("title_prefix", "name"), F.col("shown_heading")),
            "desc": cut(F.when(bullet, F.col("text")).otherwise(F.coalesce(F.nullif("parent_text", F.lit("")), "text")), 220),
            "pass": F.when(bullet, 1).otherwise(2),
        }
    )
    rows = _newest(_longest(rows.select(*_SECTION)), limit)
    return _official(rows, F.col("_n"), F.col("title"), F.col("link"), F.col("desc"))


def docs_release_notes(nodes: DataFrame, sources: DataFrame, limit: int = _DEFAULT_LIMIT) -> DataFrame:
    """Bullets, then paragraphs, under headings whose own text or next siblings give a date."""
    rows = _with_source(nodes, sources, ["li", "p"])
    candidates = F.concat(F.array("heading.text"), F.col("heading.dates"))
    published = F.get(
        F.filter(F.transform(candidates, dates.normalize_datetime), lambda d: d.isNotNull()), F.lit(0)
    )
    bullet = F.col("kind") == "li"
    bullet_link = F.when(F.col("href").isNotNull(), urls.resolve_url(F.col("url"), F.col("href"))).otherwise(
        urls.infer_docs_link(F.col("text"), F.col("url"), F.coalesce("link_hints", F.array().cast("array<struct<keyword: string, url: string>>")))
    )
    rows = (
        rows.filter((F.col("text") != "") & text.matches_keywords(F.col("text"), F.col("heading.text"), F.col("keywords")))
        .withColumn("published", published)
        .filter(F.col("published").isNotNull())
        .withColumns(
            {
                "link": F.when(bullet, bullet_link).otherwise(_section_link()),
                "title": _titled(F.col("name"), F.col("heading.text")),
                "desc": cut(F.col("text"), 220),
                "pass": F.when(bullet, 1).otherwise(2),
            }
        )
    )
    rows = _newest(_longest(rows.select(*_SECTION)), limit)
    return _official(rows, F.col("_n"), F.col("title"), F.col("link"), F.col("desc"))


def with_year(rows: DataFrame, month: str, now: Column, by: list[str], order: str) -> DataFrame:
    """Add `year` to month-and-day dates listed newest first: a year back at the top if the month is well ahead of
    now, and at each month later than the one before it."""
    listed = Window.partitionBy(*by).orderBy(order)
    m = F.col(month)
    before = F.lag(m).over(listed)
    back = F.when(F.coalesce(m > before, m > F.month(now) + 1), 1).otherwise(0)
    down = listed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("_back", back)
    return marked.withColumn("year", (F.year(now) - F.sum("_back").over(down)).cast("int")).drop("_back")


def changelog_cards(nodes: DataFrame, sources: DataFrame, now: Column, limit: int = _DEFAULT_LIMIT) -> DataFrame:
    """Cards dated by month and day, newest first on the page."""
    rows = _with_source(nodes, sources, ["card"])
    badge = text.strip_text(F.col("badge"))
    pattern = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+(\d{1,2})$"
    names = "janfebmaraprmayjunjulaugsepoctnovdec"
    rows = rows.filter(badge.rlike(pattern)).withColumns(
        {
            "month": ((F.instr(F.lit(names), F.lower(F.substring(badge, 1, 3))) + 2) / 3).cast("int"),
            "day": F.regexp_extract(badge, pattern, 2).cast("int"),
        }
    )
    rows = with_year(rows, "month", now, PAGE, "node_pos")
    day = F.try_make_timestamp("year", "month", "day", F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit("UTC"))
    everything = F.concat_ws(" ", F.array_join("tags", " "), "text")
    rows = (
        rows.withColumns(
            {
                "published": dates.iso_text(day),
                "link": F.when(F.col("href").isNotNull(), urls.resolve_url(F.col("url"), F.col("href"))).otherwise(F.col("url")),
            }
        )
        .filter(F.col("published").isNotNull())
        .filter(text.matches_keywords(everything, F.lit(""), F.col("keywords")))
    )
    rows = first_per_key(rows, "link", "node_pos", PAGE)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("node_pos"))).filter(
        F.col("_n") <= F.coalesce("limit", F.lit(limit))
    )
    labels = F.nullif(F.array_join(F.slice("tags", 1, 3), " / "), F.lit(""))
    lead = F.when(F.col("text") != "", cut(F.col("text"), 96)).otherwise("Update")
    title = F.concat(F.concat_ws(" | ", "name", badge, labels), F.lit(": "), lead)
    return _official(rows, F.col("_n"), title, F.col("link"), F.when(F.col("text") != "", cut(F.col("text"), 220)).otherwise(lead))


def release_notes(nodes: DataFrame, sources: DataFrame, now: Column, limit: int = _DEFAULT_LIMIT) -> DataFrame:
    """Cards where a page has some, else its dated sections."""
    cards = changelog_cards(nodes, sources, now, limit)
    notes = docs_release_notes(nodes, sources, limit)
    return cards.unionByName(notes.join(cards.select("page_id").distinct(), "page_id", "left_anti"))


def static_pages(nodes: DataFrame, curated: DataFrame, shown: int = 2000) -> DataFrame:
    """Curated rows (url, name, title, desc, published_at_raw, keywords) whose page still mentions a keyword."""
    rows = nodes.filter("kind = 'page'").select("page_id", "url", F.col("text").alias("body")).join(curated, "url")
    rows = rows.filter(text.matches_keywords(F.col("title"), cut(F.col("body"), shown), F.col("keywords")))
    return _official(
        rows.withColumn("published", F.col("published_at_raw")), F.lit(0), F.col("title"), F.col("url"), F.col("desc")
    )
