"""Landed responses (`payload` text, one row per response) to raw items.

Every frame carries `payload_order`, the place of the response among those of its source. `seq`, an order key (operators.order), is made
of it and the place of the entry inside the response, so arrival order survives any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from briefloom.functions import dates, score, text
from briefloom.functions.text import cut, strip_text, text_or_empty
from briefloom.operators.aggregates import star_delta
from briefloom.operators.dedup import first_per_key, longest_per_url
from briefloom.operators.order import KEY, numbered, sequence, under, with_order
from briefloom.operators.rank import top_k_per_source

RAW_COLUMNS = [
    "seq", "title", "url", "desc", "source_name", "source_type", "published_at_raw", "tags", "keyword_match",
    "recent_feature_signal",
]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Files of one source as (path, payload, payload_order) rows, in the order of their names."""
    return with_order(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload")))


def union_sources(*parts: DataFrame) -> DataFrame:
    """Concatenate in the given order: `seq` of a later part is above any `seq` of an earlier one. Parts may be unions themselves."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("seq", under(i, F.col("seq"), part.schema["seq"].dataType))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _raw(df: DataFrame, by: Sequence[str] = (), **cols: Column | str) -> DataFrame:
    """Select the raw item columns; those a source lacks are NULL."""
    types = {"tags": "array<string>", "recent_feature_signal": "boolean", "seq": KEY}
    out = []
    for name in RAW_COLUMNS:
        value = cols.get(name)
        column = F.lit(value) if value is None or isinstance(value, str) else value
        out.append(column.cast(types.get(name, "string")).alias(name))
    return df.select(*by, *out)


def _entries(raw: DataFrame, schema: str, path: str, first: int | None = None) -> DataFrame:
    """One row `e` per entry of a JSON payload with its `seq`."""
    parsed = F.from_json("payload", schema)
    items = parsed.getField(path) if path else parsed
    if first is not None:
        items = F.slice(items, 1, first)
    keep = [c for c in raw.columns if c != "payload"]
    return raw.select(*keep, F.posexplode(items).alias("_pos", "e")).withColumn(
        "seq", sequence(F.col("payload_order"), F.col("_pos"))
    )


def _filled(c: Column) -> Column:
    return text_or_empty(c) != ""


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))


def _some(c: Column, default: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


# --- JSON ---------------------------------------------------------------------------------------------------------


def news_articles(raw: DataFrame, source_type: str = "news", by: Sequence[str] = ()) -> DataFrame:
    e = F.col("e")
    rows = _entries(
        raw,
        "articles ARRAY<STRUCT<title: STRING, url: STRING, description: STRING, source: STRUCT<name: STRING>, publishedAt: STRING>>",
        "articles",
    ).filter(_filled(e["title"]) & _filled(e["url"]))
    return _raw(
        rows, by, seq=F.col("seq"), title=e["title"], url=e["url"], desc=text_or_empty(e["description"]),
        source_name=F.coalesce(e["source"]["name"], F.lit("newsapi")), source_type=source_type,
        published_at_raw=e["publishedAt"],
    )


def hn_hits(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    e = F.col("e")
    rows = _entries(
        raw,
        "hits ARRAY<STRUCT<title: STRING, url: STRING, objectID: STRING, points: INT, num_comments: INT, created_at: STRING>>",
        "hits",
    ).filter(_filled(e["title"]))
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), e["objectID"])
    return _raw(
        rows, by, seq=F.col("seq"), title=F.concat(F.lit("[HN] "), e["title"]),
        url=F.coalesce(F.nullif(e["url"], F.lit("")), page),
        desc=F.concat(F.lit("Points: "), _some(e["points"], "0"), F.lit(" | Comments: "), _some(e["num_comments"], "0")),
        source_name="Hacker News", source_type="community", published_at_raw=e["created_at"],
    )


def repo_search(raw: DataFrame, stars: DataFrame, since: Column, by: Sequence[str] = ()) -> DataFrame:
    """Search results: longest description per address, star growth in the title, growing repositories first."""
    e = F.col("e")
    found = _entries(
        raw,
        "items ARRAY<STRUCT<full_name: STRING, html_url: STRING, stargazers_count: BIGINT, description: STRING, "
        "pushed_at: STRING, updated_at: STRING, created_at: STRING>>",
        "items",
    ).select(
        *by, "seq", e["full_name"].alias("repo"), e["html_url"].alias("url"),
        F.coalesce(e["stargazers_count"], F.lit(0)).alias("n_stars"), _or(e["description"], "No description.").alias("desc"),
        F.coalesce(*[F.nullif(e[c], F.lit("")) for c in ("pushed_at", "updated_at", "created_at")]).alias("published_at_raw"),
    )
    best = longest_per_url(found, ("seq",), by)
    arrival = found.groupBy(*by, "url").agg(F.min("seq").alias("arrival"))
    # stars may be those of one run or common to all
    keys = [k for k in (*by, "repo") if k in stars.columns]
    grown = star_delta(stars, since, keys)
    rows = best.join(arrival, [*by, "url"]).join(grown, keys, "left")
    total = F.concat(F.col("n_stars").cast("string"), F.lit(" stars)"))
    title = F.concat(
        F.lit("[GitHub] "), "repo", F.lit(" ("),
        F.when(F.col("star_delta") > 0, F.concat(F.lit("+"), F.col("star_delta").cast("string"), F.lit("★/7d, "))).otherwise(""),
        total,
    )
    rows = rows.select(*by, "url", "desc", "published_at_raw", title.alias("title"), F.struct(
        (-F.coalesce("star_delta", F.lit(-1))).alias("a"),
        F.coalesce(-F.unix_micros(dates.parse_published_at(F.col("published_at_raw"))), F.lit(1 << 62)).alias("b"),
        (-F.col("n_stars")).alias("c"), F.col("arrival").alias("d"),
    ).alias("_order"))
    rows = numbered(rows, [F.col("_order")], "_place", by)
    return _raw(
        rows, by, seq=sequence(F.lit(0), F.col("_place")), title=F.col("title"), url=F.col("url"), desc=F.col("desc"), source_name="GitHub", source_type="github_repo", published_at_raw=F.col("published_at_raw"),
    )


def hf_models(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    e = F.col("e")["repoData"]
    rows = _entries(
        raw,
        "recentlyTrending ARRAY<STRUCT<repoData: STRUCT<id: STRING, likes: BIGINT, downloads: BIGINT, pipeline_tag: STRING, "
        "lastModified: STRING>>>",
        "recentlyTrending",
    ).filter(_filled(e["id"]))
    return _raw(
        rows, by, seq=F.col("seq"), title=F.concat(F.lit("[HF Model] "), e["id"], F.lit(" ("), _some(e["likes"], "0"), F.lit(" likes)")),
        url=F.concat(F.lit("https://huggingface.co/"), e["id"]),
        desc=F.concat(F.lit("Downloads: "), _some(e["downloads"], "0"), F.lit(" | Task: "), _some(e["pipeline_tag"], "N/A")),
        source_name="Hugging Face", source_type="model_release", published_at_raw=e["lastModified"],
    )


def hf_papers(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    e = F.col("e")["paper"]
    rows = _entries(
        raw, "ARRAY<STRUCT<paper: STRUCT<id: STRING, title: STRING, summary: STRING, publishedAt: STRING>>>", ""
    ).filter(_filled(e["title"]) & _filled(e["id"]))
    return _raw(
        rows, by, seq=F.col("seq"), title=F.concat(F.lit("[HF Paper] "), e["title"]),
        url=F.concat(F.lit("https://huggingface.co/papers/"), e["id"]),
        desc=F.concat(
            F.lit("Published: "), _some(e["publishedAt"], "N/A"), F.lit(" | Summary: "), cut(text_or_empty(e["summary"]), 180), F.lit("...")
        ),
        source_name="Hugging Face", source_type="research", published_at_raw=e["publishedAt"],
    )


def repo_releases(raw: DataFrame, per_repo: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """First releases of each repository (`repo` column), then without patch noise; a repository may give none."""
    e = F.col("e")
    rows = _entries(
        raw, "ARRAY<STRUCT<name: STRING, tag_name: STRING, html_url: STRING, body: STRING, published_at: STRING>>", "", per_repo
    ).filter(~score.is_patch_noise(e["name"], e["tag_name"], e["body"]))
    shown = F.coalesce(F.nullif(e["name"], F.lit("")), e["tag_name"], F.lit("None"))
    return _raw(
        rows, by, seq=F.col("seq"), title=F.concat(F.lit("[GitHub Release] "), "repo", F.lit(" "), shown),
        url=F.coalesce(e["html_url"], F.concat(F.lit("https://github.com/"), "repo", F.lit("/releases"))),
        desc=F.concat(
            F.lit("Tag: "), _some(e["tag_name"], "N/A"), F.lit(" | Published: "), _some(e["published_at"], "N/A"), F.lit(" | "),
            cut(text.release_excerpt(e["body"]), 180), F.lit("..."),
        ),
        source_name="GitHub Releases", source_type="github_release", published_at_raw=e["published_at"],
        tags=F.array("repo"),
    )


# --- feeds --------------------------------------------------------------------------------------------------------

_RSS_ITEM = "ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, encoded: STRING, pubDate: STRING, date: STRING>>"
# RDF feeds have their items beside the channel
_RSS = f"channel STRUCT<item: {_RSS_ITEM}>, item {_RSS_ITEM}"
_XML = {"ignoreNamespace": "true"}
_ATOM = (
    "entry ARRAY<STRUCT<title: STRING, id: STRING, summary: STRING, content: STRING, published: STRING, updated: STRING, "
    "link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, author: ARRAY<STRUCT<name: STRING>>>>"
)


def feed_entries(raw: DataFrame, first: int | None = None) -> DataFrame:
    """RSS, RDF or Atom payloads to entries (title, link, summary, published, updated); optionally only the first ones.

    Without a description the encoded content stands for it, without a publication date the Dublin Core one.
    """
    parsed = F.from_xml("payload", _RSS, _XML)
    rss = F.transform(
        F.coalesce(parsed["channel"]["item"], parsed["item"]),
        lambda i: F.struct(
            i["title"].alias("title"), i["link"].alias("link"), F.coalesce(i["description"], i["encoded"]).alias("summary"),
            F.coalesce(i["pubDate"], i["date"]).alias("published"),
            F.lit(None).cast("string").alias("updated"),
        ),
    )
    atom = F.transform(
        F.from_xml("payload", _ATOM)["entry"],
        lambda i: F.struct(
            i["title"].alias("title"),
            F.coalesce(
                F.get(F.filter(i["link"], lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"],
                F.get(i["link"], F.lit(0))["_href"],
            ).alias("link"),
            F.coalesce(i["summary"], i["content"]).alias("summary"), i["published"].alias("published"), i["updated"].alias("updated"),
        ),
    )
    entries = F.when(F.col("payload").rlike(r"<feed[\s>]"), atom).otherwise(rss)
    if first is not None:
        entries = F.slice(entries, 1, first)
    keep = [c for c in raw.columns if c != "payload"]
    out = raw.select(*keep, F.posexplode(entries).alias("_pos", "e"))
    return out.select(
        *keep, sequence(F.col("payload_order"), F.col("_pos")).alias("seq"),
        *[strip_text(F.col("e")[c]).alias(c) for c in ("title", "link", "summary")],
        *[F.nullif(strip_text(F.col("e")[c]), F.lit("")).alias(c) for c in ("published", "updated")],
    )


def subreddit_top(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First 5 entries of each feed (`subreddit` column), then those with title and link."""
    rows = feed_entries(raw, 5).filter((F.col("title") != "") & (F.col("link") != ""))
    return _raw(
        rows, by, seq=F.col("seq"), title=F.concat(F.lit("[Reddit r/"), "subreddit", F.lit("] "), "title"), url=F.col("link"),
        desc=F.concat(F.lit("RSS fallback | "), cut(F.col("summary"), 100), F.lit("...")),
        source_name=F.concat(F.lit("Reddit/"), "subreddit"), source_type="community",
        published_at_raw=F.coalesce("published", "updated"),
    )


def subreddit_search(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First 3 entries per (`subreddit`, `query`) feed; a link found by several queries counts once."""
    rows = feed_entries(raw, 3).filter((F.col("title") != "") & (F.col("link") != ""))
    rows = first_per_key(rows, "link", "seq", by)
    return _raw(
        rows, by, seq=F.col("seq"), title=F.concat(F.lit("[Reddit r/"), "subreddit", F.lit("] "), "title"), url=F.col("link"),
        desc=F.concat(F.lit("Search match for "), "query", F.lit(" | "), cut(F.col("summary"), 120), F.lit("...")),
        source_name=F.concat(F.lit("Reddit/"), "subreddit"), source_type="community",
        published_at_raw=F.coalesce("published", "updated"), keyword_match=F.col("query"),
        recent_feature_signal=score.recent_feature_signal(F.col("title"), F.col("summary")),
    )


def arxiv_atom(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Paper entries; title, summary, id and date are all required."""
    e = F.col("e")
    keep = [c for c in raw.columns if c != "payload"]
    rows = (
        raw.select(*keep, F.posexplode(F.from_xml("payload", _ATOM)["entry"]).alias("_pos", "e"))
        .withColumn("seq", sequence(F.col("payload_order"), F.col("_pos")))
        .filter(reduce(lambda a, b: a & b, (text_or_empty(e[x]) != "" for x in ("title", "summary", "id", "published"))))
    )
    authors = F.array_join(F.filter(F.slice(e["author"], 1, 3)["name"], lambda n: n.isNotNull()), ", ")

    def line(c: Column) -> Column:
        return F.replace(strip_text(c), F.lit("\n"), F.lit(" "))

    return _raw(
        rows, by, seq=F.col("seq"), title=F.concat(F.lit("[arXiv] "), line(e["title"])), url=e["id"],
        desc=F.concat(
            F.lit("Authors: "), F.coalesce(F.nullif(authors, F.lit("")), F.lit("N/A")), F.lit(" | Published: "), cut(e["published"], 10),
            F.lit(" | Abstract: "), cut(line(e["summary"]), 250), F.lit("..."),
        ),
        source_name="arXiv", source_type="research", published_at_raw=e["published"],
    )


def official_feed(raw: DataFrame, sources: DataFrame, limit: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """First matching entries per feed. `sources`: source_id, name, keywords. The text is cut before tags go."""
    rows = (
        feed_entries(raw)
        .join(sources.select("source_id", "name", "keywords"), "source_id")
        .filter((F.col("title") != "") & (F.col("link") != ""))
        .filter(text.matches_keywords(F.col("title"), F.col("summary"), F.col("keywords")))
    )
    rows = top_k_per_source(rows, limit, [*by, "source_id"], [F.col("seq")])
    plain = text.normalize_text(text.unescape_entities(text.strip_tags(cut(F.col("summary"), 220))))
    return _raw(
        rows, by, seq=F.col("seq"), title=F.concat(F.lit("[Official] "), "title"), url=F.col("link"), desc=plain,
        source_name=F.col("name"), source_type="official_news",
        published_at_raw=dates.feed_published_at(F.col("published"), F.col("updated")),
    )
