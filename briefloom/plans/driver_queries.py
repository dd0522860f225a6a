"""Registered queries over the driver tables, each beside an independent SQL text where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from briefloom import lexicon as lx
from briefloom.functions import brief, dates, keys, score, text, urls
from briefloom.operators import aggregates, dedup, history as hist, items as it, joins, order, rank as rk, render, report
from briefloom.operators import select as sel
from briefloom.plans.driver_views import (
    ITEMS_SQL, RAW_SQL, TERMS, TRIM, TYPES, canon, events, has, in_case, items, norm, q, raw_items, rstrip, spread, spread_rows, stamp, table,
)
from briefloom.session import checkpoint_root, durable
from briefloom.sources import html, nodes, pages, payloads, quotes as qt
from briefloom.sources.tables import HistoryTable, read_bundles, write_run
from briefloom.streaming import dedup as sd, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
L = TERMS
c = F.col


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _plain(fn(spark, sf.rstrip("/")))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Comparable output: whole numbers as BIGINT, times as text."""
    out = []
    for field in df.schema.fields:
        kind, col = field.dataType.simpleString(), c(f"`{field.name}`")
        if kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind == "timestamp":
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            col = col.cast("string")
        out.append(col.alias(field.name))
    return df.select(*out)


# === text and addresses ===========================================================================================

register("url_canonical", f"SELECT page_id, {canon('url')} AS url FROM pages")(
    lambda s, sf: table(s, sf, "pages").select("page_id", urls.canonicalize_url(c("url")).alias("url"))
)


@register(
    "url_hosts",
    """SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS host, count(*) AS n,
       CAST(sum(CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN 1 ELSE 0 END) AS BIGINT) AS n_valid
       FROM pages GROUP BY 1""",
)
def url_hosts(s, sf):
    host = F.lower(urls.url_part(c("url"), urls.HOST))
    return table(s, sf, "pages").groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(urls.is_valid_source_url(c("url"))).alias("n_valid")
    )


# the references are bad, doubly escaped, rare, without a semicolon, and no references at all
_REFERENCES = " &#9999999; &#xD800; &#38;lt; &amp;lt; &eacute;&rarr;&zwnj; &copy2 &#x80;&#0; &nosuch; & &#x1F600;"


# the documents hold no references of their own
_ENTITY_SQL = """SELECT doc_id, text || ' ' || chr(65533) || ' ' || chr(65533) || ' &lt; &lt; ' || chr(233) || chr(8594) || chr(8204)
    || ' ' || chr(169) || '2 ' || chr(8364) || chr(65533) || ' &nosuch; & ' || chr(128512) AS text FROM documents"""


@register("entity_texts_whole", _ENTITY_SQL)
@register("entity_texts", _ENTITY_SQL)
def entity_texts(s, sf):
    raw = F.concat("text", F.lit(_REFERENCES))
    return spread(table(s, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", text.unescape_entities(raw).alias("text"))


@register("link_encoding", """SELECT page_id, replace(url, ' ', '%20') || '/%C3%A9%20x?q=%C3%BC' AS link FROM (
    SELECT page_id, regexp_extract(url, '^[^?#]*') AS url FROM pages)""")
def link_encoding(s, sf):
    base = F.regexp_extract("url", r"^[^?#]*", 0)
    return table(s, sf, "pages").select("page_id", urls.normalize_link_url(F.concat(base, F.lit("/é x?q=ü"))).alias("link"))


@register("snippet_clean", rf"""
WITH t AS (SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS x FROM pages),
u AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS x FROM t),
v AS (SELECT page_id, {norm('x')} AS x FROM u)
SELECT page_id, CAST(length(x) AS BIGINT) AS n, md5(x) AS digest FROM v""")
def snippet_clean(s, sf):
    out = table(s, sf, "pages").withColumn("x", text.clean_snippet(c("html")))
    return out.select("page_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


@register("normalize_items", f"""WITH {RAW_SQL}, n AS (
  SELECT seq, {norm('title')} AS title, {canon('url')} AS url, {norm('"desc"')} AS d, source_type, published_at_raw FROM raw)
SELECT seq, md5(title) AS title, url, CAST(length(d) AS BIGINT) AS n_desc, md5(d) AS digest, source_type, published_at_raw,
  {stamp("try_strptime(published_at_raw, ['%Y-%m-%dT%H:%M:%SZ', '%a, %d %b %Y %H:%M:%S GMT', '%Y-%m-%d', '%B %d, %Y'])")} AS published_at
FROM n""")
def normalize_items(s, sf):
    return it.normalize_items(raw_items(s, sf)).select(
        "seq", F.md5("title").alias("title"), "url", F.length("desc").alias("n_desc"), F.md5("desc").alias("digest"), "source_type",
        "published_at_raw", "published_at",
    )


register("trim_descriptions", f'WITH {RAW_SQL} SELECT seq, {TRIM} AS "desc" FROM raw')(
    lambda s, sf: raw_items(s, sf, it.trim_descriptions).select("seq", "desc")
)

register("truncate_text", f"""WITH {RAW_SQL} SELECT seq, CASE WHEN length(title) > 90 THEN {rstrip('substr(title, 1, 87)')} || '...'
  ELSE title END AS title FROM raw""")(
    lambda s, sf: raw_items(s, sf).select("seq", text.truncate_text(c("title"), 90).alias("title"))
)

_BODY = "lower(title || ' ' || \"desc\")"
_TAGS = "concat_ws(','," + ", ".join(f"CASE WHEN contains(b, {q(t)}) THEN {q(t)} END" for t in L.priority) + ")"
_PRIORITY = "CASE " + " ".join(f"WHEN contains(b, {q(t)}) THEN {i}" for i, t in enumerate(L.priority)) + " ELSE 999 END"


@register("tags_priority", f"""WITH {RAW_SQL}, n AS (SELECT seq, lower({norm('title')} || ' ' || {norm('"desc"')}) AS b FROM raw)
SELECT seq, {_TAGS} AS tags, CAST({_PRIORITY} AS BIGINT) AS priority FROM n""")
def tags_priority(s, sf):
    out = it.with_tags(it.normalize_items(raw_items(s, sf)), L.priority)
    return out.select("seq", F.array_join("tags", ",").alias("tags"), "priority")


@register("match_keywords", f"""SELECT doc_id, {has('lower(text)', ('license', 'token', 'keiten'))} AS hit FROM documents""")
def match_keywords(s, sf):
    return table(s, sf, "documents").select(
        "doc_id", text.matches_keywords(F.lit(""), c("text"), ("license", "token", "keiten")).alias("hit")
    )


@register("title_keys", f"""WITH {ITEMS_SQL} SELECT seq,
  substr(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 1, 96) AS ascii_key,
  substr(regexp_replace(lower(title), '[^\\pL\\pN]+', '', 'g'), 1, 120) AS letters_key FROM items""")
def title_keys(s, sf):
    return items(s, sf).select(
        "seq", text.title_key_ascii(c("title"), 96).alias("ascii_key"), text.title_key_alnum(c("title")).alias("letters_key")
    )


_KEY = "substr(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 1, 120)"
_CONTENT = f"""CASE WHEN length({_KEY}) >= 24 THEN 'title:' || {_KEY} WHEN url <> '' THEN 'url:' || url
  WHEN {_KEY} <> '' THEN 'title:' || {_KEY} ELSE '' END"""


@register("content_keys", f"WITH {ITEMS_SQL} SELECT seq, {_CONTENT} AS key FROM items")
def content_keys(s, sf):
    return items(s, sf).select(
        "seq", keys.content_dedupe_key(c("title"), c("url"), c("source_name"), None, c("desc")).alias("key")
    )


_FAMILY_TITLE = """CASE seq % 5 WHEN 0 THEN 'Introducing GPT-' || (seq % 7) || '.' || (seq % 3) || ' ' || title
  WHEN 1 THEN 'google/gemma-4-E' || (seq % 4) || 'b ' || title WHEN 2 THEN 'GPT ' || (seq % 7) || ' system card' ELSE title END"""


@register("family_keys", f"""WITH {ITEMS_SQL}, t AS (SELECT seq, {_FAMILY_TITLE} AS title, seq % 5 AS m FROM items)
SELECT seq, CASE m WHEN 0 THEN 'openai-gpt-' || (seq % 7) || '.' || (seq % 3) WHEN 2 THEN 'openai-gpt-' || (seq % 7) END AS release,
  CASE WHEN m = 1 THEN 'gemma-4-e' || (seq % 4) || 'b' END AS model,
  CAST(CASE WHEN contains(lower(title), 'system card') THEN 3 WHEN m = 0 THEN 0 ELSE 1 END AS BIGINT) AS release_rank FROM t""")
def family_keys(s, sf):
    rows = items(s, sf).withColumn("title", F.expr(_FAMILY_TITLE))
    return rows.select(
        "seq", keys.release_family_key(c("title"), F.lit("OpenAI News"), c("url")).alias("release"),
        keys.model_family_key(c("title"), F.lit("Hugging Face"), F.lit("model_release")).alias("model"),
        score.release_item_rank(c("title")).alias("release_rank"),
    )


register("fingerprints", f"""WITH {ITEMS_SQL} SELECT seq, sha256(lower(title) || chr(1) || url || chr(1) || lower(source_name) || chr(1) ||
  lower(source_type)) AS fingerprint FROM items""")(
    lambda s, sf: items(s, sf).select("seq", hist.fingerprint_of_item().alias("fingerprint"))
)


_PLAIN_BODY = r"regexp_replace(replace(regexp_replace(body, '```[\s\S]*?```', ' ', 'g'), '`', ''), '[*>#-]+', ' ', 'g')"


@register("release_excerpts", rf"""WITH b AS (SELECT doc_id, '```x' || chr(10) || 'y```- **' || text || '** `z` # end' AS body FROM documents),
t AS (SELECT doc_id, {norm(_PLAIN_BODY)} AS x FROM b)
SELECT doc_id, CAST(length(x) AS BIGINT) AS n, md5(x) AS digest FROM t""")
def release_excerpts(s, sf):
    body = F.concat(F.lit("```x\ny```- **"), "text", F.lit("** `z` # end"))
    out = table(s, sf, "documents").withColumn("x", text.release_excerpt(body))
    return out.select("doc_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


@register("feature_signals", f"SELECT doc_id, {has('lower(text)', lx.FEATURE_SIGNAL)} AS signal FROM documents")
def feature_signals(s, sf):
    return table(s, sf, "documents").select("doc_id", score.recent_feature_signal(F.lit(""), c("text")).alias("signal"))


@register("patch_noise", """SELECT doc_id, regexp_matches('v' || (doc_id % 9) || '.' || (doc_id % 4) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.1' END,
  '^v?\\d+\\.\\d+\\.\\d+$') AND NOT """ + has("lower(text)", lx.PATCH_HIGH_SIGNAL) + " AS noise FROM documents")
def patch_noise(s, sf):
    n = c("doc_id")
    tag = F.concat(F.lit("v"), (n % 9).cast("string"), F.lit("."), (n % 4).cast("string"), F.when(n % 3 == 0, "").otherwise(".1"))
    return table(s, sf, "documents").select("doc_id", score.is_patch_noise(F.lit("Hotfix"), tag, c("text")).alias("noise"))


# === dates and numbers ============================================================================================

register("parse_dates", f"WITH {ITEMS_SQL} SELECT seq, {stamp('published_at')} AS published_at FROM items")(
    lambda s, sf: raw_items(s, sf).select("seq", dates.parse_published_at(c("published_at_raw")).alias("published_at"))
)


@register("date_in_text", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%b %d, %Y') END AS found,
  strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events""")
def date_in_text(s, sf):
    shown = F.when(c("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "MMM dd, yyyy"))
    rows = events(s, sf).withColumn("found", dates.extract_date(F.concat(F.lit("seen 19-1-1 on "), shown, F.lit(" by "), "event_type")))
    return rows.select("event_id", "found", dates.normalize_datetime(c("found")).alias("iso"))


@register("feed_dates", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS published
  FROM events""")
def feed_dates(s, sf):
    mail = F.when(c("event_id") % 2 == 0, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss '+0000'"))
    return events(s, sf).select("event_id", dates.feed_published_at(mail, F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("published"))


register("report_titles", "SELECT event_id, '[AI] ' || strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS title FROM events")(
    lambda s, sf: events(s, sf).select("event_id", dates.report_title("[AI]", c("ts")).alias("title"))
)


@register("year_rollback", """
WITH m AS (SELECT o_custkey AS list_id, o_orderkey AS pos, month(o_orderdate) AS month FROM orders),
p AS (SELECT *, lag(month) OVER (PARTITION BY list_id ORDER BY pos) AS before FROM m)
SELECT list_id, pos, CAST(month AS BIGINT) AS month, CAST(2026 - sum(CASE WHEN before IS NULL THEN CASE WHEN month > 5 THEN 1 ELSE 0 END
  WHEN month > before THEN 1 ELSE 0 END) OVER (PARTITION BY list_id ORDER BY pos) AS BIGINT) AS year FROM p""")
def year_rollback(s, sf):
    rows = table(s, sf, "orders").select(c("o_custkey").alias("list_id"), c("o_orderkey").alias("pos"), F.month("o_orderdate").alias("month"))
    now = F.to_timestamp(F.lit("2026-04-12 00:00:00"))
    return pages.with_year(rows, "month", now, ["list_id"], "pos")


# === classes and scores ===========================================================================================

_WHOLE = "lower(title || ' ' || \"desc\" || ' ' || source_name || ' ' || url)"
_IMPACT = f"""(CASE WHEN {has('w', L.named_events)} THEN 80 ELSE 0 END + CASE WHEN {has('w', L.providers)} THEN
  CASE WHEN {has('w', L.high_impact)} THEN 35 ELSE 0 END + CASE WHEN {has('w', L.incident)} THEN 30 ELSE 0 END ELSE 0 END)"""
_IMPACT = f"({_IMPACT} + CASE WHEN {_IMPACT} > 0 AND source_type IN ('official_news', 'research') THEN 10 ELSE 0 END)"
_LOW = f"""(CASE WHEN source_type = 'community' THEN length(title) < 18 OR (starts_with(lower(title), '[reddit') AND len(string_split(title, ' ')) <= 3)
  WHEN source_type IN ('official_news', 'news') THEN {has('b', L.promo)} AND NOT {has('b', L.promo_allow)} ELSE false END)"""
_RELEVANT = f"""(CASE WHEN {has('b', L.providers)} AND {has('b', L.incident)} AND {has('b', L.incident_context)} THEN true
  WHEN {has('b', L.negative)} THEN false WHEN source_type IN ('official_news', 'model_release', 'research', 'github_release', 'github_repo') THEN true
  ELSE {has('b', L.positive)} END)"""
_BOTH = f"SELECT *, {_BODY} AS b, {_WHOLE} AS w FROM items"


@register("source_scores", f"""WITH {ITEMS_SQL}, x AS ({_BOTH}) SELECT seq, CAST({in_case('source_type', lx.SOURCE_SCORE, 10)} AS BIGINT) AS quality,
  CAST({in_case('source_type', lx.DISPLAY_RANK, 9)} AS BIGINT) AS shown, CAST(CASE WHEN {has('w', L.providers)} THEN 0 ELSE 1 END AS BIGINT) AS provider,
  CAST({_IMPACT} AS BIGINT) AS impact FROM x""")
def source_scores(s, sf):
    return items(s, sf).select(
        "seq", score.source_quality_score(c("source_type")).alias("quality"), score.display_rank(c("source_type")).alias("shown"),
        score.provider_priority(it._whole_text(), L.providers).alias("provider"), it.impact(L).alias("impact"),
    )


register("low_signal", f"WITH {ITEMS_SQL}, x AS ({_BOTH}) SELECT seq FROM x WHERE url <> '' AND title <> '' AND NOT {_LOW}")(
    lambda s, sf: it.drop_low_signal(it.require_title_url(items(s, sf)), L).select("seq")
)
register("relevant_items", f"WITH {ITEMS_SQL}, x AS ({_BOTH}) SELECT seq, source_type FROM x WHERE {_RELEVANT}")(
    lambda s, sf: it.keep_relevant(items(s, sf), L).select("seq", "source_type")
)


def _now(s, sf):
    """Latest event time as a one-row frame."""
    return events(s, sf).agg(F.max("ts").alias("now"))


def _with_now(df, s, sf):
    return df.crossJoin(_now(s, sf))


@register("recent_items", f"""WITH {ITEMS_SQL} SELECT seq FROM items, (SELECT max(ts) AS now FROM events)
  WHERE published_at >= now - INTERVAL 7 DAY OR published_at IS NULL""")
def recent_items(s, sf):
    return it.keep_recent(_with_now(items(s, sf), s, sf), 7, c("now")).select("seq")


@register("impact_archive", f"""WITH {ITEMS_SQL}, x AS ({_BOTH}) SELECT seq, CAST({_IMPACT} AS BIGINT) AS impact
  FROM x, (SELECT max(ts) AS now FROM events) WHERE {_IMPACT} > 0 AND published_at >= now - INTERVAL 20 DAY""")
def impact_archive(s, sf):
    rows = it.high_impact_archive(_with_now(items(s, sf), s, sf), c("now"), 20, L)
    return rows.select("seq", it.impact(L).alias("impact"))


_CLASSES = (("a", ("src1", "license")), ("b", ("src2", "token")), ("c", ("/fr/", "keiten")))
_CLASS = "CASE " + " ".join(f"WHEN {has('k', t)} THEN {q(n)}" for n, t in _CLASSES) + " END"
_NAMED = "CASE " + " ".join(f"WHEN {has('h', t)} THEN {q(n)}" for n, t in _CLASSES) + " ELSE source_name END"


@register("provider_classes", f"""WITH {ITEMS_SQL}, x AS (SELECT *, lower(source_name || ' ' || title || ' ' || url) AS k,
  lower(source_name || ' ' || title) AS h, {has('lower(title || source_name)', ('license', 'src3'))} AS p FROM items)
SELECT seq, {_CLASS} AS provider, {_NAMED} AS label, CAST(CASE WHEN source_type IN ('github_repo', 'github_release') THEN 4
  WHEN source_type = 'community' AND p THEN 2 WHEN source_type = 'community' THEN 3 WHEN p THEN 0 ELSE 1 END AS BIGINT) AS bucket FROM x""")
def provider_classes(s, sf):
    return items(s, sf).select(
        "seq", score.provider_key(c("source_name"), c("title"), c("url"), _CLASSES).alias("provider"),
        score.provider_label(c("source_name"), c("title"), _CLASSES).alias("label"),
        score.render_bucket(c("source_type"), c("title"), F.lit(""), c("source_name"), ("license", "src3")).alias("bucket"),
    )


@register("appendix_eligible", f"WITH {ITEMS_SQL} SELECT seq FROM items WHERE source_type <> 'community' OR contains(lower(title || ' ' || \"desc\"), 'tion')")
def appendix_eligible(s, sf):
    rows = items(s, sf).withColumn("recent_feature_signal", score.recent_feature_signal(c("title"), c("desc"), ("tion",)))
    return rows.filter(it.is_appendix_eligible()).select("seq")


# === de-duplication and ranking ===================================================================================

_DEDUP = f"""WITH {ITEMS_SQL}, x AS ({_BOTH}), f AS (SELECT * FROM x WHERE url <> '' AND title <> '' AND NOT {_LOW}),
k AS (SELECT *, {_CONTENT} AS key0, substr(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 1, 96) AS tk,
  CASE WHEN contains(lower(title), 'system card') THEN 3 WHEN starts_with(lower(title), 'introducing ') THEN 0 ELSE 1 END AS rr,
  {in_case('source_type', lx.SOURCE_SCORE, 10)} AS quality FROM f),
g AS (SELECT *, CASE WHEN length(tk) >= 24 THEN first_value(key0) OVER (PARTITION BY tk ORDER BY seq) ELSE key0 END AS gk FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY gk ORDER BY rr, quality DESC, length("desc") DESC, coalesce(published_at_raw, '') DESC, seq) AS rn,
  min(seq) OVER (PARTITION BY gk) AS position FROM g),
d AS (SELECT *, CAST({_PRIORITY} AS BIGINT) AS priority, CASE WHEN {has('w', L.providers)} THEN 0 ELSE 1 END AS provider, {_IMPACT} AS impact
  FROM o WHERE rn = 1)"""
_RANKED = _DEDUP + """, r AS (SELECT *, row_number() OVER (ORDER BY priority, provider, impact DESC, quality DESC,
  published_at DESC NULLS LAST, position) AS rank FROM d)"""


def _filtered(s, sf):
    return it.drop_low_signal(it.require_title_url(items(s, sf)), L)


register("dedup_items", _DEDUP + " SELECT seq, gk AS group_key, position FROM d")(
    lambda s, sf: dedup.dedup_items(_filtered(s, sf)).select("seq", "group_key", "position")
)
register("dedup_items_exact", _DEDUP + " SELECT seq, gk AS group_key, position FROM d")(
    lambda s, sf: dedup.dedup_items_exact(_filtered(s, sf)).select("seq", "group_key", "position")
)


# many rows share a long title, some of them also a release family: there the order of arrival decides which stories are one
_STORY = "'GPT-5.' || (seq % 4) || ' explained, the long story number ' || (seq % 36)"
_STORY_SOURCE = "CASE WHEN seq * 7 % 5 < 2 THEN 'OpenAI News' ELSE source_name END"
_REPLAY = f"""WITH RECURSIVE {ITEMS_SQL}, n AS (SELECT * REPLACE ({_STORY} AS title, {_STORY_SOURCE} AS source_name) FROM items),
x AS (SELECT seq, category, substr(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 1, 96) AS tk, CASE WHEN contains(lower(title || ' ' || source_name || ' ' || "desc" || ' ' || url), 'openai')
    THEN 'release-family:openai-gpt-' || regexp_extract(lower(title), 'gpt-([0-9.]+)', 1) ELSE {_CONTENT} END AS key0,
  lpad({in_case('source_type', lx.SOURCE_SCORE, 10)}::VARCHAR, 3, '0') || lpad(length("desc")::VARCHAR, 6, '0') || coalesce(published_at_raw, '') AS quality,
  row_number() OVER (PARTITION BY category ORDER BY seq) AS i FROM n),
w(category, i, named, best, owner, arrived) AS (
  SELECT DISTINCT category, CAST(0 AS BIGINT), CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)), CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)), CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)), CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) FROM x
  UNION ALL
  SELECT category, i, CASE WHEN wins AND length(tk) >= 24 THEN map_concat(named, MAP {{tk: key}}) ELSE named END, CASE WHEN wins THEN map_concat(best, MAP {{key: quality}}) ELSE best END,
    CASE WHEN wins THEN map_concat(owner, MAP {{key: seq}}) ELSE owner END, CASE WHEN map_contains(arrived, key) THEN arrived ELSE map_concat(arrived, MAP {{key: seq}}) END
  FROM (SELECT *, NOT map_contains(best, key) OR quality > map_extract_value(best, key) AS wins FROM (
    SELECT x.*, named, best, owner, arrived, CASE WHEN length(tk) >= 24 AND map_contains(named, tk) THEN map_extract_value(named, tk) ELSE key0 END AS key
    FROM w JOIN x ON x.category = w.category AND x.i = w.i + 1)))
SELECT category, key AS group_key, map_extract_value(owner, key) AS seq, map_extract_value(arrived, key) AS position FROM (
  SELECT category, owner, arrived, unnest(map_keys(owner)) AS key FROM (SELECT category, arg_max(owner, i) AS owner, arg_max(arrived, i) AS arrived FROM w GROUP BY category))"""


@register("dedup_replay", _REPLAY)
def dedup_replay(s, sf):
    raw = raw_items(s, sf, it.trim_descriptions).withColumns({"title": F.expr(_STORY), "source_name": F.expr(_STORY_SOURCE)})
    out = dedup.dedup_items_exact(it.normalize_items(raw), ["category"])
    return out.select("category", "group_key", "seq", "position")


def _ranked(s, sf, limit=60):
    return dedup.deduplicate_and_rank(raw_items(s, sf, it.trim_descriptions), L, limit)


register("deduplicate_and_rank", _RANKED + " SELECT rank, seq, title, url, priority, position FROM r WHERE rank <= 60")(
    lambda s, sf: _ranked(s, sf).select("rank", "seq", "title", "url", "priority", "position")
)


@register("ranked_by_category", _DEDUP.replace("PARTITION BY tk", "PARTITION BY category, tk").replace("PARTITION BY gk", "PARTITION BY category, gk") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority, provider, impact DESC, quality DESC,
  published_at DESC NULLS LAST, position) AS rank FROM d) SELECT category, rank, seq FROM r WHERE rank <= 20""")
def ranked_by_category(s, sf):
    raw = raw_items(s, sf, it.trim_descriptions)
    return dedup.deduplicate_and_rank(raw, L, 20, by=["category"]).select("category", "rank", "seq")


@register("longest_per_url", f"""WITH {ITEMS_SQL} SELECT url, seq, CAST(length("desc") AS BIGINT) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY length("desc") DESC, seq) AS rn FROM items) WHERE rn = 1""")
def longest_per_url(s, sf):
    return dedup.longest_per_url(items(s, sf)).select("url", "seq", F.length("desc").alias("n"))


@register("first_per_key", f"""WITH {ITEMS_SQL} SELECT category, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY category, {_CONTENT} ORDER BY seq) AS rn FROM items WHERE {_CONTENT} <> '') WHERE rn = 1""")
def first_per_key(s, sf):
    key = keys.content_dedupe_key(c("title"), c("url"), normalized=True)
    return dedup.first_per_key(items(s, sf), key, "seq", ["category"]).select("category", "seq")


@register("top_k_per_source", f"""WITH {ITEMS_SQL} SELECT source_name, seq, n AS source_position FROM (SELECT *, row_number() OVER (
  PARTITION BY source_name ORDER BY published_at DESC NULLS LAST, seq) AS n FROM items) WHERE n <= 5""")
def top_k_per_source(s, sf):
    order = [c("published_at").desc_nulls_last(), c("seq")]
    return rk.top_k_per_source(items(s, sf), 5, ["source_name"], order).select("source_name", "seq", "source_position")


@register("top_k_large", """SELECT event_type AS category, event_id, n FROM (SELECT *, row_number() OVER (
  PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 1500""")
def top_k_large(s, sf):
    rows = events(s, sf).withColumnRenamed("event_type", "category")
    return rk.top_k(rows, 1500, [c("value").desc(), c("event_id")], ["category"], "n", ["event_id"]).select("category", "event_id", "n")


_SHOWN = in_case("source_type", lx.DISPLAY_RANK, 9)
register("display_sort", f"""WITH {ITEMS_SQL} SELECT category, seq, n AS display_position FROM (SELECT *, row_number() OVER (
  PARTITION BY category ORDER BY {_SHOWN}, published_at DESC NULLS LAST, seq) AS n FROM items) WHERE n <= 12""")(
    lambda s, sf: rk.display_sort(items(s, sf), 12, ["category"]).select("category", "seq", "display_position")
)


@register("appendix_sort", f"""WITH {ITEMS_SQL}, x AS (SELECT *, {has("lower(title || ' ' || \"desc\" || ' ' || source_name)", lx.RENDER_PROVIDERS)} AS p FROM items)
SELECT category, seq, n AS appendix_position FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY
  CASE WHEN source_type IN ('github_repo', 'github_release') THEN 4 WHEN source_type = 'community' AND p THEN 2
    WHEN source_type = 'community' THEN 3 WHEN p THEN 0 ELSE 1 END, CASE WHEN p THEN 0 ELSE 1 END,
  CASE WHEN source_type = 'news' THEN 0 ELSE 1 END, published_at DESC NULLS LAST, seq) AS n FROM x) WHERE n <= 40""")
def appendix_sort(s, sf):
    rows = items(s, sf).withColumns({"summary": c("desc"), "is_primary": c("source_type") == "news"})
    return rk.appendix_sort(rows, 40, ["category"], "seq").select("category", "seq", "appendix_position")


@register("distinct_officials", f"""WITH {ITEMS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY category, lower(source_name)
  ORDER BY published_at DESC NULLS LAST, seq) AS rn FROM items WHERE source_type = 'official_news')
SELECT category, seq, n AS official_position FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY published_at DESC NULLS LAST, seq) AS n
  FROM p WHERE rn = 1) WHERE n <= 2""")
def distinct_officials(s, sf):
    return rk.distinct_source_officials(items(s, sf), 2, ["category"]).select("category", "seq", "official_position")


register("first_candidates", f"""WITH {ITEMS_SQL} SELECT category, source_type, seq FROM (SELECT *, row_number() OVER (
  PARTITION BY category, source_type ORDER BY {_SHOWN}, published_at DESC NULLS LAST, seq) AS n FROM items) WHERE n = 1""")(
    lambda s, sf: rk.first_candidate(items(s, sf), "source_type", ["category"]).select("category", "source_type", "seq")
)


def _quota_sql() -> str:
    parts, chosen = [], "SELECT category, url, seq, 0 AS phase FROM items WHERE false"
    for i, (kind, quota) in enumerate(lx.QUOTAS):
        parts.append(f"c{i} AS ({chosen})")
        parts.append(f"""s{i} AS (SELECT category, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS n FROM (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, url ORDER BY seq) AS u FROM items i WHERE source_type = {q(kind)}
            AND NOT EXISTS (SELECT 1 FROM c{i} t WHERE t.category = i.category AND t.url = i.url)) WHERE u = 1)) WHERE n <= {quota})""")
        chosen = f"SELECT * FROM c{i} UNION ALL SELECT category, url, seq, {i} AS phase FROM s{i}"
    parts.append(f"ca AS ({chosen})")
    parts.append("""fill AS (SELECT category, url, seq, 9 AS phase FROM (SELECT *, row_number() OVER (PARTITION BY category, url ORDER BY seq) AS u
      FROM items i WHERE NOT EXISTS (SELECT 1 FROM ca t WHERE t.category = i.category AND t.url = i.url)) WHERE u = 1)""")
    parts.append("""o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY phase, seq) AS selected_position
      FROM (SELECT * FROM ca UNION ALL SELECT * FROM fill))""")
    return f"WITH {ITEMS_SQL}, " + ", ".join(parts) + " SELECT category, seq, selected_position FROM o WHERE selected_position <= 24"


register("select_with_quotas", _quota_sql())(
    lambda s, sf: sel.select_with_quotas(items(s, sf), 24, by=["category"], rank="seq").select("category", "seq", "selected_position")
)


# === joins and sets ===============================================================================================


def _report_rows(s, sf, kind="research"):
    """One report per language, made of the rows of one source type."""
    rows = items(s, sf).filter(c("source_type") == kind)
    return rows.withColumns(
        {"report_id": c("category"), "position": c("seq").cast("int"), "is_primary": F.lit(True), "summary": c("desc"), "insight": F.lit("")}
    ).select(*report.ITEM_COLUMNS)


def _pool(s, sf):
    return items(s, sf).withColumn("report_id", c("category"))


_TKEY = "substr(regexp_replace(lower(title), '[^\\pL\\pN]+', '', 'g'), 1, 120)"


@register("hydrate_metadata", f"""WITH {ITEMS_SQL}, k AS (SELECT *, {_TKEY} AS t FROM items),
u AS (SELECT category, url, max(seq) AS seq FROM items GROUP BY 1, 2), t AS (SELECT category, t, min(seq) AS seq FROM k WHERE t <> '' GROUP BY 1, 2),
r AS (SELECT category, seq, CASE WHEN seq % 2 = 0 THEN url ELSE 'https://none.example.com/' || seq END AS url, t FROM k WHERE source_type IN ('research', 'news'))
SELECT r.category AS report_id, r.seq AS position, i.source_name, i.source_type, i.published_at_raw
FROM r LEFT JOIN u ON u.category = r.category AND u.url = r.url LEFT JOIN t ON t.category = r.category AND t.t = r.t
LEFT JOIN items i ON i.seq = coalesce(u.seq, t.seq)""")
def hydrate_metadata(s, sf):
    blank = F.lit(None).cast("string")
    rows = items(s, sf).filter(c("source_type").isin("research", "news")).select(
        c("category").alias("report_id"), c("seq").alias("position"), "title",
        F.when(c("seq") % 2 == 0, c("url")).otherwise(F.concat(F.lit("https://none.example.com/"), c("seq").cast("string"))).alias("url"),
        F.lit("unknown").alias("source_name"), F.lit("").alias("source_type"), blank.alias("published_at_raw"),
        F.lit(None).cast("timestamp").alias("published_at"),
    )
    out = joins.hydrate_metadata(rows, _pool(s, sf))
    return out.select("report_id", "position", "source_name", F.nullif("source_type", F.lit("")).alias("source_type"), "published_at_raw")


_HEADLINE = f"CASE WHEN length(title) > 110 THEN {rstrip('substr(title, 1, 107)')} || '...' ELSE title END"
_LABEL = "CASE " + " ".join(f"WHEN {has('k', t)} THEN {q(n)}" for n, t in lx.PROVIDER_LABELS) + " ELSE source_name END"


@register("fill_insight", f"""WITH {ITEMS_SQL}, u AS (SELECT category, url, max(seq) AS seq FROM items GROUP BY 1, 2),
b AS (SELECT *, lower(source_name || ' ' || {_HEADLINE}) AS k, lower({_HEADLINE}) AS h FROM items)
SELECT r.category AS report_id, r.seq AS position, CASE WHEN contains(h, 'advisor') OR contains(h, 'simulation') OR contains(h, 'cyber') THEN ''
  ELSE '這則媒體報導可作為 ' || {_LABEL.replace('source_name', 'b.source_name')} || ' 官方動向的外部驗證，適合搭配原始公告一起判讀。' END AS insight
FROM items r JOIN u ON u.category = r.category AND u.url = r.url JOIN b ON b.seq = u.seq WHERE r.source_type = 'news'""")
def fill_insight(s, sf):
    news = _pool(s, sf).withColumn("source_type", F.lit("news"))
    return report.fill_insight(_report_rows(s, sf, "news"), news, report.AI, "seq").select("report_id", "position", "insight")


_RESEARCH = "(SELECT * FROM items WHERE source_type = 'research')"


@register("appendix_pool", f"""WITH {ITEMS_SQL} SELECT seq FROM items i WHERE source_type <> 'community'
  AND NOT EXISTS (SELECT 1 FROM {_RESEARCH} r WHERE r.category = i.category AND r.url = i.url AND r.url <> '')
  AND NOT EXISTS (SELECT 1 FROM {_RESEARCH} r WHERE r.category = i.category AND lower(r.title) = lower(i.title) AND r.title <> '')""")
def appendix_pool(s, sf):
    return joins.appendix(_pool(s, sf), _report_rows(s, sf)).select("seq")


@register("report_has_item", f"""WITH {ITEMS_SQL}, k AS (SELECT *, {_TKEY} AS t FROM items) SELECT seq FROM k i WHERE
  EXISTS (SELECT 1 FROM k r WHERE r.source_type = 'research' AND r.category = i.category AND r.url = i.url AND r.url <> '')
  OR EXISTS (SELECT 1 FROM k r WHERE r.source_type = 'research' AND r.category = i.category AND r.t = i.t AND r.t <> '')""")
def report_has_item(s, sf):
    return joins.report_has_item(_pool(s, sf), _report_rows(s, sf)).select("seq")


@register("not_selected", f"""WITH {ITEMS_SQL} SELECT category, seq, n AS sample_position FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS n
  FROM items i WHERE NOT EXISTS (SELECT 1 FROM {_RESEARCH} r WHERE r.category = i.category AND r.url = i.url)) WHERE n <= 12""")
def not_selected(s, sf):
    rows = items(s, sf)
    chosen = rows.filter("source_type = 'research'")
    return sel.not_selected(rows, chosen, 12, ["category"], "seq").select("category", "seq", "sample_position")


@register("merge_unique", f"""WITH {ITEMS_SQL}, m AS (SELECT 0 AS part, * FROM items WHERE source_type = 'research' UNION ALL SELECT 1 AS part, * FROM items)
SELECT category, seq FROM (SELECT *, row_number() OVER (PARTITION BY category, url ORDER BY part, seq) AS rn FROM m) WHERE rn = 1 AND url <> ''""")
def merge_unique(s, sf):
    rows = items(s, sf)
    out = dedup.merge_unique_items(rows.filter("source_type = 'research'"), rows, order=("seq",), by=["category"])
    return out.select("category", "seq")


@register("union_sources", """SELECT doc_id AS seq, 'documents' AS origin FROM documents UNION ALL
  SELECT 72057594037927936 + page_id, 'pages' FROM pages""")
def union_sources(s, sf):
    docs = table(s, sf, "documents").select(c("doc_id").alias("seq"), F.lit("documents").alias("origin"))
    web = table(s, sf, "pages").select(c("page_id").alias("seq"), F.lit("pages").alias("origin"))
    out = payloads.union_sources(docs, web)
    return out.select((F.shiftleft(c("seq.source")[0].cast("bigint"), 56) + c("seq.pos")).alias("seq"), "origin")


register("placed_items", """SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place,
  row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS place_in_source FROM documents""")(
    lambda s, sf: order.numbered(
        order.numbered(table(s, sf, "documents").select("doc_id", "source", "n_chars"), [c("n_chars").desc(), c("doc_id")], "place"),
        [c("n_chars").desc(), c("doc_id")], "place_in_source", ["source"],
    ).select("doc_id", "place", "place_in_source")
)
register("best_before", """SELECT doc_id, max(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM documents""")(
    lambda s, sf: order.running_max(table(s, sf, "documents").select("doc_id", "source", "n_chars"), c("n_chars"), [c("doc_id")], "best", ["source"]).select("doc_id", "best")
)


# === aggregates ===================================================================================================


@register("source_mix", f"""WITH {ITEMS_SQL}, n AS (SELECT category, source_type, count(*) AS n, min(seq) AS f FROM items GROUP BY 1, 2)
SELECT category, string_agg(source_type || ' ' || n || ' 則', '、' ORDER BY n DESC, f) AS mix FROM n GROUP BY 1""")
def source_mix(s, sf):
    return aggregates.source_mix(items(s, sf), ["category"])


@register("hot_sources", f"""WITH {ITEMS_SQL}, n AS (SELECT category, source_name, count(*) AS n, min(seq) AS first_seen FROM items GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, first_seen, source_name) AS hot_rank FROM n) WHERE hot_rank <= 4""")
def hot_sources(s, sf):
    return aggregates.hot_sources(items(s, sf), 4, ["category"])


register("infer_now", f"WITH {ITEMS_SQL} SELECT category, {stamp('max(published_at)')} AS now FROM items GROUP BY 1")(
    lambda s, sf: aggregates.infer_now(raw_items(s, sf), ["category"])
)


@register("star_delta", """SELECT user_id AS repo, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND value > 90) = 0
  THEN count(*) FILTER (WHERE date_trunc('second', ts) >= (SELECT date_trunc('second', max(ts)) - INTERVAL 7 DAY FROM events)) END AS star_delta
  FROM events GROUP BY 1""")
def star_delta(s, sf):
    starred = F.when((c("event_type") == "error") & (c("value") > 90), None).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    since = F.date_trunc("second", c("now")) - F.expr("INTERVAL 7 DAYS")
    rows = _with_now(events(s, sf), s, sf).select(c("user_id").alias("repo"), starred.alias("starred_at"), since.alias("since"))
    return aggregates.star_delta(rows, c("since"))


@register("run_metrics", _DEDUP.replace("PARTITION BY tk", "PARTITION BY category, tk").replace("PARTITION BY gk", "PARTITION BY category, gk") + f""",
y AS (SELECT max(ts) AS now FROM events), rel AS (SELECT * FROM x WHERE {_RELEVANT}),
rec AS (SELECT * FROM d, y WHERE published_at >= now - INTERVAL 7 DAY), arc AS (SELECT * FROM d, y WHERE impact > 0 AND published_at >= now - INTERVAL 20 DAY)
SELECT category, (SELECT count(*) FROM items i WHERE i.category = z.category) AS raw_count, (SELECT count(*) FROM items i WHERE i.category = z.category) AS trimmed_count,
 (SELECT count(*) FROM items i WHERE i.category = z.category) - (SELECT count(*) FROM rel i WHERE i.category = z.category) AS irrelevant_dropped,
 (SELECT count(*) FROM d i WHERE i.category = z.category) AS ranked_count, (SELECT count(*) FROM rec i WHERE i.category = z.category) AS recent_count,
 (SELECT count(*) FROM arc i WHERE i.category = z.category) AS high_impact_archive_count,
 (SELECT count(*) FROM d i WHERE i.category = z.category AND published_at IS NULL) AS undated,
 (SELECT count(*) FROM d i WHERE i.category = z.category AND published_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rec r WHERE r.category = i.category AND r.url = i.url)) AS older_than_window,
 (SELECT count(*) FROM rec i WHERE i.category = z.category) AS history_or_limit_count
FROM (SELECT DISTINCT category FROM items) z""")
def run_metrics(s, sf):
    raw, now = items(s, sf), _clock(s, sf)
    ranked = dedup.dedup_items(it.drop_low_signal(it.require_title_url(raw), L), ["category"])
    recent = it.is_recent(7, now, require_date=True)
    archive = it.is_high_impact(now, 20, L)
    return aggregates.run_metrics(raw, ranked, recent, ["category"], relevant=it.is_relevant(L), recent=recent, archive=archive)


# === history ======================================================================================================

_EV = """m AS (SELECT max(ts) AS now FROM events),
h AS (SELECT event_type AS category, CAST(user_id AS VARCHAR) AS fingerprint, max(ts) AS seen_at, max(event_id) AS pos FROM events, m
  WHERE ts <= now - INTERVAL 12 HOUR GROUP BY 1, 2),
a AS (SELECT h.* FROM h, m WHERE now - seen_at <= INTERVAL 26 HOUR),
i AS (SELECT event_type AS category, CAST(user_id AS VARCHAR) AS fingerprint, event_id AS rank FROM events)"""
_FRESH = _EV + """,
z AS (SELECT i.*, row_number() OVER (PARTITION BY category, fingerprint ORDER BY rank) AS nth,
  EXISTS (SELECT 1 FROM a WHERE a.category = i.category AND a.fingerprint = i.fingerprint) AS known FROM i),
fr AS (SELECT category, fingerprint, rank, row_number() OVER (PARTITION BY category ORDER BY rank) AS fresh_position FROM z WHERE nth = 1 AND NOT known)"""


def _clock(s, sf):
    """Latest event time as a literal: the clock of a run is known before the run starts."""
    return F.lit(_now(s, sf).first()["now"]).cast("timestamp")


def _history(s, sf, now):
    old = events(s, sf).filter(c("ts") <= now - F.expr("INTERVAL 12 HOURS"))
    return old.groupBy(c("event_type").alias("category"), c("user_id").cast("string").alias("fingerprint")).agg(
        F.max("ts").alias("seen_at"), F.max("event_id").alias("pos")
    )


def _event_items(s, sf):
    return events(s, sf).select(c("event_type").alias("category"), c("user_id").cast("string").alias("fingerprint"), c("event_id").alias("rank"))


@register("history_table", """SELECT event_type AS category, CAST(user_id AS VARCHAR) AS fingerprint, max(event_id) AS pos FROM events
WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 12 HOURS GROUP BY 1, 2""")
def history_table(s, sf):
    """Two versions are written to the shared folder, the first with rows to repair; the newest is read."""
    store = HistoryTable(s, f"{checkpoint_root(s)}/history-{uuid.uuid4().hex}")
    rows = _history(s, sf, _clock(s, sf))
    store.write(rows.withColumn("category", F.lit(None).cast("string")))
    store.write(rows)
    return store.read().select("category", "fingerprint", "pos")


@register("run_output", f"""WITH {ITEMS_SQL} SELECT category, count(*) AS n, count(DISTINCT title) AS titles FROM items GROUP BY 1""")
def run_output(s, sf):
    """Items written as the output of a run, a repeated run replacing its own date, and read back."""
    path = f"{checkpoint_root(s)}/run-{uuid.uuid4().hex}"
    for day in ("2025-11-20", "2025-11-21", "2025-11-20"):
        write_run({"item": items(s, sf).select("category", "seq", "title")}, path, day)
    found = s.read.parquet(f"{path}/item").filter("run_date = '2025-11-20'")
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("titles"))


@register("bundle_items", """SELECT 'run-' || doc_id AS run_id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 3 = 0 THEN lang || ',' || source END AS tags,
  CASE WHEN doc_id % 2 = 0 THEN 'token' END AS keyword_match, doc_id % 5 = 0 AS signal, 'k' || (doc_id % 11) AS more, NULL AS rejected FROM documents
UNION ALL SELECT 'run-' || doc_id, NULL, NULL, NULL, NULL, NULL, '{"run_id": "run-' || doc_id || '", "ai_news": [' FROM documents WHERE doc_id % 50 = 7""")
def bundle_items(s, sf):
    """A landed bundle per document, some of them cut off, read back: items with their tags and metadata, and the rejects."""
    n = c("doc_id")
    more = F.to_json(F.struct(F.when(n % 2 == 0, "token").alias("keyword_match"), (n % 5 == 0).alias("recent_feature_signal"), _text("k", n % 11).alias("other")))
    story = F.struct(
        _line().alias("title"), F.when(n % 3 == 0, F.to_json(F.array("lang", "source"))).otherwise(F.when(n % 3 == 1, '"no list"')).alias("tags"), more.alias("metadata"))
    whole = F.to_json(F.struct(_text("run-", n).alias("run_id"), F.array(F.struct(story["title"].alias("title"), F.parse_json(story["tags"]).alias("tags"), F.parse_json(story["metadata"]).alias("metadata"))).alias("ai_news")))
    cut = F.when(n % 50 == 7, _text('{"run_id": "run-', n, '", "ai_news": ['))
    docs = spread(table(s, sf, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    path = f"{checkpoint_root(s)}/bundles-{uuid.uuid4().hex}"
    docs.select(F.explode(F.array_compact(F.array(whole, cut))).alias("value")).write.text(path)
    found = read_bundles(s, path, lines=True)
    items_ = found.items.select(
        "run_id", "title", F.array_join("tags", ",").alias("tags"), "keyword_match", c("recent_feature_signal").alias("signal"),
        F.try_variant_get("metadata", "$.other", "string").alias("more"), F.lit(None).cast("string").alias("rejected"),
    )
    nothing = {name: F.lit(None).cast(kind) for name, kind in (("title", "string"), ("tags", "string"), ("keyword_match", "string"), ("signal", "boolean"), ("more", "string"))}
    rejected = found.rejects.select(F.regexp_extract("text", r"run-\d+", 0).alias("run_id"), *[v.alias(k) for k, v in nothing.items()], c("text").alias("rejected"))
    return items_.unionByName(rejected)


@register("history_active", f"""WITH {_EV} SELECT category, fingerprint, pos FROM (SELECT *, row_number() OVER (PARTITION BY category
  ORDER BY seen_at DESC, pos DESC, fingerprint) AS n FROM a) WHERE n <= 2000""")
def history_active(s, sf):
    now = _clock(s, sf)
    return hist.active_history(_history(s, sf, now), now).select("category", "fingerprint", "pos")


@register("history_fresh", f"WITH {_FRESH} SELECT category, fingerprint, rank, fresh_position FROM fr WHERE fresh_position <= 25")
def history_fresh(s, sf):
    now = _clock(s, sf)
    active = hist.active_history(_history(s, sf, now), now, cap=None)
    return hist.filter_new(_event_items(s, sf), active, 25)[0].select("category", "fingerprint", "rank", "fresh_position")


@register("history_skipped", f"""WITH {_FRESH}, f AS (SELECT * FROM fr WHERE fresh_position <= 25),
k AS (SELECT category, count(*) AS fresh, CASE WHEN count(*) = 25 THEN max(rank) ELSE 9e18 END AS last FROM f GROUP BY 1)
SELECT i.category, coalesce(max(k.fresh), 0) AS fresh, count(*) - coalesce(max(k.fresh), 0) AS skipped FROM i LEFT JOIN k ON k.category = i.category
WHERE i.rank <= coalesce(k.last, 9e18) GROUP BY 1""")
def history_skipped(s, sf):
    now = _clock(s, sf)
    active = hist.active_history(_history(s, sf, now), now, cap=None)
    return hist.filter_new(_event_items(s, sf), active, 25)[1]


@register("history_fallback", f"""WITH {_FRESH}, f AS (SELECT * FROM fr WHERE category <> 'view' AND fresh_position <= 25)
SELECT category, rank FROM f UNION ALL SELECT category, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank) AS n FROM i
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.category = i.category)) WHERE n <= 25""")
def history_fallback(s, sf):
    now = _clock(s, sf)
    active = hist.active_history(_history(s, sf, now), now, cap=None)
    recent = _event_items(s, sf)
    fresh = hist.filter_new(recent, active, 25)[0].filter("category <> 'view'")
    return hist.all_seen_fallback(fresh, recent, 25).select("category", "rank")


@register("history_remember", f"""WITH {_FRESH}, u AS (SELECT category, fingerprint, seen_at, pos FROM a UNION ALL
  SELECT fr.category, fr.fingerprint, now AS seen_at, fr.rank AS pos FROM fr, m)
SELECT category, fingerprint, {stamp('seen_at')} AS seen_at, pos FROM (SELECT *, row_number() OVER (PARTITION BY category
  ORDER BY seen_at DESC, pos DESC, fingerprint) AS n FROM u) WHERE n <= 2000""")
def history_remember(s, sf):
    now = _clock(s, sf)
    return hist.remember(_history(s, sf, now), _event_items(s, sf), now).select("category", "fingerprint", "seen_at", "pos")


register("anti_history", f"WITH {_FRESH} SELECT category, rank FROM z WHERE NOT known")(
    lambda s, sf: hist.anti_history(
        _event_items(s, sf), hist.active_history(_history(s, sf, _clock(s, sf)), _clock(s, sf), cap=None)
    ).select("category", "rank")
)


# === briefs =======================================================================================================


def _rule_sql(rules, fields: dict[str, str], values: dict[str, str]) -> str:
    """The rule list as one CASE in SQL."""
    import re

    arms = []
    for rule in rules:
        tests = [
            f"{fields[f[1:]]} IN ({', '.join(q(t) for t in terms)})" if f.startswith("=") else has(fields[f], terms)
            for f, terms in rule.when
        ]
        pieces = [p for p in re.split(r"(\{\w+\})", rule.text) if p]
        shown = " || ".join(values[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else q(p) for p in pieces)
        arms.append(f"WHEN {' AND '.join(tests) or 'true'} THEN {shown}")
    return "CASE " + " ".join(arms) + " END"


def _sentence_sql(n: int) -> str:
    head = rstrip(f'substr("desc", 1, {n})')
    return f"({head} || CASE WHEN right({head}, 1) IN ('。', '.', '!', '?') THEN '' ELSE '。' END)"


_BRIEF = f"""WITH {ITEMS_SQL}, h AS (SELECT *, {_HEADLINE} AS headline FROM items),
p AS (SELECT *, lower(headline) AS hl, lower("desc") AS dl, lower(source_name || ' ' || headline) AS k FROM h),
b AS (SELECT *, {_LABEL} AS provider FROM p)"""


def _follow_sql(rules) -> str:
    # the follow-up looks at the whole title
    label = "CASE " + " ".join(
        f"WHEN {has("lower(source_name || ' ' || title)", t)} THEN {q(n)}" for n, t in lx.PROVIDER_LABELS
    ) + " ELSE source_name END"
    more = _rule_sql(rules, {"headline": "lower(title)", "source_type": "source_type"}, {"provider": f"({label})"})
    parts = "len([x FOR x IN regexp_split_to_array(insight, '[。！？!?]+') IF trim(x) <> ''])"
    return f"CASE WHEN {parts} < 2 OR length(insight) < 72 THEN insight || ' ' || ({more}) ELSE insight END"


_AI_SUMMARY = _rule_sql(
    brief.AI_SUMMARY_RULES,
    {"headline": "hl", "source_type": "source_type", "usable": "CASE WHEN \"desc\" <> '' AND NOT contains(dl, 'collected from') THEN 'yes' ELSE 'no' END"},
    {"headline": "headline", "extras": "''", "sentence": _sentence_sql(160)},
)
_AI_INSIGHT = _rule_sql(
    brief.AI_INSIGHT_RULES,
    {"headline": "hl", "body": "(hl || ' ' || dl)", "provider": "provider", "source_type": "source_type"},
    {"headline": "headline", "provider": "provider", "source": "source_name"},
)
_STOCK_SUMMARY = _rule_sql(
    brief.STOCK_SUMMARY_RULES,
    {"source_type": "source_type", "usable": "CASE WHEN length(\"desc\") >= 28 THEN 'yes' ELSE 'no' END"},
    {"headline": "headline", "sentence": _sentence_sql(180)},
)
_STOCK_INSIGHT = _rule_sql(brief.STOCK_INSIGHT_RULES, {"headline": "hl", "detail": "dl"}, {"source": "source_name"})


def _brief(kind: str):
    def run(s, sf):
        made = brief.brief_item(
            kind, c("title"), c("url"), c("desc"), c("source_name"), c("source_type"), c("published_at_raw")
        )
        rows = items(s, sf).withColumn("b", made)
        more = brief.with_follow_up(kind, c("b.title"), c("b.insight"), c("b.source_name"), c("b.source_type"))
        return rows.select("seq", "b.summary", "b.insight", more.alias("expanded"))

    return run


for _kind, _summary, _insight, _more in (
    ("ai", _AI_SUMMARY, _AI_INSIGHT, brief.AI_FOLLOW_UP_RULES), ("stock", _STOCK_SUMMARY, _STOCK_INSIGHT, brief.STOCK_FOLLOW_UP_RULES),
):
    register(
        f"brief_{_kind}",
        f"{_BRIEF}, o AS (SELECT *, {_summary} AS summary, {_insight} AS insight FROM b) "
        f"SELECT seq, summary, insight, {_follow_sql(_more)} AS expanded FROM o",
    )(_brief(_kind))


# === reports ======================================================================================================


def _news(s, sf):
    """All items as the ranked news of one report per language."""
    return items(s, sf).withColumns({"report_id": c("category"), "rank": c("seq")})


@register("fallback_ai", f"""{_BRIEF}, o AS (SELECT *, {_AI_SUMMARY} AS summary, {_AI_INSIGHT} AS insight,
  row_number() OVER (PARTITION BY category ORDER BY seq) AS position FROM b)
SELECT category AS report_id, position, title, summary, insight, source_name FROM o WHERE position <= 12""")
def fallback_ai(s, sf):
    return report.fallback_report(_news(s, sf), report.AI)[1].select("report_id", "position", "title", "summary", "insight", "source_name")


@register("fallback_header", f"""WITH {ITEMS_SQL}, n AS (SELECT category, source_name, count(*) AS n, min(seq) AS f FROM items GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, f) AS r FROM n)
SELECT category AS report_id, 'AI 技術前沿情報' AS title, '本輪共整理 ' || CAST(sum(n) AS BIGINT) || ' 則 AI 情報，主要來源涵蓋 ' ||
  string_agg(CASE WHEN r <= 4 THEN source_name END, '、' ORDER BY r) || '。 目前為本地合成模式，重點在保留來源脈絡與後續可追蹤性。' AS summary FROM h GROUP BY 1""")
def fallback_header(s, sf):
    return report.fallback_report(_news(s, sf), report.AI)[0].select("report_id", "title", "summary")


@register("fallback_stock", f"""WITH {ITEMS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS position FROM items)
SELECT category AS report_id, position, CASE WHEN "desc" = '' THEN '原始來源未提供摘要。' ELSE "desc" END AS summary,
  '來源屬於 ' || source_name || ' / ' || source_type || '。 目前是離線合成模式，建議將此則與最新財報、法說會或價格走勢交叉驗證。' AS insight
FROM o WHERE position <= 7""")
def fallback_stock(s, sf):
    return report.fallback_report(_news(s, sf), report.STOCK)[1].select("report_id", "position", "summary", "insight")


@register("collected_reports", f"""WITH {ITEMS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS position FROM items)
SELECT category AS report_id, string_agg(CAST(position AS VARCHAR) || ':' || source_name, ',' ORDER BY position) AS listed FROM o WHERE position <= 7 GROUP BY 1""")
def collected_reports(s, sf):
    nested = report.collect_report(*report.fallback_report(_news(s, sf), report.STOCK))
    each = F.transform("items", lambda i: F.concat(i["position"].cast("string"), F.lit(":"), i["source_name"]))
    return nested.select("report_id", F.array_join(each, ",").alias("listed"))


@register("prompt_requests", f"""WITH {ITEMS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS n FROM items)
SELECT category AS report_id, 'analyze_ai_tech' AS task, count(*) AS n_news, string_agg(source_name, ',' ORDER BY n) AS names FROM o WHERE n <= 24 GROUP BY 1""")
def prompt_requests(s, sf):
    out = report.prompt_requests(it.with_tags(_news(s, sf), L.priority), report.AI)
    body = F.from_json("request", "task STRING, news ARRAY<STRUCT<source_name: STRING>>")
    return out.withColumn("b", body).select(
        "report_id", c("b.task").alias("task"), F.size("b.news").cast("bigint").alias("n_news"), F.array_join("b.news.source_name", ",").alias("names")
    )


_TURN = "conv_id || '-' || turn"


@register("parsed_responses", f"""SELECT {_TURN} AS report_id, CAST(1 AS BIGINT) AS position, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS title,
  'https://example.com/' || conv_id AS url, role || ' two' AS insight, 'unknown' AS source_name, CAST(turn AS VARCHAR) AS summary
FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''""")
def parsed_responses(s, sf):
    item = F.struct(
        F.struct(c("text").alias("text")).alias("title"), F.concat(F.lit("https://example.com/"), c("conv_id").cast("string")).alias("url"),
        F.array(c("role"), F.lit("two")).alias("insight"), c("turn").alias("summary"),
    )
    bad = F.struct(F.struct(F.lit("no link").alias("text")).alias("title"), F.lit("N/A").alias("url"), F.array(F.lit("x"), F.lit("y")).alias("insight"), c("turn").alias("summary"))
    body = F.to_json(F.struct(F.struct(c("text").alias("content")).alias("summary"), F.array(item, bad).alias("items"), F.lit("o").alias("outlook")))
    rows = spread(table(s, sf, "conversations"), "conv_id").select(
        F.concat(c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string")).alias("report_id"),
        F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response"),
    )
    return report.parse_responses(rows, report.AI)[1].select("report_id", "position", "title", "url", "insight", "source_name", "summary")


@register("valid_report_urls", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://[^/?#]+')")
def valid_report_urls(s, sf):
    return it.drop_invalid_urls(table(s, sf, "pages")).select("page_id")


def _reports(s, sf, style=report.AI):
    # read many times below: made once
    news = durable(_news(s, sf))
    header, rows = report.fallback_report(news, style)
    return news, header, rows


def _keyed_sql(rows: str = "items") -> str:
    """Items with what the ordered walks compare: title key, content key, provider and display rank."""
    provider = "CASE " + " ".join(f"WHEN {has("lower(source_name || ' ' || title || ' ' || url)", t)} THEN {q(n)}" for n, t in lx.PROVIDER_KEYS) + " END"
    return f"SELECT *, {_TKEY} AS t, {_CONTENT} AS ck, {provider} AS pk, {_SHOWN} AS shown FROM {rows}"


def _case_sql(column: str, names) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(names)) + " END"


_NEWEST = "published_at DESC NULLS LAST, seq"
_MATCHES = "o.category = c.category AND (o.url = c.url OR (o.t <> '' AND o.t = c.t))"
# `keyed` are the items, `own` the rows of a report; the walks carry lists of what they have seen
_COVERAGE = f"""
c_type AS (SELECT category, seq, {_case_sql('source_type', lx.REQUIRED_TYPES)} AS ask FROM (
    SELECT *, row_number() OVER (PARTITION BY category, source_type ORDER BY {_NEWEST}) AS n FROM keyed WHERE source_type IN {lx.REQUIRED_TYPES}) c
  WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.category = c.category AND o.source_type = c.source_type)),
c_official AS (SELECT category, seq, 10 + n AS ask FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_NEWEST}) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY category, lower(trim(source_name)) ORDER BY {_NEWEST}) AS m FROM keyed
    WHERE source_type = 'official_news' AND trim(source_name) <> '') WHERE m = 1) c WHERE n <= 2 AND NOT EXISTS (SELECT 1 FROM own o WHERE {_MATCHES})),
c_provider AS (SELECT category, seq, 20 + {_case_sql('pk', [n for n, _ in lx.PROVIDER_KEYS])} AS ask FROM (
    SELECT *, row_number() OVER (PARTITION BY category, pk ORDER BY shown, {_NEWEST}) AS n FROM keyed WHERE pk IS NOT NULL) c
  WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.category = c.category AND o.pk = c.pk) AND NOT EXISTS (SELECT 1 FROM own o WHERE {_MATCHES})),
asked AS (SELECT k.category, k.seq, url, t, row_number() OVER (PARTITION BY k.category ORDER BY ask DESC) AS n
  FROM (SELECT * FROM c_type UNION ALL SELECT * FROM c_official UNION ALL SELECT * FROM c_provider) c JOIN keyed k ON k.seq = c.seq),
put(category, n, us, ts, taken) AS (
  SELECT category, 0, list(url), list(t), CAST([] AS BIGINT[]) FROM own GROUP BY category
  UNION ALL SELECT p.category, p.n + 1, CASE WHEN k THEN us ELSE list_append(us, url) END, CASE WHEN k THEN ts ELSE list_append(ts, t) END,
    CASE WHEN k THEN taken ELSE list_append(taken, seq) END
  FROM (SELECT put.*, x.url, x.t, x.seq, list_contains(put.us, x.url) OR (x.t <> '' AND list_contains(put.ts, x.t)) AS k
    FROM put JOIN asked x ON x.category = put.category AND x.n = put.n + 1) p),
front AS (SELECT category, unnest(taken) AS seq, -unnest(range(1, len(taken) + 1)) AS place FROM (SELECT category, arg_max(taken, n) AS taken FROM put GROUP BY category)),
line AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY place) AS m FROM (
  SELECT k.category, k.seq, k.title, k.url, k.ck, k.source_name, k.source_type, k.shown, k.published_at, f.place, false AS is_own FROM front f JOIN keyed k ON k.seq = f.seq
  UNION ALL SELECT category, seq, title, url, ck, source_name, source_type, shown, published_at, position, true FROM own)),
told(category, m, cs, us, kept) AS (
  SELECT DISTINCT category, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) FROM own
  UNION ALL SELECT p.category, p.m + 1, CASE WHEN k THEN list_append(cs, ck) ELSE cs END, CASE WHEN k THEN list_append(us, url) ELSE us END,
    CASE WHEN k THEN list_append(kept, p.m + 1) ELSE kept END
  FROM (SELECT told.*, x.ck, x.url, x.ck <> '' AND NOT list_contains(told.cs, x.ck) AND NOT list_contains(told.us, x.url) AS k
    FROM told JOIN line x ON x.category = told.category AND x.m = told.m + 1) p),
fin AS (SELECT l.*, row_number() OVER (PARTITION BY l.category ORDER BY shown, published_at DESC NULLS LAST, l.m) AS position
  FROM line l JOIN (SELECT category, unnest(arg_max(kept, m)) AS m FROM told GROUP BY category) USING (category, m) QUALIFY position <= 12)"""


def _hydrated_sql(rows: str) -> str:
    """Rows with source type and date of the last item at their address, where their own say nothing."""
    return f"""SELECT r.* REPLACE (CASE WHEN r.source_type IN ('', 'unknown') THEN coalesce(i.source_type, r.source_type) ELSE r.source_type END AS source_type,
    CASE WHEN coalesce(r.published_at_raw, '') = '' THEN coalesce(i.published_at_raw, r.published_at_raw) ELSE r.published_at_raw END AS published_at_raw,
    CASE WHEN coalesce(r.published_at_raw, '') = '' THEN coalesce(i.published_at, r.published_at) ELSE r.published_at END AS published_at)
  FROM {rows} r JOIN (SELECT category, url, max(seq) AS last FROM items GROUP BY ALL) u USING (category, url) JOIN items i ON i.seq = u.last"""


@register("coverage", f"""WITH RECURSIVE {ITEMS_SQL}, keyed AS ({_keyed_sql()}),
own AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS position FROM keyed QUALIFY position <= 12), {_COVERAGE}
SELECT category AS report_id, position, title, source_type FROM fin""")
def coverage(s, sf):
    news, _, rows = _reports(s, sf)
    return report.enforce_coverage(rows, news).select("report_id", "position", "title", "source_type")


@register("post_process_ai", f"""{_BRIEF.replace('WITH ', 'WITH RECURSIVE ', 1)}, told_of AS (SELECT seq, {_AI_INSIGHT} AS insight FROM b), keyed AS ({_keyed_sql()}),
first_rows AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS position FROM keyed QUALIFY position <= 12),
own AS (SELECT * REPLACE ({_SHOWN} AS shown) FROM ({_hydrated_sql('first_rows')})), {_COVERAGE},
done AS (SELECT fin.*, insight FROM fin JOIN told_of USING (seq))
SELECT category AS report_id, position, title, {_follow_sql(brief.AI_FOLLOW_UP_RULES)} AS insight FROM done""")
def post_process_ai(s, sf):
    news, _, rows = _reports(s, sf)
    return report.post_process(rows, news, report.AI).select("report_id", "position", "title", "insight")


def _backfill_rows(s, sf):
    news = durable(_news(s, sf))
    rows = report.fallback_report(news, report.STOCK)[1].filter("position <= 2")
    return news, rows


_BACKFILL = f"""k AS (SELECT *, {_TKEY} AS t, row_number() OVER (PARTITION BY category ORDER BY seq) AS n FROM items),
o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY published_at DESC NULLS LAST, seq) AS r FROM k i WHERE NOT EXISTS (
  SELECT 1 FROM k h WHERE h.n <= 2 AND h.category = i.category AND (h.url = i.url OR (h.t <> '' AND h.t = i.t)))),
w AS (SELECT category, r, seq, 3 AS position, [url] AS us, [t] AS ts FROM o WHERE r = 1
  UNION ALL SELECT w.category, x.r, x.seq, w.position + 1, list_append(w.us, x.url), list_append(w.ts, x.t) FROM w, LATERAL (
    SELECT o.* FROM o WHERE o.category = w.category AND o.r > w.r AND NOT list_contains(w.us, o.url) AND (o.t = '' OR NOT list_contains(w.ts, o.t))
    ORDER BY o.r LIMIT 1) x WHERE w.position < 7)"""


@register("stock_backfill", f"""WITH RECURSIVE {ITEMS_SQL}, {_BACKFILL}
SELECT category AS report_id, CAST(position AS BIGINT) AS position, seq FROM w""")
def stock_backfill(s, sf):
    news, rows = _backfill_rows(s, sf)
    free = it.drop_invalid_urls(joins.without_reported(news, rows))
    return sel.stock_backfill(rows, free, 7, ["report_id"], "rank").select("report_id", "position", "seq")


@register("post_process_stock", f"""{_BRIEF.replace('WITH ', 'WITH RECURSIVE ', 1)}, told_of AS (SELECT seq, {_STOCK_INSIGHT} AS insight FROM b), {_BACKFILL},
rows_ AS (SELECT i.*, n AS position, '來源屬於 ' || i.source_name || ' / ' || i.source_type || '。 目前是離線合成模式，建議將此則與最新財報、法說會或價格走勢交叉驗證。' AS insight
    FROM items i JOIN k USING (seq) WHERE n <= 2
  UNION ALL SELECT i.*, w.position, insight FROM w JOIN items i USING (seq) JOIN told_of USING (seq)),
done AS ({_hydrated_sql('rows_')})
SELECT category AS report_id, position, title, {_follow_sql(brief.STOCK_FOLLOW_UP_RULES)} AS insight FROM done""")
def post_process_stock(s, sf):
    news, rows = _backfill_rows(s, sf)
    return report.post_process(rows, news, report.STOCK).select("report_id", "position", "title", "insight")


# === rendering ====================================================================================================


@register("messages", f"""WITH {ITEMS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY category, {_CONTENT} ORDER BY seq) AS u FROM items WHERE {_CONTENT} <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS n, count(*) OVER (PARTITION BY category) AS total FROM k WHERE u = 1),
t AS (SELECT category, max(total) AS total, string_agg('----------------' || chr(10) || '**[' || title || '](' || url || ')**' ||
  CASE WHEN "desc" = '' THEN '' ELSE chr(10) || '• ' || CASE WHEN length("desc") > 90 THEN {rstrip('substr("desc", 1, 87)')} || '...' ELSE "desc" END END ||
  chr(10) || '> 💡 why', chr(10) ORDER BY n) AS body FROM o WHERE n <= 3 GROUP BY 1)
SELECT category AS report_id, substr('📌 **摘要**' || chr(10) || 'sum ' || category || chr(10) || body || chr(10) || 'next' || chr(10) || 'look' ||
  CASE WHEN total > 3 THEN chr(10) || chr(10) || '📎 其餘 ' || (total - 3) || ' 則延伸內容與來源細節請看 Notion。' ELSE '' END, 1, 4096) AS description FROM t""")
def messages(s, sf):
    rows = _news(s, sf).withColumns({"position": c("seq"), "summary": c("desc"), "insight": F.lit("why")})
    heads = rows.select("report_id").distinct().select(
        "report_id", F.concat(F.lit("sum "), "report_id").alias("summary"), F.lit("look").alias("outlook"), F.lit("next").alias("outlook_label")
    )
    return render.render_message(heads, rows, report.AI).select("report_id", "description")


def _block_rows(s, sf):
    rows = _news(s, sf).withColumns(
        {
            "position": c("seq").cast("int"), "is_primary": F.lit(True), "summary": F.when(c("source_type") == "news", "").otherwise(c("desc")),
            "insight": F.when(c("source_type") == "research", "").otherwise("why"),
        }
    )
    heads = rows.select("report_id").distinct().withColumns(
        {"summary": F.lit("s"), "outlook": F.lit("o"), "outlook_label": F.lit("l")}
    )
    return heads, rows


_BLOCKS = f"""WITH {ITEMS_SQL}, b AS (SELECT *, CASE WHEN source_type = 'news' THEN '' ELSE "desc" END AS s2 FROM items),
k AS (SELECT *, row_number() OVER (PARTITION BY category, {_CONTENT} ORDER BY seq) AS u FROM b WHERE {_CONTENT} <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS shown FROM k WHERE u = 1),
z AS (SELECT *, 3 + CASE WHEN s2 = '' THEN 0 ELSE 1 END AS n_blocks FROM o),
r AS (SELECT *, sum(n_blocks) OVER (PARTITION BY category ORDER BY shown) AS running FROM z)"""


@register("block_counts", f"{_BLOCKS} SELECT category AS report_id, CAST(5 + max(running) AS BIGINT) AS n, CAST(max(shown) AS BIGINT) AS stories FROM r WHERE running + 5 <= 100 GROUP BY 1")
def block_counts(s, sf):
    heads, rows = _block_rows(s, sf)
    out = render.render_blocks(heads, rows.select(*report.ITEM_COLUMNS), report.AI)
    return out.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("type") == "heading_3").alias("stories"))


@register("block_headings", f"""{_BLOCKS} SELECT category AS report_id, CAST(4 + running - n_blocks AS BIGINT) AS pos, title AS text FROM r WHERE running + 5 <= 100""")
def block_headings(s, sf):
    heads, rows = _block_rows(s, sf)
    out = render.render_blocks(heads, rows.select(*report.ITEM_COLUMNS), report.AI)
    return out.filter("type = 'heading_3'").select("report_id", "pos", "text")


# === quotes =======================================================================================================


def _bars(s, sf):
    return events(s, sf).select(
        c("user_id").cast("string").alias("symbol"), "ts", c("value").alias("open"), (c("value") - 1).alias("low"), (c("value") * 2).alias("high"),
        (c("value") + 1).alias("close"),
    )


_DAYS = """WITH d AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS day, min_by(value, ts) AS open, max_by(value, ts) + 1 AS close
  FROM events GROUP BY 1, 2), p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS prev, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS n FROM d)"""


@register("quotes_from_bars", f"{_DAYS} SELECT symbol, round(close, 2) AS price, round(close - coalesce(prev, close), 2) AS change, round(open - 1, 2) AS low FROM p WHERE n = 1")
def quotes_from_bars(s, sf):
    return qt.quotes_from_bars(_bars(s, sf)).select("symbol", "price", "change", "low")


@register("quotes_from_exchange", """SELECT CAST(event_id AS VARCHAR) AS symbol, round(value, 2) AS price, round(value - 1, 2) AS change, round(value, 2) AS high
  FROM events WHERE round(value, 2) > 0""")
def quotes_from_exchange(s, sf):
    body = F.concat(
        F.lit('{"msgArray":[{"z":"'), F.format_string("%.2f", "value"), F.lit('","y":"1.0","l":"-","h":"","o":"2"}]}')
    )
    rows = events(s, sf).select(c("event_id").cast("string").alias("symbol"), body.alias("payload"))
    return qt.quotes_from_exchange_json(rows).select("symbol", "price", "change", "high")


@register("quote_fallback", f"{_DAYS}, a AS (SELECT * FROM p WHERE n = 1 AND close > 50) SELECT symbol, CASE WHEN close > 50 THEN 'first' ELSE 'second' END AS source FROM p WHERE n = 1")
def quote_fallback(s, sf):
    both = qt.quotes_from_bars(_bars(s, sf))
    first = both.filter("close > 50").withColumn("source", F.lit("first"))
    return qt.quote_fallback(first, both.withColumn("source", F.lit("second"))).select("symbol", "source")


@register("quote_lines", r"""SELECT event_id, '**' || event_id || '**' || chr(10) || '現:' || regexp_replace(printf('%.2f', value), '\.00$', '') || ' | 變:+' ||
  regexp_replace(printf('%.2f', value), '\.00$', '') || chr(10) || '區:' || '0-' || regexp_replace(printf('%.2f', value), '\.00$', '') AS line FROM events""")
def quote_lines(s, sf):
    v = c("value")
    return events(s, sf).select("event_id", render.quote_text(c("event_id").cast("string"), v, v, F.lit(0.0), v).alias("line"))


register("safe_floats", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE), 0.0) AS x FROM events")(
    lambda s, sf: events(s, sf).select(
        "event_id", text.safe_float(F.when(c("event_type") == "error", "n/a").otherwise(c("user_id").cast("string"))).alias("x")
    )
)


# === landed pages =================================================================================================

_TEXT_SQL = r"""pt AS (SELECT page_id, url, replace(replace(replace(replace(array_to_string([trim(x, ' ' || chr(10) || chr(9) || chr(13)) FOR x IN
  string_split(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(1), 'g'), '<[^>]+>', chr(1), 'g'), chr(1))
  IF trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> ''], ' '), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS body FROM pages)"""


def _pages(s, sf):
    return spread(table(s, sf, "pages"), "page_id")


@register("page_texts", f"WITH {_TEXT_SQL} SELECT page_id, CAST(length(body) AS BIGINT) AS n, md5(body) AS digest FROM pt")
def page_texts(s, sf):
    nodes = html.read_pages(_pages(s, sf), ("page",))
    return nodes.select("page_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@register("static_pages", f"WITH {_TEXT_SQL} SELECT page_id, url, '[Official] note on ' || url AS title FROM pt WHERE {has("lower('note on ' || url || ' ' || substr(body, 1, 2000))", ('license', 'ungs', 'thble'))}")
def static_pages(s, sf):
    web = _pages(s, sf)
    curated = web.select("url").distinct().select(
        "url", F.lit("curated").alias("name"), F.concat(F.lit("note on "), c("url")).alias("title"), F.lit("d").alias("desc"),
        F.lit("2026-04-07").alias("published_at_raw"), F.array(F.lit("license"), F.lit("ungs"), F.lit("thble")).alias("keywords"),
    )
    return pages.static_pages(html.read_pages(web, ("page",)), curated).select("page_id", "url", "title")


@register("resolved_links", """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]+') || h AS link FROM (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS h FROM pages)) GROUP BY 1, 2""")
def resolved_links(s, sf):
    nodes = html.read_pages(_pages(s, sf), ("a",))
    return nodes.groupBy("page_id", urls.resolve_url(c("url"), c("href")).alias("link")).agg(F.count(F.lit(1)).alias("n"))


_BARE = r"regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', chr(1), 'g')"


@register("page_nodes", rf"""WITH b AS (SELECT page_id, {_BARE} AS x, html FROM pages),
tags AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)(<script[^>]*>).*?</script>|(<style[^>]*>).*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', '\1\2', 'g'), '<([a-z0-9]+)', 1)) AS tag FROM b),
texts AS (SELECT page_id, len([p FOR p IN string_split(regexp_replace(x, '<[^>]+>', chr(1), 'g'), chr(1)) IF trim(p, ' ' || chr(10) || chr(9) || chr(13)) <> '']) AS n FROM b)
SELECT page_id, tag, count(*) AS n, NULL AS first FROM tags GROUP BY 1, 2 UNION ALL SELECT page_id, '(text)', n, 0 FROM texts WHERE n > 0
UNION ALL SELECT page_id, '(in nav)', len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a ')), NULL FROM pages WHERE contains(html, '<nav>')""")
def page_nodes(s, sf):
    """Elements and texts of each page by tag, and the links within its navigation."""
    table_ = durable(nodes.node_table(_pages(s, sf)))
    elements = table_.filter("tag IS NOT NULL AND parent IS NOT NULL").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    texts = table_.filter("tag IS NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).withColumn("tag", F.lit("(text)"))
    inside = nodes.within(table_.filter("tag = 'a'").select("page_id", "pre", "last"), table_.filter("tag = 'nav'").select("page_id", "pre", "last"), "nav")
    inside = inside.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).withColumn("tag", F.lit("(in nav)"))
    none = F.lit(None).cast("long")
    return reduce(lambda a, b: a.unionByName(b), [
        elements.withColumn("first", none), texts.withColumn("first", F.lit(0).cast("long")), inside.withColumn("first", none)])


_EVENT_PAGE = "https://notes.example.com/log"


def _event_pages(s, sf, body):
    """One small page per event, all at one address as versions of one page."""
    rows = spread_rows(events(s, sf).select("event_id", "ts", "event_type"), "event_id")
    return rows.select(c("event_id").alias("page_id"), F.lit(_EVENT_PAGE).alias("url"), body.alias("html"), "ts", "event_type")


def _sources(s, **more):
    row = s.range(1).select(F.lit(_EVENT_PAGE).alias("url"), F.lit("Notes").alias("name"), F.array(F.lit("click"), F.lit("View"), F.lit("error")).alias("keywords"))
    for name, value in more.items():
        row = row.withColumn(name, value)
    return row


_KEPT = "event_type IN ('click', 'view', 'error')"


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@register("listing_anchors", f"""SELECT event_id AS page_id, '[Official] Long headline of ' || event_type || ' ' || event_id AS title,
  'https://notes.example.com/news/' || event_id AS url, strftime(ts, '%Y-%m-%dT00:00:00+00:00') AS published FROM events WHERE {_KEPT}""")
def listing_anchors(s, sf):
    n, kind = c("event_id"), c("event_type")
    link = _text('<a href="/news/', n, '">Long headline of ', kind, " ", n, "</a>")
    body = _text(
        "<html><body><div>", link, "<p>", F.date_format("ts", "MMM dd, yyyy"), '</p></div><div><a href="/news/short">', kind,
        '</a></div><section><div><span><i><a href="/news/x">Undated headline of ', kind, "</a></i></span></div></section>",
    )
    nodes = html.read_pages(_event_pages(s, sf, body), ("a",))
    out = pages.listing_anchors(nodes, _sources(s, link_prefixes=F.array(F.lit("/news/"))))
    return out.select("page_id", "title", "url", c("published_at_raw").alias("published"))


@register("dated_sections", f"""SELECT event_id AS page_id, '{_EVENT_PAGE}#d' || event_id AS url, '[Official] Notes ' || strftime(ts, '%B %-d, %Y') || ': Now with ' || event_type || ' tool' AS title,
  strftime(ts, '%Y-%m-%dT00:00:00+00:00') AS published FROM events WHERE {_KEPT} UNION ALL
SELECT event_id, 'https://notes.example.com/docs/' || event_id, '[Official] Notes ' || strftime(ts, '%B %-d, %Y') || ': A whole guide to ' || event_type || ' agents',
  strftime(ts, '%Y-%m-%dT00:00:00+00:00') FROM events WHERE {_KEPT}""")
def dated_sections(s, sf):
    n, kind = c("event_id"), c("event_type")
    body = _text(
        '<h3 id="d', n, '">', F.date_format("ts", "MMMM d, yyyy"), "</h3><ul><li>Now with ", kind, " tool</li><li>Minor cleanup</li></ul>",
        '<p><a href="/docs/', n, '">A whole guide to ', kind, " agents</a></p>",
    )
    out = pages.dated_sections(html.read_pages(_event_pages(s, sf, body), ("a", "li")), _sources(s))
    return out.select("page_id", "url", "title", c("published_at_raw").alias("published"))


@register("section_bullets", f"""SELECT event_id AS page_id, '/docs/' || event_id AS href, 'd' || event_id AS heading_id, strftime(ts, '%B %-d, %Y') AS heading_text, 'Now with ' || event_type || ' tool' AS text FROM events
UNION ALL SELECT event_id, NULL, 'd' || event_id, strftime(ts, '%B %-d, %Y'), 'Minor cleanup' FROM events""")
def section_bullets(s, sf):
    """Bullets below headings, from the node table of one small page per event; other lists do not count."""
    n, kind = c("event_id"), c("event_type")
    body = _text(
        "<ul><li>before any heading</li></ul><h3 id='d", n, "'>", F.date_format("ts", "MMMM d, yyyy"), "</h3><p>text</p><ul><li>Now with <a href='/docs/", n, "'>", kind,
        "</a> tool</li></ul><div><ol><li>no sibling of the heading</li></ol></div><ol><li>Minor <b>cleanup</b></li></ol>",
    )
    found = nodes.section_bullets(durable(nodes.node_table(_event_pages(s, sf, body))))
    return found.select("page_id", "href", "heading_id", "heading_text", "text")


@register("release_notes", f"""SELECT event_id AS page_id, 'https://hint.example.com/' AS url, '[Official] Notes 2.1.' || event_id || ': New ' || event_type || ' mode' AS title,
  strftime(ts, '%Y-%m-%dT00:00:00+00:00') AS published FROM events WHERE {_KEPT} UNION ALL
SELECT event_id, '{_EVENT_PAGE}#v' || event_id, '[Official] Notes 2.1.' || event_id || ': All about ' || event_type,
  strftime(ts, '%Y-%m-%dT00:00:00+00:00') FROM events WHERE {_KEPT}""")
def release_notes(s, sf):
    n, kind = c("event_id"), c("event_type")
    body = _text(
        '<h2 id="v', n, '">2.1.', n, "</h2><p>", F.date_format("ts", "MMMM d, yyyy"), "</p><ul><li>New ", kind, " mode</li></ul><p>All about ", kind, "</p>",
    )
    hints = F.array(F.struct(F.lit("mode").alias("keyword"), F.lit("https://hint.example.com/").alias("url")))
    nodes = html.read_pages(_event_pages(s, sf, body), ("li", "p"))
    out = pages.docs_release_notes(nodes, _sources(s, link_hints=hints))
    return out.select("page_id", "url", "title", c("published_at_raw").alias("published"))


@register("changelog_cards", f"""SELECT event_id AS page_id, '[Official] Notes | ' || strftime(ts, '%b %-d') || ' | Feature: Added ' || event_type AS title,
  (CASE WHEN month(ts) > 5 THEN '2025' ELSE '2026' END) || strftime(ts, '-%m-%dT00:00:00+00:00') AS published FROM events WHERE {_KEPT} UNION ALL
SELECT event_id, '[Official] Notes | Dec 11 | Fix: Repaired ' || event_type, CASE WHEN month(ts) = 12 THEN '2025' WHEN month(ts) > 5 THEN '2024' ELSE '2025' END || '-12-11T00:00:00+00:00'
FROM events WHERE {_KEPT}""")
def changelog_cards(s, sf):
    kind = c("event_type")

    def card(day, label, said, link):
        return _text(
            '<div class="grid grid-cols-[3rem_1fr] gap"><div><div data-variant="outline">', day, '</div></div><div><div data-variant="soft">', label,
            '</div><div class="_Text _ChangelogMarkdown"><p>', said, kind, '</p><a href="/', link, '"></a></div></div></div>',
        )

    body = F.concat(card(F.date_format("ts", "MMM d"), "Feature", "Added ", "a"), card("Dec 11", "Fix", "Repaired ", "b"))
    nodes = html.read_pages(_event_pages(s, sf, body), ("card",))
    now = F.to_timestamp(F.lit("2026-04-12 00:00:00"))
    out = pages.changelog_cards(nodes, _sources(s), now)
    return out.select("page_id", "title", c("published_at_raw").alias("published"))


# === landed responses =============================================================================================


def _responses(s, sf, body):
    return table(s, sf, "documents").select(c("doc_id").alias("payload_order"), F.to_json(body).alias("payload"))


_FIRST = "split_part(text, chr(10), 1)"

def _line():
    return F.substring_index("text", "\n", 1)


def _shown(df, *columns):
    """Columns of a reader with the order key as one number, which SQL can write down; the driver tables hold no long responses."""
    return df.withColumn("seq", F.shiftleft("seq.payload", 20) + c("seq.pos")).select(*columns)


@register("news_articles", f"""SELECT doc_id << 20 AS seq, {_FIRST} AS title, 'https://n.example.com/' || doc_id AS url, text AS "desc", source AS source_name, 'news' AS source_type
  FROM documents WHERE {_FIRST} <> ''""")
def news_articles(s, sf):
    good = F.struct(
        _line().alias("title"), _text("https://n.example.com/", c("doc_id")).alias("url"), c("text").alias("description"),
        F.struct(c("source").alias("name")).alias("source"),
    )
    bad = F.struct(F.lit("").alias("title"), F.lit("https://n.example.com/").alias("url"), F.lit("").alias("description"), F.struct(F.lit("").alias("name")).alias("source"))
    out = payloads.news_articles(_responses(s, sf, F.struct(F.array(good, bad).alias("articles"))))
    return _shown(out, "seq", "title", "url", "desc", "source_name", "source_type")


@register("story_hits", f"""SELECT doc_id << 20 AS seq, '[HN] ' || {_FIRST} AS title, 'https://news.ycombinator.com/item?id=' || doc_id AS url, 'Points: ' || n_chars || ' | Comments: 0' AS "desc"
  FROM documents WHERE {_FIRST} <> ''""")
def story_hits(s, sf):
    hit = F.struct(_line().alias("title"), F.lit("").alias("url"), c("doc_id").cast("string").alias("objectID"), c("n_chars").alias("points"))
    return _shown(payloads.hn_hits(_responses(s, sf, F.struct(F.array(hit).alias("hits")))), "seq", "title", "url", "desc")


@register("trending_models", """SELECT doc_id << 20 AS seq, '[HF Model] ' || source || '/' || doc_id || ' (' || n_chars || ' likes)' AS title, 'Downloads: 0 | Task: ' || lang AS "desc",
  'model_release' AS source_type FROM documents""")
def trending_models(s, sf):
    data = F.struct(_text(c("source"), "/", c("doc_id")).alias("id"), c("n_chars").alias("likes"), c("lang").alias("pipeline_tag"))
    out = payloads.hf_models(_responses(s, sf, F.struct(F.array(F.struct(data.alias("repoData"))).alias("recentlyTrending"))))
    return _shown(out, "seq", "title", "desc", "source_type")


@register("daily_papers", f"""SELECT doc_id << 20 AS seq, '[HF Paper] ' || {_FIRST} AS title, 'Published: N/A | Summary: ' || substr(text, 1, 180) || '...' AS "desc" FROM documents WHERE {_FIRST} <> ''""")
def daily_papers(s, sf):
    paper = F.struct(c("doc_id").cast("string").alias("id"), _line().alias("title"), c("text").alias("summary"))
    return _shown(payloads.hf_papers(_responses(s, sf, F.array(F.struct(paper.alias("paper"))))), "seq", "title", "desc")


@register("repo_releases", f"""SELECT doc_id << 20 AS seq, '[GitHub Release] ' || source || ' r' || doc_id AS title, 'Tag: v1.' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN '.1' ELSE '' END || ' | Published: N/A | ' ||
  substr({norm("regexp_replace(replace('hotfix ' || text, '`', ''), '[*>#-]+', ' ', 'g')")}, 1, 180) || '...' AS "desc" FROM documents
  WHERE NOT (doc_id % 2 = 0 AND NOT {has('lower(text)', lx.PATCH_HIGH_SIGNAL)})""")
def repo_releases(s, sf):
    n = c("doc_id")
    tag = _text("v1.", n % 3, F.when(n % 2 == 0, ".1").otherwise(""))
    good = F.struct(_text("r", n).alias("name"), tag.alias("tag_name"), F.concat(F.lit("hotfix "), "text").alias("body"))
    later = F.struct(F.lit("old").alias("name"), F.lit("v0").alias("tag_name"), F.lit("old release").alias("body"))
    rows = table(s, sf, "documents").select(n.alias("payload_order"), c("source").alias("repo"), F.to_json(F.array(good, later)).alias("payload"))
    return _shown(payloads.repo_releases(rows), "seq", "title", "desc")


@register("repo_search", """WITH m AS (SELECT max(ts) - INTERVAL 7 DAY AS since FROM events), st AS (SELECT 'r' || user_id AS repo, count(*) FILTER (WHERE date_trunc('second', ts) >= date_trunc('second', since)) AS d FROM events, m GROUP BY 1),
f AS (SELECT 'r' || (doc_id % 150) AS repo, lang AS run, lang AS "desc", doc_id, n_chars FROM documents),
b AS (SELECT run, repo, min(doc_id) AS a, arg_min(n_chars, doc_id) AS stars FROM f GROUP BY 1, 2)
SELECT run, '[GitHub] ' || b.repo || ' (' || CASE WHEN coalesce(d, 0) > 0 THEN '+' || d || '★/7d, ' ELSE '' END || stars || ' stars)' AS title,
  row_number() OVER (PARTITION BY run ORDER BY coalesce(d, -1) DESC, stars DESC, a) - 1 AS seq FROM b LEFT JOIN st ON st.repo = b.repo""")
def repo_search(s, sf):
    repo = _text("r", c("doc_id") % 150)
    found = F.struct(
        repo.alias("full_name"), F.concat(F.lit("https://g.example.com/"), repo).alias("html_url"), c("n_chars").alias("stargazers_count"),
        c("lang").alias("description"),
    )
    rows = table(s, sf, "documents").select(
        c("doc_id").alias("payload_order"), c("lang").alias("run"), F.to_json(F.struct(F.array(found).alias("items"))).alias("payload")
    )
    stars = events(s, sf).select(_text("r", c("user_id")).alias("repo"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("starred_at"))
    since = F.date_trunc("second", _clock(s, sf)) - F.expr("INTERVAL 7 DAYS")
    return _shown(payloads.repo_search(rows, stars, since, ["run"]), "run", "title", "seq")


def _feed(s, sf, atom: bool = False):
    """One feed per event with six entries; the second has no title."""
    n, kind = c("event_id"), c("event_type")

    def entry(i):
        title = F.when(i == 2, "").otherwise(_text(kind, " story ", i))
        link = _text("https://f.example.com/", n % 500, "/", i)
        if atom:
            return _text(
                "<entry><title>", title, "</title><id>", link, "</id><summary>sum ", kind, "\nline</summary><published>", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                '</published><link href="', link, '" rel="alternate"/><author><name>A', i, "</name></author><author><name>B</name></author></entry>",
            )
        return _text(
            "<item><title>", title, "</title><link>", link, "</link><description>&lt;b&gt;sum&lt;/b&gt; ", kind, "</description><pubDate>",
            F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), "</pubDate></item>",
        )

    entries = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), entry), "")
    body = _text('<feed xmlns="http://www.w3.org/2005/Atom">', entries, "</feed>") if atom else _text("<rss><channel>", entries, "</channel></rss>")
    rows = spread_rows(events(s, sf).select("event_id", "ts", "event_type"), "event_id")
    return rows.select(n.alias("payload_order"), kind.alias("subreddit"), kind.alias("query"), kind.alias("source_id"), body.alias("payload"))


_FEED_ROWS = "SELECT event_id, event_type AS kind, ts, i FROM events, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i)"


@register("subreddit_top", f"""SELECT (event_id << 20) + i - 1 AS seq, '[Reddit r/' || kind || '] ' || kind || ' story ' || i AS title, 'RSS fallback | <b>sum</b> ' || kind || '...' AS "desc",
  strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS published_at_raw FROM ({_FEED_ROWS}) WHERE i <= 5 AND i <> 2""")
def subreddit_top(s, sf):
    return _shown(payloads.subreddit_top(_feed(s, sf)), "seq", "title", "desc", "published_at_raw")


@register("subreddit_search", f"""WITH f AS (SELECT *, 'https://f.example.com/' || (event_id % 500) || '/' || i AS url, (event_id << 20) + i - 1 AS seq FROM ({_FEED_ROWS}) WHERE i <= 3 AND i <> 2)
SELECT seq, url, kind AS keyword_match, 'Search match for ' || kind || ' | sum ' || kind || chr(10) || 'line...' AS "desc" FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM f) WHERE rn = 1""")
def subreddit_search(s, sf):
    return _shown(payloads.subreddit_search(_feed(s, sf, atom=True)), "seq", "url", "keyword_match", "desc")


@register("paper_entries", f"""SELECT (event_id << 20) + i - 1 AS seq, '[arXiv] ' || CASE WHEN i = 2 THEN '' ELSE kind || ' story ' || i END AS title,
  'Authors: A' || i || ', B | Published: ' || strftime(ts, '%Y-%m-%d') || ' | Abstract: sum ' || kind || ' line...' AS "desc" FROM ({_FEED_ROWS}) WHERE i <> 2""")
def paper_entries(s, sf):
    return _shown(payloads.arxiv_atom(_feed(s, sf, atom=True)), "seq", "title", "desc")


@register("official_feed", f"""WITH f AS (SELECT *, (event_id << 20) + i - 1 AS seq FROM ({_FEED_ROWS}) WHERE i <> 2 AND kind IN ('click', 'view'))
SELECT seq, '[Official] ' || kind || ' story ' || i AS title, 'sum ' || kind AS "desc", 'Feed ' || kind AS source_name, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS published_at_raw
FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) AS n FROM f) WHERE n <= 40""")
def official_feed(s, sf):
    dim = events(s, sf).select("event_type").distinct().select(
        c("event_type").alias("source_id"), F.concat(F.lit("Feed "), "event_type").alias("name"), F.array(F.lit("CLICK story"), F.lit("view story")).alias("keywords")
    )
    out = payloads.official_feed(_feed(s, sf), dim, 40)
    return _shown(out, "seq", "title", "desc", "source_name", "published_at_raw")


# === streams ======================================================================================================


def _stream(s, sf):
    schema = s.read.parquet(f"{sf}/events.parquet").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _run_stream(s, df, mode="append"):
    """Drain what is there into a table in the shared folder and read it back."""
    root = f"{checkpoint_root(s)}/streams/{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    query.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(df.schema).parquet(f"{root}/out")


@register("stream_dedup", "SELECT DISTINCT event_type, user_id FROM events")
def stream_dedup(s, sf):
    # a time to live above the span of the table: one row per key
    out = sd.stream_dedup(_stream(s, sf), ["event_type", "user_id"], "ts", "3650 days")
    return _run_stream(s, out.select("event_type", "user_id"))


@register("stream_first_sight", f"""WITH RECURSIVE e AS (SELECT DISTINCT event_type, user_id, ts FROM events),
w AS (SELECT event_type, user_id, min(ts) AS ts FROM e GROUP BY 1, 2 UNION ALL
  SELECT w.event_type, w.user_id, (SELECT min(e.ts) FROM e WHERE e.event_type = w.event_type AND e.user_id = w.user_id AND e.ts > w.ts + INTERVAL 26 HOUR) AS ts FROM w WHERE w.ts IS NOT NULL)
SELECT event_type, user_id, {stamp('ts')} AS ts FROM w WHERE ts IS NOT NULL""")
def stream_first_sight(s, sf):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, sd.STATE_PROVIDER)
    try:
        return _run_stream(s, sd.stream_first_sight(_stream(s, sf), ["event_type", "user_id"], "ts", 26))
    finally:
        s.conf.set(key, before)


@register("incremental_runs", """SELECT category, fingerprint FROM (SELECT category, fingerprint, row_number() OVER (PARTITION BY category ORDER BY r) AS n FROM (
  SELECT event_type AS category, CAST(user_id AS VARCHAR) AS fingerprint, min(event_id) AS r FROM events GROUP BY 1, 2)) WHERE n <= 40""")
def incremental_runs(s, sf):
    root = f"{checkpoint_root(s)}/runs/{uuid.uuid4().hex}"
    history = HistoryTable(s, f"{root}/history")

    def rank(batch):
        return batch.select(c("event_type").alias("category"), c("user_id").cast("string").alias("fingerprint"), c("event_id").alias("rank"))

    runs.start_runs(_stream(s, sf), rank, history, f"{root}/fresh", f"{root}/state", 40, lambda _: F.to_timestamp(F.lit("2024-02-01"))).awaitTermination()
    return s.read.option("basePath", f"{root}/fresh").parquet(f"{root}/fresh/epoch=*").select("category", "fingerprint")


def _epochs_sql(runs_: int = 4, limit: int = 25) -> str:
    """Run after run: what is active, the first unseen rows, what is remembered."""
    parts = [f"""h0 AS (SELECT event_type AS category, CAST(user_id AS VARCHAR) AS fingerprint, CAST(-10 AS BIGINT) AS seen FROM events WHERE user_id % 7 = 0 GROUP BY ALL)"""]
    for k in range(runs_):
        parts.append(f"""a{k} AS (SELECT * FROM h{k} WHERE {10 * k} - seen <= 26),
f{k} AS (SELECT {k} AS epoch, category, fingerprint, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank) AS n FROM (
    SELECT event_type AS category, CAST(user_id AS VARCHAR) AS fingerprint, min(event_id) AS rank FROM events WHERE event_id % {runs_} = {k} GROUP BY ALL) i
  WHERE NOT EXISTS (SELECT 1 FROM a{k} a WHERE a.category = i.category AND a.fingerprint = i.fingerprint)) WHERE n <= {limit}),
h{k + 1} AS (SELECT * FROM a{k} UNION ALL SELECT category, fingerprint, {10 * k} FROM f{k})""")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(f'SELECT * FROM f{k}' for k in range(runs_))}"


@register("incremental_epochs", _epochs_sql())
def incremental_epochs(s, sf):
    """Four scheduled runs, ten hours apart, over a history which another job began; the third fails once and is repeated."""
    root = f"{checkpoint_root(s)}/runs/{uuid.uuid4().hex}"
    history = HistoryTable(s, f"{root}/history", buckets=8)
    start = F.to_timestamp(F.lit("2024-02-01"))
    rows = events(s, sf).select(c("event_type").alias("category"), c("user_id").cast("string").alias("fingerprint"), c("event_id").alias("rank"))
    older = rows.filter(c("fingerprint").cast("long") % 7 == 0).select("category", "fingerprint").distinct()
    history.write(older.withColumns({"seen_at": start - F.expr("INTERVAL 10 HOURS"), "pos": F.lit(0).cast("bigint")}))
    broken = []
    for k in range(4):
        rows.filter(c("rank") % 4 == k).write.mode("append").parquet(f"{root}/landed")

        def rank(batch, k=k):
            if k == 2 and not broken:
                broken.append(k)
                raise RuntimeError("lost on the way")
            return batch

        clock = start + F.expr(f"INTERVAL {10 * k} HOURS")
        for _ in range(2 if k == 2 else 1):
            stream = s.readStream.schema(rows.schema).parquet(f"{root}/landed")
            query = runs.start_runs(stream, rank, history, f"{root}/fresh", f"{root}/state", 25, lambda _, clock=clock: clock)
            try:
                query.awaitTermination()
            except StreamingQueryException:
                if k != 2:
                    raise
    found = s.read.option("basePath", f"{root}/fresh").parquet(f"{root}/fresh/epoch=*")
    return found.select(c("epoch").cast("bigint").alias("epoch"), "category", "fingerprint", "rank")


# === whole runs ===================================================================================================


def _all_runs(s, sf):
    from briefloom.plans.reports import Config, build_reports

    raw = raw_items(s, sf).withColumns(
        {"run_id": c("category"), "category": F.when(c("source_type") == "news", "stock_news").otherwise("ai_news")}
    )
    # every symbol, dealt over the runs; a run's quotes are those of one market watch list
    deal = F.get(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), F.pmod(F.xxhash64("symbol"), F.lit(4)).cast("int"))
    bars = qt.quotes_from_bars(_bars(s, sf)).withColumn("run_id", deal).withColumn("market", F.lit("us"))
    bars = bars.withColumn("seq", F.xxhash64("symbol"))
    config = Config(stock_lexicon=L, ai_lexicon=L, stock_days=20, ai_days=20)
    return build_reports(raw, bars, _clock(s, sf), config)


@register("run_messages")
def run_messages(s, sf):
    return _all_runs(s, sf)["message"].select("report_id", "title", "description", "color")


@register("run_blocks")
def run_blocks(s, sf):
    return _all_runs(s, sf)["block"].select("report_id", "pos", "type", "text", "link")
