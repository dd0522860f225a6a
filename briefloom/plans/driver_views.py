"""Views over the driver tables which stand in for landed items; each has the same form in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from briefloom.lexicon import Lexicon
from briefloom.operators import items as it

TYPES = ("official_news", "model_release", "research", "github_release", "github_repo", "news", "community", "unknown")
# terms which do occur in the invented prose
TERMS = Lexicon(
    priority=("license", "release", "token", "worthless", "keiten", "ouieré", "thble", "ción"),
    providers=("license", "release", "keiten", "thble"),
    named_events=("license",),
    high_impact=("token", "ouieré", "ness"),
    incident=("token", "worthless", "ungen"),
    incident_context=("the", "release", "der"),
    positive=("tion", "keit", "ment", "para"),
    negative=("worthless", "ouvi", "ischen"),
    promo=("release", "erbe"),
    promo_allow=("token", "license"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# rows of a small table which a task reads when a body of text is made of each
ROWS_PER_TASK = 25_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Row-heavy text work over a table which comes in fewer pieces than there are cores is worth one shuffle.

    The driver tables are single small files. A table with more splits than cores is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows in pieces of about `ROWS_PER_TASK`, for narrow rows out of which wide ones are made.

    Splits of a file say nothing about its rows: a row group is read by one task, and packed columns hold millions of rows of a few
    bytes. So the pieces are counted in rows (file footers), and a task has as many of them whatever the table's size.
    """
    pieces = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(max(pieces, df.sparkSession.sparkContext.defaultParallelism), key)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def raw_items(spark: SparkSession, sf: str, prepare: Callable[[DataFrame], DataFrame] = lambda docs: docs) -> DataFrame:
    """Documents as raw items: first line is the title, the rest the description; dates come in several formats.

    `prepare` works on the texts (title, desc) of each row where they are read: what it cuts off is not shuffled.
    """
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.instr("text", "\n") > 0, F.substring(F.col("text"), F.instr("text", "\n") + 1, F.length("text"))).otherwise("").alias("desc"),
    )
    docs = spread(prepare(docs), "doc_id")
    times = events(spark, sf).select((F.col("event_id") / 5).alias("at"), "ts").filter(F.col("at") == F.floor("at"))
    times = times.select(F.col("at").cast("bigint").alias("doc_id"), "ts")
    kind = F.pmod(F.col("doc_id"), F.lit(5))
    published = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == 3, F.date_format("ts", "MMMM d, yyyy"))
    )
    n = F.pmod(F.col("doc_id"), F.lit(4))
    tail = F.when(n == 0, "?utm_source=feed&page=2").when(n == 1, "/").when(n == 2, "/?ref=x#top").otherwise("")
    url = F.concat(
        F.lit("HTTPS://"), "source", F.lit(".Example.com/"), "lang", F.lit("/"),
        F.pmod(F.col("doc_id"), F.lit(700)).cast("string"), tail,
    )
    number = F.substring("source", 4, 10).cast("int")
    return docs.join(times, "doc_id", "left").select(
        F.col("doc_id").alias("seq"),
        F.col("lang").alias("category"),
        "title",
        url.alias("url"),
        "desc",
        F.col("source").alias("source_name"),
        F.get(F.array(*[F.lit(t) for t in TYPES]), number % 8).alias("source_type"),
        published.alias("published_at_raw"),
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    return it.normalize_items(raw_items(spark, sf, it.trim_descriptions))


# --- the same in SQL ----------------------------------------------------------------------------------------------


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x0b\x1c-\x1f\x{{85}}\pZ]+', ' ', 'g'))"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '[\s\x0b\x1c-\x1f\x{{85}}\pZ]+$', '')"


def has(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t.lower())})" for t in terms) + ")"


def canon(u: str) -> str:
    """Canonical form of well-formed addresses whose query values need no escaping."""
    query = f"regexp_extract({u}, '\\?([^#]*)', 1)"
    kept = (
        f"array_to_string([p FOR p IN string_split({query}, '&') IF p <> '' AND NOT starts_with(p, 'utm_') "
        "AND string_split(p, '=')[1] NOT IN ('ref', 'source', 'si', 'fbclid', 'gclid')], '&')"
    )
    path = f"regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')"
    frag = f"regexp_extract({u}, '(#.*)$', 1)"
    return (
        f"(lower(regexp_extract({u}, '^[A-Za-z]+://[^/?#]+')) || CASE WHEN {path} = '' THEN '/' ELSE {path} END "
        f"|| CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END || {frag})"
    )


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def in_case(x: str, table_: dict, default) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table_.items())
    return f"CASE {x} {arms} ELSE {default} END"


_LIST = "[" + ", ".join(q(t) for t in TYPES) + "]"
RAW_SQL = f"""
raw AS (
  SELECT d.doc_id AS seq, d.lang AS category, split_part(d.text, chr(10), 1) AS title,
    'HTTPS://' || d.source || '.Example.com/' || d.lang || '/' || (d.doc_id % 700) ||
      CASE d.doc_id % 4 WHEN 0 THEN '?utm_source=feed&page=2' WHEN 1 THEN '/' WHEN 2 THEN '/?ref=x#top' ELSE '' END AS url,
    CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) ELSE '' END AS "desc",
    d.source AS source_name,
    {_LIST}[CAST(substr(d.source, 4) AS INT) % 8 + 1] AS source_type,
    CASE d.doc_id % 5 WHEN 0 THEN strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(e.ts, '%a, %d %b %Y %H:%M:%S GMT')
      WHEN 2 THEN strftime(e.ts, '%Y-%m-%d') WHEN 3 THEN strftime(e.ts, '%B %-d, %Y') END AS published_at_raw
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id * 5
)"""
TRIM = "CASE WHEN length(\"desc\") > 220 THEN " + rstrip('substr("desc", 1, 220)') + " || '...' ELSE \"desc\" END"
_FORMATS = "['%Y-%m-%dT%H:%M:%SZ', '%a, %d %b %Y %H:%M:%S GMT', '%Y-%m-%d', '%B %d, %Y']"
ITEMS_SQL = f"""{RAW_SQL},
items AS (
  SELECT seq, category, {norm('title')} AS title, {canon('url')} AS url, {norm(TRIM)} AS "desc", source_name, source_type,
    published_at_raw, try_strptime(published_at_raw, {_FORMATS}) AS published_at
  FROM raw
)"""
