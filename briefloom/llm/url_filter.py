"""URL filter: host-suffix and path-prefix expressions of each URL meet the rules on a short hash, digests confirm, the longest rule wins.

All of it is built-in column functions. Rules may be many: they are joined, not looped over. A URL is expanded only to the shapes
(number of host labels, length of path) which occur among the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) rows with hash prefix, digest and rank. Rules without a host fit nothing and go; equal rules become one, block before allow.

    rank orders rules which fit one URL: longest text first, then longest host. It also tells the lengths and the verdict.
    """
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    blocks = (F.col("verdict") == "block").cast("long")
    rows = rules.select(host.alias("host"), path.alias("path"), blocks.alias("block")).filter("host <> ''").groupBy("host", "path").agg(F.max("block").alias("block"))
    length = (F.length("host") + F.length("path")).cast("long")
    return rows.select(
        F.substring(_digest(F.col("host"), F.col("path")), 1, 8).alias("short"),
        _digest(F.col("host"), F.col("path")).alias("digest"),
        (F.shiftleft(length, 32) + F.shiftleft(F.length("host").cast("long"), 1) + F.col("block")).alias("rank"),
        _labels(F.col("host")).alias("labels"),
        F.length("path").alias("path_length"),
    )


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per row of pages: key, host, path, rule (`host` and `path` of the rule that decided; else null), verdict.

    Repeated rows are judged each for itself. The shapes of the rules (few, whatever the number of rules) are read first.
    """
    ruled = prepared_rules(rules)
    shapes = [(r.labels, r.path_length) for r in ruled.select("labels", "path_length").distinct().collect()]
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    fits = [
        F.when(
            (_labels(F.col("host")) >= n) & (F.length("path") >= m),
            _digest(F.substring_index("host", ".", -n), F.substring(F.col("path"), F.lit(1), F.lit(m))),
        )
        for n, m in shapes
    ] or [F.lit(None).cast("string")]
    spread = rows.withColumn("_digest", F.explode(F.array_append(F.array_compact(F.array(*fits)), F.lit(""))))
    met = spread.join(ruled.select("short", "digest", "rank"), F.substring("_digest", 1, 8) == F.col("short"), "left")
    # rows of one URL come from one task, so they are reduced to one before the shuffle
    best = met.groupBy("_row", key, "host", "path").agg(F.max(F.when(F.col("_digest") == F.col("digest"), F.col("rank"))).alias("rank"))
    total, own = F.shiftright("rank", 32).cast("int"), F.pmod(F.shiftright("rank", 1), F.lit(1 << 31)).cast("int")
    return best.select(
        key, "host", "path",
        F.when(F.col("rank").isNotNull(), F.concat(F.right("host", own), F.left("path", total - own))).alias("rule"),
        F.when(F.col("rank").isNull(), F.lit(default)).when(F.col("rank") % 2 == 1, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
