"""De-duplication. Groups are reduced by aggregates with map-side combine, so a hot key never meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from briefloom import lexicon as lx
from briefloom.functions import keys, score
from briefloom.functions.text import text_or_empty
from briefloom.operators import items as it
from briefloom.operators import order as order_, rank as rk
from briefloom.session import durable


def quality() -> Column:
    """What makes one row of a group better: release rank, source score, longer description, later raw date."""
    c = F.col
    return F.struct(
        (-score.release_item_rank(c("title"))).alias("release"),
        score.source_quality_score(c("source_type")).alias("source"),
        F.length("desc").alias("length"),
        text_or_empty(c("published_at_raw")).alias("date"),
    )


def with_keys(items: DataFrame) -> DataFrame:
    """Add `title_index` (NULL for short titles) and `key0`, the key before titles are indexed."""
    c = F.col
    return items.withColumns(
        {
            "title_index": keys.title_index_key(c("title")),
            "key0": keys.item_key(
                c("title"), c("url"), c("source_name"), c("desc"), c("model_family_key"), c("release_family_key")
            ),
        }
    )


def _best_per_key(rows: DataFrame, by: Sequence[str], columns: list[str]) -> DataFrame:
    """Per group key: the best row, earliest first on ties, and the first arrival of the group."""
    return (
        rows.groupBy(*by, "group_key")
        .agg(F.max_by("_row", "_order").alias("_row"), F.min("_first").alias("position"))
        .select("_row.*", "position", "group_key")
        .select(*columns, "position", "group_key")
    )


def dedup_items(items: DataFrame, by: Sequence[str] = (), keep: str | None = None) -> DataFrame:
    """Keep the best row per story (set-based form).

    Rows with one long title share the key of the first of them. Each title is reduced on its own first, then titles
    with one key are reduced together: two aggregates, no join, no window.

    `keep` names a boolean column: other rows do not take part. They meet in one NULL group per task and go after
    the first aggregate. A filter before it would be pushed under the projections which made its inputs, and every
    text would be normalised a second time for it.
    """
    columns = [col for col in items.columns if col != keep]
    keyed = with_keys(items)
    unit = F.coalesce(F.concat(F.lit("t:"), F.col("title_index")), F.concat(F.lit("k:"), F.col("key0")))
    best = F.struct(quality().alias("q"), order_.first_most(items).alias("s"))
    if keep is not None:
        unit, best = F.when(F.col(keep), unit), F.when(F.col(keep), best)
    titles = (
        keyed.withColumns({"_unit": unit, "_order": best})
        .groupBy(*by, "_unit")
        .agg(
            F.max_by(F.struct(*columns), "_order").alias("_row"),
            F.max("_order").alias("_order"),
            F.min_by("key0", "seq").alias("group_key"),
            F.min("seq").alias("_first"),
        )
    )
    if keep is not None:
        titles = titles.filter(F.col("_order").isNotNull())
    return _best_per_key(titles, by, columns)


def _running_best(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per row the best quality among earlier members of its group (`_before`); a group of any size is many tasks."""
    # a probe looks at the rows before its own
    return order_.running_max(rows, F.when(~F.col("probe"), F.col("q")), [F.col("seq"), F.col("probe").desc()], "_before", [*by, "key"])


def dedup_items_exact(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keep the best row per story, replaying arrival order exactly.

    A long title joins the group of its first row *that wins*. Only titles whose rows carry several keys can differ
    from the set-based form. Their index entry depends on earlier rows alone, so repeating "assign, find winners,
    re-index" reaches the one fixed point: a round settles at least the earliest open title, mostly all of them. Each
    round is a few distributed jobs and cuts lineage by checkpoint.
    """
    by = list(by)
    columns = items.columns
    keyed = durable(with_keys(items).withColumns({"q": quality(), "_row": F.struct(*columns)}))
    titled = keyed.filter(F.col("title_index").isNotNull())
    mixed = (
        titled.groupBy(*by, "title_index")
        .agg(F.min("key0").alias("a"), F.max("key0").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select(*by, "title_index", F.lit(True).alias("mixed"))
    )
    slim = keyed.select(*by, "seq", "title_index", "key0", "q").join(mixed, [*by, "title_index"], "left")
    open_rows = slim.filter("mixed").drop("mixed")
    touched = open_rows.select(*by, "key0").distinct()
    fixed = slim.filter(F.col("mixed").isNull()).drop("mixed").join(touched, [*by, "key0"], "left_semi")
    open_rows, fixed = durable(open_rows), durable(fixed)

    index = durable(open_rows.groupBy(*by, "title_index").agg(F.min("seq").alias("i_seq"), F.min_by("key0", "seq").alias("i_key")))
    settled = False
    while not settled:
        placed = open_rows.join(index, [*by, "title_index"], "left").withColumn(
            "key", F.when(F.col("seq") > F.col("i_seq"), F.col("i_key")).otherwise(F.col("key0"))
        )
        no = F.lit(False).alias("probe")
        members = placed.select(*by, "key", "seq", "q", "title_index", "key0", no).unionByName(
            fixed.select(*by, F.col("key0").alias("key"), "seq", "q", "title_index", "key0", no)
        )
        # where would each row stand under its own key?
        probes = open_rows.select(*by, F.col("key0").alias("key"), "seq", "q", "title_index", "key0", F.lit(True).alias("probe"))
        seen = _running_best(members.unionByName(probes), by)
        wins = seen.filter(F.col("probe") & (F.col("_before").isNull() | (F.col("q") > F.col("_before"))))
        nxt = durable(
            wins.groupBy(*by, "title_index").agg(F.min("seq").alias("i_seq"), F.min_by("key0", "seq").alias("i_key"))
        )
        settled = nxt.exceptAll(index).isEmpty() and index.exceptAll(nxt).isEmpty()
        index = nxt

    final = keyed.join(index, [*by, "title_index"], "left").withColumns(
        {
            "group_key": F.when(F.col("seq") > F.col("i_seq"), F.col("i_key")).otherwise(F.col("key0")),
            "_order": F.struct("q", order_.first_most(items).alias("s")),
            "_first": F.col("seq"),
        }
    )
    return _best_per_key(final, by, columns)


def deduplicate_and_rank(
    raw: DataFrame,
    lexicon: lx.Lexicon = lx.AI,
    limit: int = 60,
    *,
    default_source_name: str = "unknown",
    default_source_type: str = "unknown",
    exact: bool = False,
    relevant_only: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Raw rows to the best `limit` items: normalise, filter, one row per story, rank.

    Tags, priority and scores are computed for the surviving rows only. `relevant_only` also drops what
    `items.is_relevant` rejects.
    """
    items = it.normalize_items(raw, default_source_name=default_source_name, default_source_type=default_source_type)
    body = F.col("_body")
    keep = it.has_title_url() & ~it.is_low_signal(lexicon, body=body)
    if relevant_only:
        keep = keep & it.is_relevant(lexicon, body=body)
    items = items.withColumn("_body", it.body_text()).withColumn("_keep", keep).drop("_body")
    if exact:
        winners = dedup_items_exact(items.filter("_keep").drop("_keep"), by)
    else:
        winners = dedup_items(items, by, keep="_keep")
    return rk.rank_items(it.with_tags(winners, lexicon.priority), limit, lexicon, by)


def first_per_key(df: DataFrame, key: str | Column, position: str, by: Sequence[str] = ()) -> DataFrame:
    """First row by position of each non-empty key."""
    key = F.col(key) if isinstance(key, str) else key
    return (
        df.withColumn("_key", key)
        .filter(F.coalesce(F.col("_key"), F.lit("")) != "")
        .groupBy(*by, "_key")
        .agg(F.min_by(F.struct(*df.columns), position).alias("_row"))
        .select("_row.*")
    )


def longest_per_url(df: DataFrame, order: Sequence[str] = ("seq",), by: Sequence[str] = ()) -> DataFrame:
    """Longest description of each address; the earliest (by `order`) on ties."""
    best = F.struct(F.length("desc").alias("n"), *[order_.first_most(df, c).alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*by, "url").agg(F.max_by(F.struct(*df.columns), best).alias("_row")).select("_row.*")


def merge_unique_items(*parts: DataFrame, order: Sequence[str] = ("rank",), by: Sequence[str] = ()) -> DataFrame:
    """Union in the given order; first row of each non-empty address. Adds `merge_order`."""
    numbered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = numbered[0]
    for part in numbered[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    union = union.withColumn("merge_order", F.struct("_part", *order)).drop("_part")
    return first_per_key(union, "url", "merge_order", by)
