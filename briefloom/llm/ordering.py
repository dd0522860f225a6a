"""Running positions and sums, and lookups by a key which may be hot; nothing is gathered in one task.

A group of any size is ordered by a range partitioning of all rows: a part holds the end of one group, whole groups, and the start of
another. Rows are numbered within their part and group; what the parts before hold of the group is its carry. Only the first group of a
part has one, so there are fewer carries than parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from briefloom.llm.common import stored

ROWS_PER_PART = 100_000
# a key with more than this share of the rows is hot; there are fewer than 1 / share of them
HOT_SHARE = 1e-3


def _same(a: str, b: str, names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def running(rows: DataFrame, order: list[Column], group: tuple[str, ...], sums: tuple[str, ...] = (), rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Add `position` (1, 2, … in each group) and, for each column of `sums`, its sum up to and with the row under the same name.

    `rows` should be a stored table: it is read three times. Rows equal in all of `order` come in any, but one, order. Null groups are groups.
    """
    n = rows.count()
    spark = rows.sparkSession
    parts = max(-(-n // rows_per_part), min(spark.sparkContext.defaultParallelism, -(-n // 1000)), 1)
    keyed = rows.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)], F.monotonically_increasing_id().alias("_row"))
    by = [f"_o{i}" for i in range(len(order))] + ["_row"]
    placed = stored(keyed.repartitionByRange(parts, *group, *by).withColumn("_part", F.spark_partition_id()))
    whole = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(*group, "_part", F.sum("_n").over(before).alias("_cn"), *[F.sum(s).over(before).alias(f"_c{s}") for s in sums])
    carry = carry.filter(F.col("_cn").isNotNull())
    inside = Window.partitionBy("_part", *group).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        *[c for c in rows.columns if c not in sums], "_part", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*by)).alias("_n"),
        *[F.sum(s).over(inside).alias(s) for s in sums],
    )
    # fewer rows than parts
    joined = local.alias("l").join(F.broadcast(carry.alias("c")), (F.col("l._part") == F.col("c._part")) & _same("l", "c", group), "left")
    zero = F.lit(0)
    return joined.select(
        *[F.col(f"l.{c}") for c in rows.columns if c not in sums],
        *[(F.col(f"l.{s}") + F.coalesce(F.col(f"c._c{s}"), zero)).alias(s) for s in sums],
        (F.col("l._n") + F.coalesce("_cn", zero)).alias("position"),
    )


def lookup(rows: DataFrame, key: str, facts: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """Left join of rows with `facts`, which has one row for each value of a column of the same name; a null key finds nothing.

    Facts of hot keys are broadcast (fewer than 1 / share), rows with them stay where they are; others are joined as usual. Rows without
    a key are not dealt by it. `rows` and `facts` should be stored tables.
    """
    many = F.col("count") > F.greatest(F.lit(1000), F.lit(share) * rows.count())
    hot = stored(rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(many).select(key))
    added = [c for c in facts.columns if c != key]
    none = rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in added])
    some = rows.filter(F.col(key).isNotNull())
    if hot.isEmpty():
        return none.unionByName(some.join(facts, key, "left"))
    hot_facts = facts.join(F.broadcast(hot), key, "left_semi")
    cool = some.join(F.broadcast(hot), key, "left_anti").join(facts, key, "left")
    return none.unionByName(some.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot_facts), key, "left")).unionByName(cool)
