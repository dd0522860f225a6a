"""Arrival order as data: composite order keys, and places in an order given without a window over everything.

A key is a struct (source, payload, pos): the way to the source in nested unions, the place of the response among those of its source,
the place of the entry in its response. Structs compare field by field, so a response of any length and any number of sources keep
their order; `min_by`, windows and sorts take a key like a number.

Places come from a range partitioning. A part holds the end of one group, whole groups, and the start of another; a row's place is its
place in the part, less what other groups have before it there, plus what earlier parts hold of its own group. Only the first group of
a part continues, so there are fewer such carries than parts, whatever group is hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from briefloom.session import durable

KEY = "struct<source:array<int>,payload:bigint,pos:bigint>"
_ROW_BITS = 33  # of an id within its partition


def sequence(payload_order: Column, pos: Column) -> Column:
    """Order key of an entry among those of one source."""
    return F.struct(F.array().cast("array<int>").alias("source"), payload_order.cast("bigint").alias("payload"), pos.cast("bigint").alias("pos"))


def under(source: int, seq: Column, kind: T.DataType) -> Column:
    """The key of a row of part `source` of a union. Plain numbers are places in one response."""
    key = seq if isinstance(kind, T.StructType) else sequence(F.lit(0), seq)
    return F.struct(F.concat(F.array(F.lit(source)), key["source"]).alias("source"), key["payload"].alias("payload"), key["pos"].alias("pos"))


def earlier_is_more(seq: Column, kind: T.DataType) -> Column:
    """A value which is the greater the earlier `seq` is, for `max` and `max_by`: numbers, arrays of one length, and structs of them."""
    if isinstance(kind, T.StructType):
        return F.struct(*[earlier_is_more(seq[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.transform(seq, lambda x: earlier_is_more(x, kind.elementType))
    return -seq


def first_most(df: DataFrame, name: str = "seq") -> Column:
    return earlier_is_more(F.col(name), df.schema[name].dataType)


def _laid_out(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in range partitions of (by, order), with `_part` and `_at`, the place in it; kept in the shared folder."""
    placed = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    marked = durable(placed.withColumn("_id", F.monotonically_increasing_id()))
    return marked.withColumns({"_part": F.shiftright("_id", _ROW_BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}).drop("_id")


def _same(by: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by], F.col("l._part") == F.col("r._part"))


def _carried(parts: DataFrame, by: Sequence[str], total: Column, name: str) -> DataFrame:
    """parts(by, _part, …) to what earlier parts of the same group hold, where there is one: fewer rows than parts."""
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    many = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("_parts")).filter("_parts > 1")
    same = reduce(Column.__and__, [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by])
    open_ = parts.alias("l").join(many.alias("r"), same, "left_semi")
    return open_.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy("_part")) == 1).withColumn(
        name, total.over(earlier)).filter("not _first").select(*by, "_part", name)


def numbered(rows: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the place (0, 1, …) of each row in the given order, in all rows or in each group. Ties come in some order.

    Runs a job: rows are sorted into partitions and kept there. Without groups the rows move once; with groups they are joined with a
    row per group and part, which Spark broadcasts where groups are few.
    """
    laid = _laid_out(rows, by, order)
    columns = [f"l.{c}" for c in rows.columns]
    if not by:
        sizes = sorted(laid.groupBy("_part").agg(F.max("_at").alias("last")).collect())
        starts = accumulate((r["last"] + 1 for r in sizes), initial=0)
        offsets = rows.sparkSession.createDataFrame([(r["_part"], at) for r, at in zip(sizes, starts)], "_part bigint, _from bigint")
        # a row per partition
        return laid.alias("l").join(F.broadcast(offsets), "_part").select(*columns, (F.col("_from") + F.col("_at")).alias(name))
    parts = laid.groupBy(*by, "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    carry = _carried(parts, by, F.sum("_n"), "_from")
    starts = parts.alias("l").join(F.broadcast(carry.alias("r")), _same(by), "left").select(
        *[f"l.{b}" for b in by], "l._part", (F.coalesce("_from", F.lit(0)) - F.col("_low")).alias("_shift"))
    return laid.alias("l").join(starts.alias("r"), _same(by), "left").select(*columns, (F.col("_at") + F.col("_shift")).alias(name))


def running_max(rows: DataFrame, value: Column, order: Sequence[Column], name: str, by: Sequence[str]) -> DataFrame:
    """Add the greatest value of the rows before each in its group (null: none), for groups of any size."""
    laid = _laid_out(rows.withColumn("_value", value), by, order)
    before = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = laid.withColumn("_local", F.max("_value").over(before))
    parts = laid.groupBy(*by, "_part").agg(F.max("_value").alias("_most"))
    carry = _carried(parts, by, F.max("_most"), "_carry")
    # fewer rows than partitions
    joined = local.alias("l").join(F.broadcast(carry.alias("r")), _same(by), "left")
    wins = F.col("_local").isNull() | (F.col("_carry") > F.col("_local"))
    return joined.select(*[f"l.{c}" for c in rows.columns], F.when(wins, F.col("_carry")).otherwise(F.col("_local")).alias(name))


def with_order(landed: DataFrame, key: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """Add `payload_order` to landed responses: the place of their file among those of the source (`by`), in order of the file's name.

    Only the names are sorted; responses stay where they are unless Spark shuffles the join. Rows of one file share its place.
    """
    names = landed.select(*by, key).distinct()
    placed = numbered(names, [F.col(key)], "payload_order", by)
    if not by:
        return landed.join(placed, key)
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, key)])
    return landed.alias("a").join(placed.alias("b"), same).select("a.*", "b.payload_order")
