"""Sharding by a k-d tree: split at weighted medians along the widest dimension until leaves hold the target bytes.

A row has integer coordinates, one per metadata dimension, and a tie-break, so that every dimension gives a total order of 62-bit
keys. The weighted median of a node is found by narrowing: the bytes of the node are summed in bins of the key range, the bin which
holds the middle is taken as the next range, until it holds one key. All nodes of a level narrow in the same jobs; a job is one
map-side combined aggregation, whatever key, source or group of copies is frequent. The driver holds a few numbers per node and bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from briefloom.llm.common import stored

COORDINATE_BITS, TIE_BITS = 23, 39
BINS_PER_JOB = 1 << 15


def number(value: Column) -> Column:
    """Order-preserving coordinate of a whole number: logarithmic, so that a few huge texts do not fill the range."""
    return F.floor(F.log2(F.greatest(value, F.lit(0)) + 1) * (1 << 17)).cast("long")


def category(value: Column) -> Column:
    """Coordinate of a name; equal names meet, null is a name of its own."""
    return F.shiftrightunsigned(F.xxhash64(value), 64 - COORDINATE_BITS)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows without their texts: size (UTF-8 bytes plus 1; null: 1), crc32 (null: of the empty text), coordinates and tie-break."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        *keep,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        number(F.octet_length(text)).alias("d0"),
        category(F.col("source")).alias("d1"),
        category(F.col("lang")).alias("d2"),
    ).withColumn(
        # copies of a text lie side by side: they part only where a median falls among them
        "tie", F.shiftleft(F.pmod("text_crc32", F.lit(1 << 19)), 20) + F.pmod(F.xxhash64(*keep), F.lit(1 << 20))
    )


def kd_shards(rows: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("d0", "d1", "d2")) -> DataFrame:
    """Add `shard` (0 to n - 1) to rows with `size`, `tie` and `dims`; give the number of shards or their target bytes.

    A node for k shards is split at k//2 : k - k//2 of its bytes, so sizes differ by about a row per level. Rows with equal keys
    cannot be parted. Empty input: no rows, no job after the first.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("size"), *[f(d) for d in dims for f in (F.min, F.max)]).first()
    if total[0] is None:
        return rows.withColumn("shard", F.lit(0))
    if n_shards is None:
        n_shards = max(1, -(-int(total[0]) // int(target_bytes)))
    spans = {d: max(1, total[2 + 2 * i] - total[1 + 2 * i]) for i, d in enumerate(dims)}
    placed = rows.withColumn("shard", F.lit(0))
    open_nodes, depth = ({0: n_shards} if n_shards > 1 else {}), 0
    while open_nodes:
        stats = placed.groupBy("shard").agg(F.sum("size").alias("size"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
        search = {}
        for r in stats.filter(F.col("shard").isin(list(open_nodes)) if len(open_nodes) < 1000 else F.lit(True)).collect():
            if r.shard in open_nodes:
                wide = max(dims, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / spans[d], -dims.index(d)))
                k = open_nodes[r.shard]
                search[r.shard] = [dims.index(wide), r[f"lo_{wide}"] << TIE_BITS, (r[f"hi_{wide}"] + 1) << TIE_BITS, r["size"] * (k // 2) / k]
        cuts = _medians(placed, search, dims)
        grown: dict[int, int] = {}
        steps = []
        for node, (dim, cut) in cuts.items():
            k = open_nodes[node]
            steps.append((node, dim, cut, node + k // 2))
            grown |= {n: m for n, m in ((node, k // 2), (node + k // 2, k - k // 2)) if m > 1}
        plan = spark.createDataFrame(steps, "node int, dim int, cut long, right int")
        # a row per open node: fewer than there are shards
        placed = placed.join(F.broadcast(plan), F.col("shard") == F.col("node"), "left").withColumn(
            "shard", F.when(_key(dims) >= F.col("cut"), F.col("right")).otherwise(F.col("shard"))
        ).select(*rows.columns, "shard")
        open_nodes, depth = grown, depth + 1
        if depth % 6 == 0:
            placed = stored(placed)
    return placed


def _key(dims: tuple[str, ...]) -> Column:
    return F.shiftleft(F.get(F.array(*dims), F.col("dim")), TIE_BITS) + F.col("tie")


def _medians(placed: DataFrame, search: dict[int, list], dims: tuple[str, ...]) -> dict[int, tuple[int, int]]:
    """For each node (dim, low, high, bytes wanted left) the first key of its right part."""
    done, spark = {}, placed.sparkSession
    while search:
        bins = max(2, BINS_PER_JOB // len(search))
        ranges = [(n, s[0], s[1], s[2], -(-(s[2] - s[1]) // bins)) for n, s in search.items()]
        ask = spark.createDataFrame(ranges, "node int, dim int, low long, high long, width long")
        key = _key(dims)
        found = (
            placed.join(F.broadcast(ask), F.col("shard") == F.col("node")).filter((key >= F.col("low")) & (key < F.col("high")))
            .groupBy("node", F.floor((key - F.col("low")) / F.col("width")).alias("bin"))
            .agg(F.sum("size").alias("size"), F.min(key).alias("first"), F.max(key).alias("last")).collect()
        )
        by_node: dict[int, list] = {}
        for r in found:
            by_node.setdefault(r.node, []).append(r)
        for node, own in by_node.items():
            dim, _, _, want = search.pop(node)
            own.sort(key=lambda r: r.first)
            for r in own:
                if r.size > want or r is own[-1]:
                    break
                want -= r.size
            if r.first == r.last:
                # one key: it goes to the side which leaves the smaller error
                done[node] = (dim, r.first if want * 2 < r.size else r.first + 1)
            else:
                search[node] = [dim, r.first, r.last + 1, want]
    return done


def slots(rows: DataFrame, order: list[str], by: str = "shard", rows_per_task: int = 50_000) -> DataFrame:
    """Number the rows of each shard from 0 without gaps. A shard is numbered in many parts; the counts of the parts are their offsets."""
    n = rows.count()
    parts = max(16, n // rows_per_task // 8)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = rows.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    at = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))
    return rows.withColumn("_at", at).join(offsets, [by, "_part"]).withColumn("slot", F.col("_from") + F.col("_at") - 1).drop("_part", "_at", "_from")
