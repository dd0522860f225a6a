"""Merkle manifest of a data set, with a proof for every row, by pointer jumping.

A row's leaf is a hash of its fields. The leaves of a group (a language, say) ascend by key and are hashed together in runs of eight,
the results again, until one is left: the subroot. The subroots of all groups, ordered by group, are the leaves of one more such tree.

A run is one aggregated row of eight digests at most, so every level is an aggregation of bounded groups, an eighth of the one before. A
node first holds the digests beside it in its run (a segment) and points to its parent. The table of nodes is then joined with itself:
a node appends the segment of the node it points to and takes over its pointer, so the distance to its ancestor doubles in every round
until all leaves reach the root. Where few enough ancestors are left, they are broadcast, as many leaves share each of them.

Odd input: null fields are hashed as `-`; a null group is the first group, a null key the first in its group; rows of equal keys are
ordered by their digests, and equal rows take neighbouring places; an empty table has no rows and no root. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from briefloom.llm.common import stored
from briefloom.llm.ordering import lookup, running

FAN = 8
# ancestors are broadcast up to so many bytes, else joined by a shuffle
BROADCAST_BYTES = 16 << 20
_ID = "struct<g:string,height:int,pos:bigint>"
_TOP = "2"  # above the names of all groups, which begin with 0 (null) or 1


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:`, and the value; whole numbers as decimals."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hash(digests: Column) -> Column:
    """Digest of an array of digests, which are hashed as hex texts."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), ""), 256))


def _runs(level: DataFrame) -> DataFrame:
    """level(g, n, pos, digest, tag) to a row per run: g, n, up (its number, the place of its parent) and members in order."""
    member = F.struct("pos", "digest", "tag")
    return (
        level.filter("n > 1").groupBy("g", "n", F.floor(F.col("pos") / FAN).alias("up"))
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
    )


def _climb(level: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """All runs of the trees whose leaves are `level`, and what remains of each tree: g, height, digest, tag."""
    empty = level.schema["tag"].dataType
    runs: list[DataFrame] = []
    left = level.filter("n = 1").select("g", F.lit(0).alias("height"), "digest", "tag")
    while most > 1:
        runs.append(stored(_runs(level)))
        level = runs[-1].select(
            "g", F.ceil(F.col("n") / FAN).alias("n"), F.col("up").alias("pos"), _hash(F.col("members.digest")).alias("digest"), F.lit(None).cast(empty).alias("tag")
        )
        left = left.unionByName(level.filter("n = 1").select("g", F.lit(len(runs)).alias("height"), "digest", "tag"))
        most = -(-most // FAN)
    return runs, left


def _beside(members: Column, i: Column) -> Column:
    """The digests of a run before and after place i, as one element of a segment."""
    def joined(part: Column) -> Column:
        return F.aggregate(part, F.lit(b""), lambda a, d: F.concat(a, d))

    digests = F.transform(members, lambda m: m["digest"])
    return F.struct(
        joined(F.slice(digests, F.lit(1), i)).alias("before"), joined(F.slice(digests, i + 2, F.greatest(F.size(members) - i - 1, F.lit(0)))).alias("after")
    )


def proofs(leaves: DataFrame) -> DataFrame:
    """leaves(g, key, digest, tag) to tag, digest, subroot, root, proof: a row per leaf.

    `g` is the name of the group (any text or null), `digest` binary, `tag` a struct which is carried along. `proof` has an element for
    each level from the leaf to the root: the digests of the run before and after the node on the way, joined (binary).
    """
    spark = leaves.sparkSession
    named = F.when(F.col("g").isNull(), "0").otherwise(F.concat(F.lit("1"), "g"))
    placed = stored(running(stored(leaves.withColumn("g", named)), [F.col("key"), F.col("digest")], ("g",)))
    sizes = stored(placed.groupBy("g").agg(F.max("position").alias("n")))
    n_groups, most = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    level = lookup(placed, "g", sizes).select("g", "n", (F.col("position") - 1).alias("pos"), "digest", "tag")
    runs, subroots = _climb(level, most or 0)
    subroots = stored(subroots)
    top = running(subroots, [F.col("g")], ())
    top = stored(top.select(F.lit(_TOP).alias("g"), F.lit(n_groups).cast("long").alias("n"), (F.col("position") - 1).alias("pos"), "digest",
                            F.struct("tag", F.col("g").alias("name"), "height").alias("tag")))
    top_runs, root = _climb(top, n_groups)
    root = stored(root)
    found = root.select("digest").head(1)
    if not found:
        return placed.select("tag", "digest", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"), _no_proof().alias("proof"))

    depth = len(runs)
    parts = []
    for height, level in enumerate(runs):
        m = F.col("m")
        is_root = (F.ceil(F.col("n") / FAN) == 1) & F.lit(n_groups == 1)
        parts.append(level.select("g", "n", "up", "members", F.posexplode("members").alias("i", "m")).select(
            "g", F.lit(height).alias("height"), m["pos"].alias("pos"), m["digest"].alias("digest"), m["tag"].alias("tag"),
            F.lit(None).cast("binary").alias("subroot"), F.array(_beside(F.col("members"), F.col("i"))).alias("proof"),
            F.when(~is_root, F.struct("g", F.lit(height + 1).alias("height"), F.col("up").alias("pos"))).alias("to"),
        ))
    for up, level in enumerate(top_runs):
        m = F.col("m")
        is_root = F.ceil(F.col("n") / FAN) == 1
        # a leaf of this tree is the subroot of a group and goes by its name
        own = F.struct(
            (F.lit(_TOP) if up else m["tag"]["name"]).alias("g"), (F.lit(depth + up) if up else m["tag"]["height"]).alias("height"),
            (m["pos"] if up else F.lit(0).cast("long")).alias("pos"),
        )
        parts.append(level.select("n", "up", "members", F.posexplode("members").alias("i", "m")).select(
            F.struct(own.alias("own"), m["digest"].alias("digest"), m["tag"]["tag"].alias("tag")).alias("x"), "up", "members", "i", "n").select(
            "x.own.g", "x.own.height", "x.own.pos", "x.digest", "x.tag",
            (F.col("x.digest") if not up else F.lit(None).cast("binary")).alias("subroot"), F.array(_beside(F.col("members"), F.col("i"))).alias("proof"),
            F.when(~is_root, F.struct(F.lit(_TOP).alias("g"), F.lit(depth + up + 1).alias("height"), F.col("up").alias("pos"))).alias("to"),
        ))
    # the root has nothing beside it; it is a leaf itself if there is but one
    alone = root.select(
        F.col("tag.name").alias("g"), "tag.height", F.lit(0).cast("long").alias("pos"), "digest", F.col("tag.tag").alias("tag"),
        F.col("digest").alias("subroot"), _no_proof().alias("proof"), F.lit(None).cast(_ID).alias("to"),
    )
    nodes = reduce(DataFrame.unionByName, [*parts, alone.filter("height = 0")])
    reached = _jump(stored(nodes), depth + len(top_runs))
    whole = F.lit(bytes(found[0].digest))
    return reached.filter("height = 0").select("tag", "digest", F.coalesce("subroot", whole).alias("subroot"), whole.alias("root"), "proof")


def _no_proof() -> Column:
    return F.array().cast("array<struct<before:binary,after:binary>>")


def _jump(nodes: DataFrame, longest: int) -> DataFrame:
    """Double the distance to the ancestor pointed at until no node points to one."""
    reach = 1
    while reach < longest:
        # who can be pointed at; `to` is null where the way ends below the root
        above = nodes.filter(F.col("height") >= reach)
        size = above.count() * (reach * (FAN - 1) * 32 + 100)
        right = above.select(
            F.struct("g", "height", "pos").alias("to"), F.col("proof").alias("_proof"), F.col("to").alias("_to"), F.col("subroot").alias("_subroot")
        )
        open_ = nodes.filter(F.col("to").isNotNull())
        met = open_.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, "to", "left").select(
            "g", "height", "pos", "digest", "tag", F.coalesce("subroot", "_subroot").alias("subroot"), F.concat("proof", "_proof").alias("proof"), F.col("_to").alias("to")
        )
        reach *= 2
        joined = nodes.filter(F.col("to").isNull()).unionByName(met)
        # inner nodes below the next distance are not asked again
        nodes = joined.filter((F.col("height") == 0) | (F.col("height") >= reach))
        nodes = stored(nodes) if reach < longest else nodes
    return nodes


def fold(digest: Column, proof: Column) -> Column:
    """The root which a leaf (hex text) and a proof lead to, as hex text."""
    return F.aggregate(proof, digest, lambda d, s: F.sha2(F.concat(F.lower(F.hex(s["before"])), d, F.lower(F.hex(s["after"]))), 256))


def proof_digest(proof: Column) -> Column:
    """Hash of all digests of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.lower(F.concat(F.hex(s["before"]), F.hex(s["after"])))), ""), 256)
