"""Prefix trie of conversations; totals of all subtrees by parallel tree contraction.

A node is a distinct sequence of first turns. Its key is made of sums over the turns of hashes of (place, role, text), which a running
sum gives without walking along a conversation, however long. Nodes are then one aggregation of the (conversation, depth) rows.

Contraction alternates two steps on the nodes which are left. *Compress*: nodes with one child form chains; every one of them points to
its child, pointers are doubled by joins of the chain nodes with themselves until they leave the chain, and the node below the chain
moves up to where the chain hung. *Rake*: leaves are final and are added to their parents. All nodes left after compress are leaves or
have two children, so each round removes more than half of them, and there are as many rounds as the logarithm of the nodes, also for
one chain of all nodes. Contracted chains are expanded from the last round to the first: total = what was passed on the way to the node
pointed at + its total.

Odd input: null roles and texts are empty, null turns come first, equal turns in the order of role and text; repeated rows are turns of
their own; rows with a null conv_id belong to no conversation and are left out; an empty table has no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from briefloom.llm.common import stored
from briefloom.llm.ordering import lookup, running

_SUMS = ("s0", "s1", "s2", "s3")
_IDS_PER_PIECE = 1 << 13


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, …), content (a digest of role and text) and bytes (of the text): a slim row per turn.

    Only turns which share their number with another one of their conversation are sorted by role and text, so only these travel whole.
    """
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _text("role").alias("role"), _text("text").alias("text"))
    shared = stored(turns.groupBy("conv_id", "turn").count().filter("count > 1").select(F.struct("conv_id", "turn").alias("at"), F.lit(True).alias("tied")))
    if shared.isEmpty():
        turns = turns.withColumn("tied", F.lit(False))
    else:
        turns = lookup(turns.withColumn("at", F.struct("conv_id", "turn")), "at", shared)
    slim = turns.select(
        "conv_id", "turn", F.when(F.col("tied"), F.struct("role", "text")).alias("tie"),
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("content"), F.octet_length("text").cast("long").alias("bytes"),
    )
    placed = running(stored(slim), [F.col("turn"), F.col("tie")], ("conv_id",))
    return placed.select("conv_id", F.col("position").alias("place"), "content", "bytes")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """turns(conv_id, place, content, bytes) and conversations(conv_id), also those without turns, to a row per node.

    key, parent (its key), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    mixed = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("content")), 256)
    pieces = [F.conv(F.substring(mixed, 1 + 8 * i, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(_SUMS)]
    hashed = stored(turns.select("conv_id", "place", "bytes", *pieces))
    summed = running(hashed.select("*", *[F.col(s).alias(f"own_{s}") for s in _SUMS]), [F.col("place")], ("conv_id",), _SUMS)

    def key(depth: Column, sums: list[Column]) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))

    top = key(F.lit(0), [F.lit(0)] * len(_SUMS))
    steps = summed.select(
        "conv_id", F.col("position").alias("depth"), "bytes", key(F.col("position"), [F.col(s) for s in _SUMS]).alias("key"),
        key(F.col("position") - 1, [F.col(s) - F.col(f"own_{s}") for s in _SUMS]).alias("parent"),
    )
    start = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), top.alias("key"), F.lit(None).cast("binary").alias("parent"))
    steps = stored(steps.unionByName(start))
    nodes = stored(steps.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"),
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
    ))
    ends = _end_digests(steps.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key")))
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    weights = nodes.join(kids, "key", "left").select(
        "key", "parent", F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(weights, ["n_leaves", "saved_tokens"])
    above = lookup(nodes, "parent", nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    none = F.sha2(F.lit(""), 256)
    return above.join(kids, "key", "left").join(totals, "key").join(ends, "key", "left").select(
        "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """ends(conv_id, key) to key, ends_sha256: the hash of the ids of a key in ascending order, joined by commas.

    Ids are joined in pieces of a bounded span of ids. A key with many pieces has them streamed in order through one hash, which has no
    parallel form; the task holds one piece at a time.
    """
    import hashlib

    import pyarrow as pa

    span = F.floor(F.col("conv_id") / _IDS_PER_PIECE)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = stored(ends.groupBy("key", span.alias("span")).agg(ids.alias("ids")))
    counts = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"))
    long_keys = stored(counts.filter("n > 1").select("key"))

    def digest(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for k, x in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != at:
                    if at is not None:
                        done.append((at, state.hexdigest()))
                    at, state = k, hashlib.sha256(x.encode())
                else:
                    state.update(b"," + x.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array([d[0] for d in done], pa.binary()), "ends_sha256": pa.array([d[1] for d in done], pa.string())})
        if at is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([at], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    short = counts.filter("n = 1").select("key", F.sha2("ids", 256).alias("ends_sha256"))
    if long_keys.isEmpty():
        return short
    rest = pieces.join(long_keys, "key", "left_semi").repartition("key").sortWithinPartitions("key", "span").select("key", "ids")
    return short.unionByName(rest.mapInArrow(digest, "key binary, ends_sha256 string"))


# --- tree contraction ---------------------------------------------------------------------------------------------


def _plus(a: str, b: str, sums: list[str]) -> list[Column]:
    return [(F.col(f"{a}.{s}") + F.coalesce(F.col(f"{b}.{s}"), F.lit(0))).alias(s) for s in sums]


def _follow(chain: DataFrame, sums: list[str]) -> DataFrame:
    """chain(key, to, sums) to the same rows with `to` outside of the chain and what was passed on the way.

    Pointers are doubled. A row points to at most one other, and no two open rows to the same, so no key of these joins is hot.
    """
    state = stored(chain.withColumn("open", F.lit(True)))
    while True:
        ahead = state.select(F.col("key").alias("to"), F.col("to").alias("next"), "open", *sums)
        met = state.filter("open").alias("a").join(ahead.alias("b"), F.col("a.to") == F.col("b.to"), "left").select(
            "a.key", F.coalesce("b.next", "a.to").alias("to"), *_plus("a", "b", sums), F.coalesce("b.open", F.lit(False)).alias("open"))
        state = stored(state.filter("not open").select(*met.columns).unionByName(met))
        if state.filter("open").isEmpty():
            return state.drop("open")


def subtree_totals(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes(key, parent, sums) of a forest (null parent: a root) to key and the sums over its subtree, itself included."""
    left = stored(nodes.select("key", "parent", *sums))
    raked: list[DataFrame] = []
    chains: list[DataFrame] = []
    while not left.isEmpty():
        kids = left.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("kid"))
        seen = stored(left.join(kids, "key", "left"))
        chain = seen.filter("n = 1")
        rest = seen.filter("n is null or n > 1").drop("kid")
        moved = gains = None
        if not chain.isEmpty():
            chains.append(_follow(chain.select("key", F.col("kid").alias("to"), *sums), sums))
            # the top of a chain is nobody's only child
            tops = stored(chains[-1].join(chain.join(chain.select(F.col("kid").alias("key")), "key", "left_anti").select("key", "parent"), "key"))
            moved = tops.select(F.col("to").alias("key"), F.col("parent").alias("_up"), F.lit(True).alias("_moved"))
            gains = tops.select("parent", *sums)
            rest = rest.join(moved, "key", "left").withColumn("parent", F.when(F.col("_moved"), F.col("_up")).otherwise(F.col("parent"))).drop("_up", "_moved")
        rest = stored(rest) if moved is not None else rest
        leaves = rest.filter("n is null")
        raked.append(leaves.select("key", *sums))
        given = leaves.select("parent", *sums)
        given = (given if gains is None else given.unionByName(gains)).filter("parent is not null")
        given = given.groupBy(F.col("parent").alias("key")).agg(*[F.sum(s).alias(s) for s in sums])
        left = stored(rest.filter("n > 1").drop("n").alias("a").join(given.alias("b"), "key", "left").select("key", "a.parent", *_plus("a", "b", sums)))
        chains += [None] * (len(raked) - len(chains))  # a round without chains
    if not raked:
        return left.select("key", *sums)
    totals = raked[-1]
    for leaves, chain in zip(reversed([None, *raked[:-1]]), reversed(chains)):
        if chain is not None:
            totals = stored(totals)
            ends = totals.select(F.col("key").alias("to"), *[F.col(s).alias(f"_{s}") for s in sums])
            found = lookup(chain, "to", ends).select("key", *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in sums])
            totals = totals.unionByName(found)
        totals = totals if leaves is None else totals.unionByName(leaves)
    return totals
