"""N-gram Jaccard join: documents whose sets of word n-grams are at least `percent` % alike, as classes of connected documents.

The order of n-grams is rare first, by their exact number of documents:

1. A task turns its texts to sets of hashed n-grams. A set which the task has seen before is only noted as a copy. The hashes go, packed,
   to the bucket of their value.
2. A bucket counts the sets of each n-gram (copies from other tasks count once) and answers the slice it came from, only for n-grams
   of at least two sets. All others, most of them, cannot match and stand first in the rare-first order.
3. A slice knows now which n-grams are in the prefix of a document: the first n - ceil(n * percent / 100) + 1. Where no shared n-gram
   reaches the prefix the document has no partner. The rest keep their shared n-grams, all that an intersection can hold.
4. Prefix n-grams are joined with one representative document per n-gram; documents connected in this way are candidates of one
   another. Each group of candidates is cut into blocks, and each pair of blocks is verified once: length, position and suffix filters,
   then the exact intersections as matrix products.
5. Found links are reduced to a spanning star per block pair; components are made of these.

Hashes have 64 bits, of which a bucket keeps its number and 48 more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from briefloom.llm.common import WHITE, WordHasher, mix, powers, slices, stored, words
from briefloom.llm.components import connected, local_roots

WIDTH, PERCENT = 5, 80
BUCKET_BYTES = 12 << 20  # text behind one bucket of n-grams
SLICE_BYTES = 4 << 20
BLOCK = 1024  # documents of a candidate group which are verified against each other at once
_STRIDE = 0x9E3779B97F4A7C15


def ngram_sets(texts: list[bytes], hasher: WordHasher, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; fewer words: the whole sequence as one; no words: none."""
    buffer, starts, ends, bounds = words(texts, WHITE)
    hashes = hasher(buffer, starts, ends)
    weights = powers(0xD6E8FEB86659FD93, width + 1)[1:]
    n = max(0, len(hashes) - width + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams += hashes[k:n + k] * weights[k]
    grams = mix(grams)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a:b - width + 1]))
        else:
            out.append(mix((hashes[a:b] * weights[: b - a]).sum(keepdims=True) + np.uint64(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


_SENT = "bucket long, slice long, keys binary, sizes binary, body binary, nulls binary"
_ANSWER = "slice long, first binary, second binary, third binary, nulls binary"


def _send(buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, at = WordHasher(), set(), TaskContext.get().partitionId() << 32
        for part, texts in slices(batches, limit=SLICE_BYTES):
            sets = ngram_sets(texts, hasher, width)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            ids = part.column("doc_id")
            rows = [(-1 - at, at, b"".join(keys), np.array([len(s) for s in sets], "<u4").tobytes(), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes())]
            fresh = []
            for i, key in enumerate(keys):
                if len(sets[i]) and key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if fresh:
                grams = np.concatenate([sets[i] for i in fresh])
                docs = np.repeat(np.array(fresh, np.int64), [len(sets[i]) for i in fresh])
                bucket = ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for own in np.split(order, cuts[1:]):
                    doc, count = np.unique(docs[own], return_counts=True)
                    head = np.stack([doc, count], 1).astype("<u4").tobytes()
                    rows.append((int(bucket[own[0]]), at, b"".join([keys[d][:8] for d in doc]), head, _pack48(grams[own]), b""))
            at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64()] + [pa.binary()] * 4)], names=["bucket", "slice", "keys", "sizes", "body", "nulls"])

    return run


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """A bucket: n-grams of two sets or more, to the slices of their first copies. A slice's own row passes through."""
    bucket, out = key[0].as_py(), []
    if bucket < 0:
        out = [(r["slice"], r["keys"], r["sizes"], r["body"], r["nulls"]) for r in table.to_pylist()]
    else:
        rows = sorted(table.to_pylist(), key=lambda r: r["slice"])
        heads = [np.frombuffer(r["sizes"], "<u4").reshape(-1, 2) for r in rows]
        grams = np.concatenate([_unpack48(r["body"]) for r in rows])
        # what stands twice; only that is looked at further
        ordered = np.sort(grams)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        near = np.minimum(np.searchsorted(twice, grams), max(0, len(twice) - 1))
        shared = np.flatnonzero(twice[near] == grams) if len(twice) else np.empty(0, np.int64)
        del near
        # the slice row, document and set of a position: documents stand one after the other
        ends = np.cumsum(np.concatenate([h[:, 1] for h in heads]).astype(np.int64))
        run = np.searchsorted(ends, shared, "right")
        place = np.repeat(np.arange(len(rows)), [len(h) for h in heads])[run]
        doc = np.concatenate([h[:, 0] for h in heads])[run]
        set_key = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in rows])[run]
        grams = grams[shared]
        # copies of a set: the first keeps its place in slice order
        order = np.lexsort((shared, set_key, grams))
        g, k = grams[order], set_key[order]
        order = order[np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])] if len(order) else order
        _, run, sizes = np.unique(grams[order], return_inverse=True, return_counts=True)
        sets = sizes[run]
        order, sets = order[sets > 1], sets[sets > 1]
        by_place = np.argsort(place[order], kind="stable")
        order, sets = order[by_place], sets[by_place]
        ids = mix(grams[order] + np.uint64(bucket * _STRIDE % (1 << 64)))
        cuts = np.searchsorted(place[order], np.arange(len(rows) + 1))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                out.append((rows[i]["slice"], doc[order[a:b]].astype("<u4").tobytes(), ids[a:b].astype("<u8").tobytes(), sets[a:b].astype("<u4").tobytes(), None))
    columns = list(zip(*out)) or [()] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] + [pa.binary()] * 4)], names=["slice", "first", "second", "third", "nulls"])


def _prefixes(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        info = next(r for r in rows if r["nulls"] is not None)
        rows = [r for r in rows if r["nulls"] is None]
        keys, n = info["first"], np.frombuffer(info["second"], "<u4")
        ids, null = np.frombuffer(info["third"], "<i8"), np.frombuffer(info["nulls"], bool)
        shared: list[bytes | None] = [None] * len(n)
        if rows:
            doc, gram, sets = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("first", "<u4"), ("second", "<u8"), ("third", "<u4")))
            order = np.lexsort((gram, sets, doc))
            doc, gram = doc[order], gram[order]
            cuts = np.searchsorted(doc, np.arange(len(n) + 1))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                size = int(n[i])
                if size - (b - a) < prefix_length(size, percent):
                    shared[i] = gram[a:b].tobytes()
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null), "key": pa.array([keys[16 * i:16 * i + 16] for i in range(len(n))], pa.binary()),
            "n": pa.array(n.astype(np.int64)), "shared": pa.array(shared, pa.binary()),
        })

    return run


def _postings(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n, shared in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "shared"))):
                gram = np.frombuffer(shared, "<i8")
                gram = gram[: prefix_length(n, percent) - (n - len(gram))]
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array([key] * len(gram), pa.binary())], names=["gram", "key"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the n-grams which at least two of the sets hold."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    row, column = row[often[column]], number[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, (1 << 22) // len(sets))
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def _may_link(shared: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Pairs which pass the filters; each bounds the intersection from above."""
    least = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
    length = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    prefix = np.array([prefix_length(int(k), percent) for k in n])
    reach = [s[: p - (k - len(s))] for s, p, k in zip(shared, prefix, n)]
    met = intersections(reach)
    # position: what the prefixes have in common, and the rest of the one whose prefix ends first, at most the longer rest
    rest = n - prefix
    position = met + np.maximum(rest[:, None], rest[None, :]) >= least
    # suffix: classes of n-grams, each in common no more often than either holds it
    parts = np.array([np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=16) for s in shared])
    suffix = sum(np.minimum(c[:, None], c[None, :]) for c in parts.T) >= least
    out = length & (met > 0) & position & suffix
    np.fill_diagonal(out, False)
    return out


def _verify(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        order = np.argsort(table.column("n").to_numpy(), kind="stable")
        names = [table.column("key")[int(k)].as_py() for k in order]
        n, block = table.column("n").to_numpy()[order], table.column("block").to_numpy()[order]
        shared = [np.frombuffer(table.column("shared")[int(k)].as_py(), "<u8") for k in order]
        linked = np.zeros((len(n), len(n)), bool)
        # documents are in order of size: a stretch of sizes within reach of each other is verified by itself
        cuts = [0, *(np.flatnonzero(n[1:] * percent > n[:-1] * 100) + 1), len(n)]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                may = _may_link(shared[a:b], n[a:b], percent) & ((block[a:b, None] != block[None, a:b]) | (i == j))
                rest = np.flatnonzero(may.any(1))
                if len(rest):
                    own, size = intersections([shared[a + k] for k in rest]), n[a + rest]
                    union = size[:, None] + size[None, :] - own
                    linked[np.ix_(a + rest, a + rest)] = (100 * own >= percent * union) & may[np.ix_(rest, rest)]
        np.fill_diagonal(linked, False)
        roots = local_roots(linked, np.arange(len(n)))
        at = np.flatnonzero(roots != np.arange(len(n)))
        return pa.table({"a": pa.array([names[k] for k in at], pa.binary()), "b": pa.array([names[roots[k]] for k in at], pa.binary())})

    return run


def classes(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id: a row per row, component_id the smallest doc_id reachable by links.

    Null, empty and blank texts have no n-grams and link with nothing, not even each other. Rows with equal sets are linked. A null
    doc_id stays null and is never a component's id unless all are null. A lost task is run again over the same rows in the same
    order: docs should be read from a table, or be stored before.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    sent = docs.mapInArrow(_send(buckets, width), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_count, _ANSWER)
    sets = stored(answers.groupBy("slice").applyInArrow(_prefixes(percent), "doc_id long, key binary, n long, shared binary"))
    active = sets.filter("shared is not null").select("key", "n", "shared")

    postings = stored(active.mapInArrow(_postings(percent), "gram long, key binary"))
    firsts = postings.groupBy("gram").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    candidates = connected(postings.join(firsts, "gram").select(F.col("key").alias("a"), F.col("first").alias("b")))

    groups = candidates.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = candidates.join(groups, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    held = placed.select(F.col("node").alias("key"), "root", "block", F.explode(others).alias("p")).join(active, "key")
    links = held.select("root", "p.i", "p.j", "block", "key", "n", "shared").groupBy("root", "i", "j").applyInArrow(_verify(percent), "a binary, b binary")
    roots = connected(links)

    named = sets.select("doc_id", "key", "n").join(roots.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("class", F.when(F.col("n") > 0, F.coalesce("root", "key")))
    least = named.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
