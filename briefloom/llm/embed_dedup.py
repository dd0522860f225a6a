"""Near-duplicates of embeddings: Euclidean p-stable hashing in several tables, then exact cosines.

Normalised vectors are projected on random directions; each projection, shifted and divided by a width, is cut to a whole number, and
some of them together are the bucket in one table. Vectors of one bucket (and label) are compared exactly, in double precision. Equal
vectors are compared once, with their number. A bucket beyond `block` vectors is compared block by block: every pair of blocks is a
piece of work of its own, so no task holds a hot bucket. A pair which meets in several tables counts in the first of them. Links leave
a task as sums per vector and as a spanning star, never as pairs.

Chance of a link at exactly the threshold to be found, with the defaults: 1 - (1 - 0.85**8)**16 = 0.99; closer pairs are safer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from briefloom.llm.common import mix, stored
from briefloom.llm.components import connected, local_roots


# hot buckets are broadcast up to so many; beyond, the join is shuffled
BROADCAST_BUCKETS = 1_000_000


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    tables: int = 16
    projections: int = 8
    width: float = 2.0
    block: int = 1024  # vectors of a bucket which are compared at once
    rows_per_task: int = 40_000
    seed: int = 11


def unit(rows: list) -> tuple[np.ndarray, list[int]]:
    """Normalised vectors in double precision, and which rows they are; null, empty, zero, or with a null or non-finite component: left out.

    All vectors given must have one length.
    """
    at = [i for i, v in enumerate(rows) if v is not None and len(v) and None not in v]
    x = np.array([rows[i] for i in at], np.float64) if at else np.zeros((0, 1))
    top = np.abs(x).max(1, initial=0)
    fine = np.isfinite(top) & (top > 0)
    return _unit_rows(x[fine]) if fine.any() else x[fine], [i for i, ok in zip(at, fine) if ok]


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of huge or tiny components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signatures(x: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit bucket number per table."""
    rng = np.random.default_rng([settings.seed, x.shape[1]])
    directions = rng.normal(size=(x.shape[1], settings.tables * settings.projections))
    shifts = rng.uniform(0, settings.width, directions.shape[1])
    cells = np.floor((x @ directions + shifts) / settings.width).astype(np.int64).reshape(len(x), settings.tables, -1)
    out = np.zeros(cells.shape[:2], np.uint64) + mix(np.arange(1, settings.tables + 1, dtype=np.uint64))
    for k in range(cells.shape[2]):
        out = mix(out + cells[:, :, k].astype(np.uint64))
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's identity: label and exact components; null where it cannot link."""
    for batch in batches:
        labels, vectors = batch.column("label").to_pylist(), batch.column("embedding").to_pylist()
        keys: list[bytes | None] = [None] * len(vectors)
        for i, (label, v) in enumerate(zip(labels, vectors)):
            if label is not None and v is not None and None not in v and len(unit([v])[1]):
                keys[i] = xxhash.xxh3_128_digest(f"{label}:".encode() + (np.array(v, np.float64) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("embedding"), pa.array(keys, pa.binary())], names=["vec_id", "label", "embedding", "key"])


def _hashed(settings: Settings, with_vectors: bool, kind: str):
    """Rows of every table: its bucket, and what comparing needs. A key which the task has seen is not hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, labels, vectors = (batch.column(c).to_pylist() for c in ("key", "label", "embedding"))
            fresh = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            for size in sorted({len(vectors[i]) for i in fresh}):
                own = [i for i in fresh if len(vectors[i]) == size]
                x, _ = unit([vectors[i] for i in own])
                sigs = signatures(x, settings)
                salt = np.array([xxhash.xxh3_64_intdigest(f"{labels[i]}:{size}") for i in own], np.uint64)
                buckets = mix(sigs ^ salt[:, None]).view(np.int64)
                if not with_vectors:
                    yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), pa.array(np.repeat([keys[i] for i in own], settings.tables).tolist(), pa.binary())], names=["bucket", "key"])
                    continue
                copies = batch.column("copies").to_pylist()
                for t in range(settings.tables):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(buckets[:, t]), pa.array([t] * len(own), pa.int32()), pa.array([keys[i] for i in own], pa.binary()), pa.array([copies[i] for i in own], pa.int64()),
                        pa.array([r.tobytes() for r in sigs], pa.binary()), pa.array([np.array(vectors[i], kind).tobytes() for i in own], pa.binary()),
                    ], names=["bucket", "t", "key", "copies", "sigs", "vector"])

    return run


def _compare(settings: Settings, kind: str):
    """All buckets (or pairs of blocks of one) of a part; links are sums per key, edges a star per group."""

    def run(table: pa.Table) -> pa.Table:
        bucket, t, i, j, block = (table.column(c).to_numpy() for c in ("bucket", "t", "i", "j", "block"))
        keys, copies = np.array(table.column("key").to_pylist(), "S16"), table.column("copies").to_numpy()
        raw, raw_sigs = table.column("vector"), table.column("sigs")
        order = np.lexsort((keys, j, i, bucket))
        head = np.stack([bucket[order], i[order], j[order]])
        cuts = [0, *(np.flatnonzero((head[:, 1:] != head[:, :-1]).any(0)) + 1), len(order)]
        links: list[tuple[np.ndarray, np.ndarray]] = []
        stars: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts, cuts[1:]):
            own = order[a:b]
            own = own[np.concatenate([[True], keys[own][1:] != keys[own][:-1]])] if b - a > 1 else own  # copies from other tasks
            if len(own) < 2:
                continue
            x = _unit_rows(np.stack([np.frombuffer(raw[int(k)].as_py(), kind) for k in own]))
            near = x @ x.T >= settings.threshold
            np.fill_diagonal(near, False)
            if i[own[0]] != j[own[0]]:
                near &= block[own][:, None] != block[own][None, :]
            if not near.any():
                continue
            one, two = np.nonzero(np.triu(near))
            sigs = np.stack([np.frombuffer(raw_sigs[int(k)].as_py(), np.uint64) for k in own])[:, : int(t[own[0]])]
            new = ~(sigs[one] == sigs[two]).any(1)
            sums = np.bincount(one[new], copies[own][two[new]], len(own)) + np.bincount(two[new], copies[own][one[new]], len(own))
            at = np.flatnonzero(sums)
            links.append((own[at], sums[at].astype(np.int64)))
            roots = local_roots(near, np.arange(len(own)))
            at = np.flatnonzero(roots != np.arange(len(own)))
            stars.append((own[at], own[roots[at]]))

        def binary(parts: list[np.ndarray]) -> pa.Array:
            return table.column("key").combine_chunks().take(pa.array(np.concatenate(parts))) if parts else pa.array([], pa.binary())

        n, m = sum(len(x) for x, _ in links), sum(len(x) for x, _ in stars)
        a = pa.concat_arrays([binary([x for x, _ in links]), binary([x for x, _ in stars])])
        b = pa.concat_arrays([pa.nulls(n, pa.binary()), binary([y for _, y in stars])])
        sums = pa.array(np.concatenate([s for _, s in links])) if links else pa.array([], pa.int64())
        return pa.Table.from_arrays([a, b, pa.concat_arrays([sums, pa.nulls(m, pa.int64())])], names=["a", "b", "links"])

    return run


def near_duplicates(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vectors(vec_id, label, embedding) to vec_id, n_links, component_id, kept; a row per row.

    Linked: labels equal and not null, lengths equal, cosine at least the threshold, both vectors without null or non-finite components and
    not zero. Rows that repeat a vec_id count as vectors of their own. component_id: the smallest vec_id reachable, itself included.
    """
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    # vectors travel as they are given; they are normalised, in double precision, where they are compared
    kind = "f4" if dict(keyed.dtypes)["embedding"] == "array<float>" else "f8"
    keyed = stored(keyed.mapInArrow(_keys, T.StructType([*keyed.schema.fields, T.StructField("key", T.BinaryType())])))
    valid = keyed.filter("key is not null")
    repeated = valid.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    counted = valid.join(repeated, "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))

    sizes = valid.mapInArrow(_hashed(settings, False, kind), "bucket long, key binary").groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    hot = stored(sizes.filter(F.col("m") > settings.block).select("bucket", F.ceil(F.col("m") / settings.block).cast("int").alias("blocks")))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_BUCKETS else hot
    rows = counted.mapInArrow(_hashed(settings, True, kind), "bucket long, t int, key binary, copies long, sigs binary, vector binary").join(hot, "bucket", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    parts = max(8, -(-keyed.count() * settings.tables // settings.rows_per_task))
    rows = rows.withColumn("p", F.explode(pairs)).select("bucket", "t", "p.i", "p.j", "block", "key", "copies", "sigs", "vector")
    part = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(parts))
    found = stored(rows.groupBy(part.alias("part")).applyInArrow(_compare(settings, kind), "a binary, b binary, links long"))

    links = found.filter("links is not null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = connected(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("key"), "root")
    named = keyed.select("vec_id", "key").join(links, "key", "left").join(repeated, "key", "left").join(roots, "key", "left")
    named = named.withColumn("class", F.coalesce("root", "key"))
    least = named.filter("class is not null").groupBy("class").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "class", "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
