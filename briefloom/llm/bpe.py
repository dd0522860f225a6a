"""Byte-level BPE: texts to token ids and back, by a table of ranked merges.

The words of the corpus are counted, and those which make up at least `share` of all words each (so 1 / share at most) are encoded once
by Spark: a higher-order function folds the lowest-ranked merge over the array of a word's bytes, ranks come from a row beside it. Their
ids are broadcast. Texts are then encoded where they lie, without a shuffle: a frequent word is looked up, all others of a slice are
folded by the same rule in the task, words of one length together. The result does not depend on which words are frequent.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from briefloom.llm.common import slices, stored

SHARE = 1e-6
_MAP_BUCKETS = 1 << 15
_FOLDED_BYTES = 64  # longer words are folded in the tasks, with a heap
_KEPT = 1 << 17  # words remembered by a task
_SHORT, _NONE = 40, 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


# --- the fold as a column -----------------------------------------------------------------------------------------


_MAPS = "array<map<string,int>>"


def _rank_json(ranks: dict[bytes, int]) -> str:
    """The ranks as small maps in an array, by the crc32 of the piece, as a lookup in a map walks along its keys."""
    maps: list[dict[str, int]] = [{} for _ in range(_MAP_BUCKETS)]
    for piece, rank in ranks.items():
        maps[zlib.crc32(piece) % _MAP_BUCKETS][piece.hex().upper()] = rank
    return json.dumps(maps)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal, for a few ranks: Spark writes it into every text of the plan, and keeps those in the driver."""
    return F.from_json(F.lit(_rank_json(ranks)), _MAPS)


def rank_row(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """The ranks as the one row of a frame; as a scalar subquery it is in no text of a plan."""
    return spark.createDataFrame([(_rank_json(ranks),)], "ranks string").select(F.from_json("ranks", _MAPS).alias("ranks"))


def rank_of(piece: Column, ranks: Column) -> Column:
    return F.element_at(F.get(ranks, F.pmod(F.crc32(piece), F.lit(_MAP_BUCKETS)).cast("int")), F.hex(piece))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word: Column, ranks: Column) -> Column:
    """Token ids of a binary word: one byte a piece, then the leftmost pair of lowest rank is joined until no pair has a rank.

    A word which is a piece itself is one token, as in `fold_bytes`.
    """
    pieces = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(word, i, F.lit(1)))

    def step(state: Column, _: Column) -> Column:
        n = F.size(state)
        pairs = F.transform(F.slice(state, F.lit(1), n - 1), lambda p, i: rank_of(F.concat(p, F.get(state, i + 1)), ranks))

        def joined(found: Column) -> Column:
            at = F.array_position(found, F.array_min(found)).cast("int")
            pair = F.array(F.concat(F.get(state, at - 1), F.get(state, at)))
            return F.when(F.array_min(found).isNull(), state).otherwise(
                F.concat(F.slice(state, F.lit(1), at - 1), pair, F.slice(state, at + 2, F.greatest(n - at - 1, F.lit(0))))
            )

        return F.when(n > 1, _let(pairs, joined)).otherwise(state)

    merged = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), pieces, step)
    whole = rank_of(word, ranks)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(merged, lambda p: rank_of(p, ranks)))


# --- the same rule in a task --------------------------------------------------------------------------------------


def fold_bytes(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Lowest rank first, leftmost of equals. Long words have a heap of pairs, so that a million bytes without a blank are no trouble."""
    n = len(word)
    if word in ranks:
        return (ranks[word],)
    if n <= _SHORT:
        short = [word[i:i + 1] for i in range(n)]
        pairs = [ranks.get(word[i:i + 2], _NONE) for i in range(n - 1)]
        while pairs and (best := min(pairs)) != _NONE:
            i = pairs.index(best)
            short[i:i + 2] = [short[i] + short[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(short[i - 1] + short[i], _NONE)
            if i < len(pairs):
                pairs[i] = ranks.get(short[i] + short[i + 1], _NONE)
        return tuple([ranks[p] for p in short])
    parts: list[bytes | None] = [word[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, word[i:i + 2]) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(pair + parts[k])) is not None:
                heapq.heappush(heap, (r, i, pair + parts[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(parts[h] + pair)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + pair))
    return tuple(ranks[p] for p in parts if p is not None)


@dataclass
class Pairs:
    """The merges as arrays: pieces are numbered by rank, and a pair of numbers has the number of the piece which it makes."""

    ids: np.ndarray  # of the pieces; numbers beyond are of bytes without a rank, which may be parts of pieces
    single: np.ndarray  # numbers of the bytes
    keys: np.ndarray  # left << 32 | right, sorted; the last one is no pair
    made: np.ndarray
    first: np.ndarray  # what two bytes make

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.made[at], self.made[-1])


def read_pairs(ranks: dict[bytes, int]) -> Pairs:
    pieces, single = sorted(ranks, key=ranks.__getitem__), [bytes([b]) for b in range(256)]
    number = {p: i for i, p in enumerate([*pieces, *(p for p in single if p not in ranks)])}
    found = sorted((number[p[:i]] << 32 | number[p[i:]], n) for n, p in enumerate(pieces) for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
    keys, made = np.array([k for k, _ in found] + [-1], np.int64), np.array([n for _, n in found] + [len(number)], np.int32)
    out = Pairs(np.array([ranks[p] for p in pieces], np.int64), np.array([number[p] for p in single], np.int32), keys, made, np.empty(0))
    out.first = out.of(*np.meshgrid(out.single, out.single, indexing="ij"))
    return out


def fold_words(words: list[bytes], ranks: dict[bytes, int], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and how many each has; the rule of `fold_bytes`.

    Words of one length are the rows of a matrix. A round joins the pair of lowest rank of every row, so rows stay of one length; those
    without a pair are done.
    """
    none = pairs.made[-1]
    done: list[tuple[np.ndarray, np.ndarray]] = []  # places of words, and a row of ids each
    lengths: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if not word or word in ranks or len(word) > _SHORT:
            done.append((np.array([i]), np.array([fold_bytes(word, ranks)], np.int64)))
        else:
            lengths.setdefault(len(word), []).append(i)
    for n, own in lengths.items():
        place = np.array(own)
        letters = np.frombuffer(b"".join([words[i] for i in own]), np.uint8).reshape(-1, n)
        row, made = pairs.single[letters], pairs.first[letters[:, :-1], letters[:, 1:]]
        while len(place):
            best = made.argmin(axis=1) if made.shape[1] else np.zeros(len(place), np.int64)
            low = made[np.arange(len(place)), best] if made.shape[1] else np.full(len(place), none)
            ended = low == none
            if ended.any():
                if (row[ended] >= len(pairs.ids)).any():
                    raise KeyError("a byte has no rank")
                done.append((place[ended], pairs.ids[row[ended]]))
                place, row, made, best, low = (x[~ended] for x in (place, row, made, best, low))
                if not len(place):
                    break
            at, size = np.arange(len(place)), row.shape[1]
            row[at, best] = low
            after = np.arange(size - 1) > best[:, None]
            row = np.where(after, row[:, 1:], row[:, :-1])
            made = np.where(after[:, 1:], made[:, 1:], made[:, :-1])
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < size - 2)
            made[left, best[left] - 1] = pairs.of(row[left, best[left] - 1], low[left])
            made[right, best[right]] = pairs.of(low[right], row[right, best[right] + 1])
    counts = np.zeros(len(words), np.int64)
    for place, ids in done:
        counts[place] = ids.shape[1]
    starts = np.cumsum(counts) - counts
    out = np.empty(counts.sum(), np.int32)
    for place, ids in done:
        out[starts[place][:, None] + np.arange(ids.shape[1])] = ids
    return out, counts


def frequent_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, share: float = SHARE) -> dict[str, tuple[int, ...]]:
    """Ids of the words with at least this share of all words of the corpus: 1 / share entries at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(pattern), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([w.encode("utf-8", "surrogateescape") for w in seen], pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

        for _, texts in slices(batches):
            for text in texts:
                seen.update(split.findall(text.decode("utf-8", "surrogateescape")))
                if len(seen) > _KEPT:
                    yield out()
                    seen.clear()
        yield out()

    counts = stored(docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter((F.col("n") >= share * total) & (F.octet_length("word") <= _FOLDED_BYTES)).select("word")
    spread = often.repartition(docs.sparkSession.sparkContext.defaultParallelism, "word")
    # a column first: subqueries may not stand in higher-order functions
    ranked = spread.select("word", rank_row(docs.sparkSession, ranks).scalar().alias("ranks"))
    ids = _let(F.col("ranks"), lambda r: fold(F.col("word"), r))
    rows = ranked.select("word", ids.alias("ids")).collect()
    return {bytes(r.word).decode("utf-8", "surrogateescape"): tuple(r.ids) for r in rows}


def _flat(ids: Iterable[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    rows = list(ids)
    return np.fromiter(chain.from_iterable(rows), np.int32), np.array([len(r) for r in rows], np.int64)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, share: float = SHARE) -> DataFrame:
    """All columns and `ids`, the token ids of the whole text; null and empty texts have none. An older column `ids` is replaced."""
    docs = docs.drop("ids")
    context, names = docs.sparkSession.sparkContext, docs.columns
    frequent = frequent_words(docs, ranks, pattern, share)
    shared = context.broadcast((ranks, tuple(vars(read_pairs(ranks)).values()), list(frequent), _flat(frequent.values())))
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        table, arrays, often, (often_ids, often_counts) = shared.value
        pairs = Pairs(*arrays)

        class Known(dict):
            """Numbers of words; what is neither frequent nor remembered gets the next one, and is folded with the rest of its slice."""

            def __missing__(self, word: str) -> int:
                fresh.append(word.encode("utf-8", "surrogateescape"))
                n = self[word] = len(self)
                return n

        known, flat, counts = Known(zip(often, range(len(often)))), often_ids, often_counts
        for part, texts in slices(batches):
            if len(known) > len(often) + _KEPT:
                known, flat, counts = Known(zip(often, range(len(often)))), often_ids, often_counts
            fresh: list[bytes] = []
            found = [np.array([known[w] for w in split.findall(text.decode("utf-8", "surrogateescape"))], np.int64) for text in texts]
            if fresh:
                ids, n = fold_words(fresh, table, pairs)
                flat, counts = np.concatenate([flat, ids]), np.concatenate([counts, n])
            starts = np.cumsum(counts) - counts
            ends = np.cumsum([0, *(int(counts[own].sum()) for own in found)])
            parts = [np.empty(0, np.int32)]
            for own in found:
                n = counts[own]
                parts.append(flat[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), ids], names=[*names, "ids"])

    return docs.mapInArrow(run, schema)


def _stretches(starts: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Rows [low, high) with about `limit` ids, one row at least."""
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + limit, "right")) - 1)
        yield low, high
        low = high


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """All columns and `decoded`, the bytes of `ids`. A null array decodes to no bytes; an id without a piece is an error."""
    tokens = tokens.drop("decoded")
    names = tokens.columns
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(shared.value.values()) + 1
        pieces = [b""] * size
        for piece, rank in shared.value.items():
            pieces[rank] = piece
        lengths = np.array([len(p) for p in pieces], np.int64)
        begins, letters = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(pieces), np.uint8)
        for batch in batches:
            column = batch.column("ids")
            starts = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy()[starts[0]:starts[-1]]
            starts -= starts[0]
            for low, high in _stretches(starts):
                ids = flat[starts[low]:starts[high]]
                n = lengths[ids]
                if not n.all():
                    raise ValueError("an id has no piece")
                ends = np.concatenate([[0], np.cumsum(n)])
                out = letters[np.repeat(begins[ids] - ends[:-1], n) + np.arange(ends[-1])]
                bounds = ends[starts[low:high + 1] - starts[low]].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(bounds), pa.py_buffer(out)])
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), decoded], names=[*names, "decoded"])

    return tokens.mapInArrow(run, schema)
