"""Benchmark decontamination: an FM-index per shard of training text, searched backwards for all test phrases at once.

A shard is a slice of documents. Its words become symbols: one for each word the benchmark has, and a break for all others. Stretches
between breaks which are shorter than the shortest phrase cannot hold one and become part of the break. Over the symbols stand a
suffix array (prefix doubling), the Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled by text position. A
phrase is found by one interval step per word, all phrases at once; occurrences are located by walking to a sampled position and merged
to spans of words. Nothing leaves a shard but its documents' results, so there is no shuffle, and a hot passage is just a long interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from briefloom.llm.common import ALNUM, WordHasher, slices, words

WINDOW = 13
# bytes of benchmark texts in one broadcast block; a larger benchmark is searched block after block
BLOCK_BYTES = 32 << 20
_SAMPLE = 8


class WaveletMatrix:
    """Rank of any symbol below any position, by the bits of the symbol from the top."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        low, at = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = ones[low], ones[at]
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Sorted suffixes of small symbols by doubling; the first key packs as many symbols as fit a word."""
    n = len(s)
    bits = (int(s.max()) + 1).bit_length()  # 0 stands for what is behind the end
    k = 62 // bits
    key = np.zeros(n, np.int64)
    for i in range(k):
        key <<= bits
        key[: max(0, n - i)] |= s[i:] + 1
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        later = np.zeros(n, np.int64)
        later[: n - k] = rank[k:] + 1
        key, k = rank * (n + 1) + later, 2 * k


class FMIndex:
    """Over a sequence of symbols; 0 is the break, which no phrase holds."""

    def __init__(self, s: np.ndarray, symbols: int) -> None:
        s = np.append(s, 0)
        order = suffix_array(s)
        self.n = len(s)
        self.bwt = s[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols + 1))])
        self.tree = WaveletMatrix(self.bwt, max(1, int(symbols).bit_length()))
        # a break has no exact step back, so what follows one is sampled too
        sampled = (order % _SAMPLE == 0) | (self.bwt == 0)
        self.marks = np.concatenate([[0], np.cumsum(sampled)])
        self.places = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of phrases (rows of symbols, 0 behind the end), one step a word from the last."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for step in range(int(lengths.max(initial=0))):
            alive = alive[(lengths[alive] <= step) | (low[alive] < high[alive])]
            now = alive[lengths[alive] > step]
            c = phrases[now, lengths[now] - 1 - step]
            low[now] = self.first[c] + self.tree.rank(c, low[now])
            high[now] = self.first[c] + self.tree.rank(c, high[now])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back until a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            hit = self.marks[r + 1] > self.marks[r]
            out[todo[hit]] = self.places[self.marks[r[hit]]] + steps[todo[hit]]
            todo, r = todo[~hit], r[~hit]
            c = self.bwt[r]
            rows[todo] = self.first[c] + self.tree.rank(c, r)
            steps[todo] += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of a block of items. vocabulary: sorted word hashes; symbol i + 1 is word i; owners: items of each window."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    owner_bounds: np.ndarray
    owners: np.ndarray
    items: list[str]


def phrases_of(items: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases | None:
    """Windows of items (id as text, UTF-8 text); an item shorter than a window is one; without words it has none."""
    buffer, starts, ends, bounds = words([t for _, t in items], ALNUM)
    hashes = WordHasher()(buffer, starts, ends)
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    rows, owners = [], []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        for at in range(a, max(a, b - window) + 1 if b > a else a):
            row = np.zeros(window, np.int64)
            row[: min(window, b - at)] = symbols[at:min(b, at + window)] + 1
            rows.append(row)
            owners.append(i)
    if not rows:
        return None
    windows, which = np.unique(np.array(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.array(owners)]), axis=1)
    cuts = np.searchsorted(pairs[0], np.arange(len(windows) + 1))
    return Phrases(vocabulary, windows, (windows > 0).sum(1), cuts, pairs[1], [k for k, _ in items])


def search_shard(hashes: np.ndarray, bounds: np.ndarray, p: Phrases) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words of the shard lie in an occurrence of a phrase, and the items found in each document."""
    n, hit, found = len(hashes), np.zeros(len(hashes), bool), {}
    at = np.minimum(np.searchsorted(p.vocabulary, hashes), len(p.vocabulary) - 1)
    symbol = np.where(p.vocabulary[at] == hashes, at + 1, 0)
    # stretches of benchmark words within one document, long enough for a phrase
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    inside = symbol > 0
    begins = np.flatnonzero(inside & (cut[:n] | ~np.concatenate([[False], inside[:-1]]))) if n else np.empty(0, int)
    stops = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 if n else np.empty(0, int)
    keep = stops - begins >= p.lengths.min()
    begins, stops = begins[keep], stops[keep]
    if not len(begins):
        return hit, found
    sizes = stops - begins + 1  # and a break
    offset = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(offset - begins, sizes)
    text = np.where(place < np.repeat(stops, sizes), symbol[np.minimum(place, n - 1)], 0)
    index = FMIndex(text, len(p.vocabulary))
    low, high = index.search(p.windows, p.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - low, counts)
    where = place[index.locate(rows)]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, where, 1)
    np.add.at(change, where + p.lengths[which], -1)
    hit = np.cumsum(change)[:n] > 0
    docs = np.searchsorted(bounds, where, "right") - 1
    for doc, w in np.unique(np.stack([docs, which]), axis=1).T if len(where) else ():
        found.setdefault(int(doc), set()).update(p.items[o] for o in p.owners[p.owner_bounds[w]:p.owner_bounds[w + 1]])
    return hit, found


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> list[Phrases]:
    """The benchmark's phrases in blocks of bounded size (one item at least). Rows with a null id or text have no phrases."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    out = []
    for i in range(n):
        own = rows.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == i) if n > 1 else rows
        out.append(phrases_of(sorted((r.id, r.text.encode()) for r in own.toLocalIterator()), window))
    return [p for p in out if p is not None]


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> DataFrame:
    """Per row of docs, all columns and: n_words, n_hit, item_ids (found items, sorted as text), spans (words to remove, [from, to)), contaminated.

    contaminated: n_hit > 0 and `share` * n_hit >= n_words. Null and empty texts have no words and are clean; repeated rows and items
    with equal texts are each counted; an empty benchmark finds nothing. Columns of the names added are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "item_ids", "spans", "contaminated")
    context, names = docs.sparkSession.sparkContext, docs.columns
    shared = [context.broadcast(tuple(vars(p).values())) for p in blocks_of(benchmark, block_bytes, window)]
    added = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(added).fields])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for part, texts in slices(batches):
            buffer, starts, ends, bounds = words(texts, ALNUM)
            hashes = hasher(buffer, starts, ends)
            hit, items = np.zeros(len(hashes), bool), [set() for _ in texts]
            for block in shared:
                own, found = search_shard(hashes, bounds, Phrases(*block.value))
                hit |= own
                for doc, ids in found.items():
                    items[doc] |= ids
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_words, n_hit = np.diff(bounds), sums[bounds[1:]] - sums[bounds[:-1]]
            spans = [_spans(hit[a:b]) if k else [] for a, b, k in zip(bounds, bounds[1:], n_hit)]
            columns = [pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, span_type), pa.array((n_hit > 0) & (share * n_hit >= n_words))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
