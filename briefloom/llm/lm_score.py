"""Language-model scores by a weighted backoff automaton.

Words and n-grams up to order 3 are counted over all training texts. Every n-gram counted at least twice is an arc, on a corpus of any
size; a context which has arcs is a state, with an arc of failure to the next shorter context and its backoff weight. From the root
any word goes with its smoothed unigram probability. The score of a text adds up the arcs which one traversal from left to right passes.

    P(w | h) = (c(h w) - d) / c(h)         where h w is an arc
             = backoff(h) * P(w | h')      elsewhere, h' without the first word of h
    P(w)     = (c(w) + 0.1) / (N + 0.1 * (V + 1))

No table of n-grams is gathered. A slice of texts sends its distinct n-grams with their counts in training texts to buckets by hash and
gets back the sums over all slices. So it knows the arcs it passes; one of the slices which hold an arc adds it to its context's sums.
These sums give backoff weights in buckets again, where slices ask for the failures they pass. Counts of words of at least `word_share`
and weights of contexts of at least `word_share` (words) or `ngram_share` (pairs) are broadcast, at most 1 / share of them: they save
questions and change no result. A word is its 64-bit hash, an n-gram the 64-bit hash of its two parts of one word less.

`train` gives a small automaton in memory, of the n-grams with a share of at least `ngram_share` only; `score` does not use it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from briefloom.llm.common import WHITE, WordHasher, mix, slices, stored, words

END = 0x5851F42D4C957F2D  # the end of a text, as a word
SMOOTH = 0.1
BUCKET_BYTES = 24 << 20
_COUNTED = "bucket long, codes binary, counts binary"
LEAST = 2  # n-grams counted less often are no arcs
_SENT = "bucket long, slice long, keys binary, counts binary"
_COUNTS = "slice long, bucket long, check long, counts binary, own binary, state binary"
_PASSED = "slice long, info binary, base binary, sums binary, ask_docs binary, ask_keys binary, contexts binary, parts binary"
_ASKED = "bucket long, slice long, docs binary, keys binary, parts binary"
_ANSWER = "slice long, info binary, base binary, docs binary, sums binary"
_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    word_share: float = 1e-6
    ngram_share: float = 1e-5
    discount: float = 0.5


@dataclass
class Automaton:
    """Words by sorted hash; word number `len(hashes)` is any rare word. State 0 is the root; arcs by state * size + word."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    log_unigram: np.ndarray
    start: list[int]  # state after a word read at the root
    arcs: dict[int, tuple[float, int]] = field(default_factory=dict)
    fail: list[int] = field(default_factory=lambda: [0])
    backoff: list[float] = field(default_factory=lambda: [0.0])


def _tokens(texts: list[bytes], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by the end; and the bounds of the texts."""
    buffer, starts, ends, bounds = words(texts, WHITE)
    counts = np.diff(bounds)
    out = np.full(len(starts) + len(texts), END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), counts)] = hasher(buffer, starts, ends)
    return out, bounds + np.arange(len(texts) + 1)


def _numbers(tokens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(hashes, tokens)
    at[at == len(hashes)] = 0
    return np.where(hashes[at] == tokens, at, len(hashes)) if len(hashes) else np.zeros(len(tokens), np.int64)


def _counted(docs: DataFrame, codes_of, buckets: int, spread: int) -> DataFrame:
    """Sums of codes over all texts: a row (bucket, sorted codes, counts) per bucket. codes_of(tokens, bounds) gives 64-bit codes.

    Tasks sum what they read before they send it, packed by bucket: the code's high bits of `spread`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, codes, counts, size = WordHasher(), [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            return _sum(np.concatenate(codes), np.concatenate(counts))

        def out() -> pa.RecordBatch:
            all_codes, all_counts = summed()
            at = _bucket(all_codes, buckets, spread)
            order = np.argsort(at, kind="stable")
            rows = [(int(at[o[0]]), all_codes[o].tobytes(), all_counts[o].tobytes()) for o in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(o)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "codes", "counts"])

        for _, texts in slices(batches):
            own, n = np.unique(codes_of(*_tokens(texts, hasher)), return_counts=True)
            if len(own):
                codes.append(own)
                counts.append(n)
                size += len(own)
            if len(codes) > 1 and size > 1 << 20:
                c, n = summed()
                codes, counts, size = [c], [n], len(c)
                if size > 1 << 19:
                    yield out()
                    codes, counts, size = [], [], 0
        if codes:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        codes, counts = _sum(np.concatenate([np.frombuffer(r["codes"], np.uint64) for r in rows]), np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]))
        return pa.table({"bucket": pa.array([rows[0]["bucket"]], pa.int64()), "codes": pa.array([codes.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    return docs.select("text").mapInArrow(count, _COUNTED).groupBy("bucket").applyInArrow(merge, _COUNTED)


def _sum(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _bucket(codes: np.ndarray, buckets: int, spread: int) -> np.ndarray:
    mixed = codes if spread == 64 else codes * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _frequent(counted: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes counted at least so often: few, as their counts add up to no more than all tokens."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist()):
                n = np.frombuffer(counts, np.int64)
                at = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(codes, np.int64)[at]), pa.array(n[at])], names=["code", "n"])

    found = counted.select("codes", "counts").mapInArrow(pick, "code long, n long").toPandas()
    codes, counts = found["code"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(codes)
    return codes[order], counts[order]


def _totals(counted: DataFrame) -> tuple[int, int]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int(np.frombuffer(x, np.int64).sum()), len(x) // 8) for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["n", "v"])

    r = counted.select("counts").mapInArrow(add, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return r[0] or 0, r[1] or 0


def _count_words(docs: DataFrame, settings: Settings, buckets: int) -> tuple[DataFrame, np.ndarray, np.ndarray, int, int]:
    """Counts of all words in buckets; hashes and counts of the frequent ones; N; V."""
    counted = _stored(_counted(docs, lambda tokens, bounds: tokens, buckets, 64))
    total, distinct = _totals(counted)
    return counted, *_frequent(counted, max(1.0, settings.word_share * total)), total, distinct


def train(docs: DataFrame, settings: Settings = Settings(), buckets: int = 8) -> tuple[Automaton, DataFrame]:
    """The automaton of frequent n-grams, and the counts of all words in buckets. Null texts count as empty: one end."""
    counted, hashes, counts, total, distinct = _count_words(docs, settings, buckets)
    log_unigram = np.log10((counts + SMOOTH) / (total + SMOOTH * (distinct + 1)))
    model = Automaton(hashes, counts, total, distinct, np.append(log_unigram, 0.0), [0] * (len(hashes) + 1))
    if not total:
        return model, counted

    # an n-gram is as frequent as the share asks only if its parts are: words first, then pairs, then triples
    context = docs.sparkSession.sparkContext
    least, size = max(2.0, settings.ngram_share * total), len(hashes) + 1
    often = context.broadcast((hashes, np.append(counts >= least, False)))

    def pairs(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        known, frequent = often.value
        number = _numbers(tokens, known)
        ok = frequent[number]
        both = ok[:-1] & ok[1:]
        both[bounds[1:-1] - 1] = False  # not across texts
        return (number[:-1][both] * size + number[1:][both]).astype(np.uint64)

    two, two_n = _frequent(_counted(docs, pairs, buckets, 40), least)
    pair_codes = context.broadcast((hashes, two))

    def triples(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        known, codes = pair_codes.value
        number = _numbers(tokens, known)
        code = (number[:-1] * size + number[1:]).astype(np.uint64)
        code[bounds[1:-1] - 1] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at = _numbers(code, codes)
        both = (at[:-1] < len(codes)) & (at[1:] < len(codes))
        return (at[:-1][both] * size + number[2:][both]).astype(np.uint64)

    three, three_n = _frequent(_counted(docs, triples, buckets, 40), least) if len(two) else (two, two_n)
    _build(model, two, two_n, three, three_n, settings.discount)
    return model, counted


def _build(model: Automaton, two: np.ndarray, two_n: np.ndarray, three: np.ndarray, three_n: np.ndarray, discount: float) -> None:
    """States and arcs. two: first word * size + second; three: pair number * size + third."""
    size = len(model.hashes) + 1
    two, three = two.astype(np.int64), three.astype(np.int64)
    first, second = two // size, two % size
    pair, third = three // size, three % size
    unigram = 10.0 ** model.log_unigram
    word_state: dict[int, int] = {}
    pair_state: dict[int, int] = {}
    for w in np.unique(first).tolist():
        word_state[w] = len(model.fail)
        model.fail.append(0)
    for p in np.unique(pair).tolist():
        pair_state[p] = len(model.fail)
        model.fail.append(word_state.get(int(second[p]), 0))
    model.start = [word_state.get(w, 0) for w in range(size)]
    model.backoff = [0.0] * len(model.fail)
    chance_two = (two_n - discount) / model.counts[first] if len(two) else np.zeros(0)
    weight = _backoffs(first, chance_two, unigram[second])
    for w, state in word_state.items():
        model.backoff[state] = weight[w]
    known = {int(c): i for i, c in enumerate(two)}
    for i in range(len(two)):
        after = pair_state.get(i, model.start[int(second[i])])
        model.arcs[word_state[int(first[i])] * size + int(second[i])] = (float(np.log10(chance_two[i])), after)
    chance_three = (three_n - discount) / two_n[pair] if len(three) else np.zeros(0)
    # the shorter context's probability of each third word: an arc of it, or its backoff to the unigram
    shorter = np.empty(len(three))
    for i in range(len(three)):
        v, w = int(second[pair[i]]), int(third[i])
        at = known.get(v * size + w)
        shorter[i] = chance_two[at] if at is not None else 10.0 ** weight.get(v, 0.0) * unigram[w]
    weight_pair = _backoffs(pair, chance_three, shorter)
    for p, state in pair_state.items():
        model.backoff[state] = weight_pair[p]
    for i in range(len(three)):
        v, w = int(second[pair[i]]), int(third[i])
        later = known.get(v * size + w)
        after = pair_state.get(later, model.start[w]) if later is not None else model.start[w]
        model.arcs[pair_state[int(pair[i])] * size + w] = (float(np.log10(chance_three[i])), after)


def _backoffs(context: np.ndarray, chance: np.ndarray, shorter: np.ndarray) -> dict[int, float]:
    """log10 weight of each context: the probability its arcs leave over, by what the shorter context gives to other words."""
    if not len(context):
        return {}
    names, at = np.unique(context, return_inverse=True)
    left = np.maximum(1 - np.bincount(at, chance), 1e-12)
    other = np.maximum(1 - np.bincount(at, shorter), 1e-12)
    return dict(zip(names.tolist(), np.log10(left / other).tolist()))


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an n-gram by the hashes of its first and its last n - 1 words."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))


def _planes(values: np.ndarray) -> bytes:
    """How many values, which of their bytes are not zero in all of them, and these: first bytes of all values, then second bytes and so on."""
    if not len(values):
        return b""
    planes = values.view(np.uint8).reshape(len(values), -1).T
    used = planes.any(axis=1)
    return len(values).to_bytes(8, "little") + used.tobytes() + np.ascontiguousarray(planes[used]).tobytes()


def _unplanes(data: bytes, kind: str, columns: int = 1) -> np.ndarray:
    width, n = np.dtype(kind).itemsize * columns, int.from_bytes(data[:8], "little")
    out = np.zeros((n, width), np.uint8)
    if n:
        out[:, np.frombuffer(data, bool, width, 8)] = np.frombuffer(data, np.uint8, offset=8 + width).reshape(-1, n).T
    out = out.reshape(-1).view(kind)
    return out.reshape(-1, columns) if columns > 1 else out


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys: the first one, and the planes of the differences."""
    return keys[:1].tobytes() + _planes(np.diff(keys, prepend=keys[:1]))


def _unsteps(data: bytes) -> np.ndarray:
    steps = _unplanes(data[8:], "<u8")
    steps[:1] = np.frombuffer(data[:8], "<u8")
    return np.cumsum(steps, dtype=np.uint64)


def _pack(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _unpack(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    cuts = np.cumsum([8 * (n + 1), *np.frombuffer(data, "<i8", n, 8)]).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _stored(df: DataFrame) -> DataFrame:
    """`stored`, and its shuffle files go at once, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return stored(df)
    finally:
        conf.set(key, before)


@dataclass
class _Slice:
    """n-grams of a slice. Word i ends the pair pairs[i - 1] and the triple triples[i - 2]; `at` has the places of rare words, pairs and
    triples which do not cross texts. keys: distinct and sorted; key[k]: which of them stands at each place of at[k]."""

    pairs: np.ndarray
    at: tuple[np.ndarray, np.ndarray, np.ndarray]
    keys: np.ndarray
    key: tuple[np.ndarray, np.ndarray, np.ndarray]


def _ngrams(tokens: np.ndarray, bounds: np.ndarray, numbers: np.ndarray, rare: int) -> _Slice:
    pairs = _join(tokens[:-1], tokens[1:])
    inside = np.ones(len(pairs), bool)
    inside[bounds[1:-1] - 1] = False  # not across texts
    triples = _join(pairs[:-1], pairs[1:])
    at = np.flatnonzero(numbers == rare), np.flatnonzero(inside) + 1, np.flatnonzero(inside[:-1] & inside[1:]) + 2
    keys, key = np.unique(np.concatenate([tokens[at[0]], pairs[at[1] - 1], triples[at[2] - 2]]), return_inverse=True)
    cuts = np.cumsum([len(x) for x in at])
    return _Slice(pairs, at, keys, tuple(np.split(key, cuts[:-1])))


def _parts(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the first three columns by key; the others are the same in all rows of a key."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    out = values[first]
    if len(first):
        out[:, :3] = np.add.reduceat(values[:, :3], first)
    return keys[first], out


def _weights(parts: np.ndarray, discount: float, total: int, distinct: int) -> np.ndarray:
    """log10 backoff weights of contexts by (arcs, their counts, the shorter context's counts of the same words, c(h), c(h') or 0 at the root)."""
    arcs, own, shorter, count, below = parts.astype(np.float64).T
    left = 1 - (own - discount * arcs) / count
    root = below == 0
    other = 1 - np.where(root, (shorter + SMOOTH * arcs) / (total + SMOOTH * (distinct + 1)), (shorter - discount * arcs) / np.where(root, 1, below))
    return np.log10(np.maximum(left, 1e-12) / np.maximum(other, 1e-12))


def score(docs: DataFrame, train_on: Column, settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_tokens, n_known, train_tokens, base_score, score; a row per row. train_on: which rows are learned from.

    Null and empty texts are one end. Where nothing is learned from, N and V are 0 and every token has the same probability. A lost
    task is run again over the same rows in the same order: docs should be read from a table, or be stored before (they are read three times; another order is an error).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train_on, F.lit(False)).alias("_train"))
    total_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total_bytes // BUCKET_BYTES))
    _, hashes, counts, total, distinct = _count_words(docs.filter("_train"), settings, buckets)
    context = docs.sparkSession.sparkContext
    frequent, discount = context.broadcast((hashes, counts)), settings.discount
    split = 8 * buckets  # n-grams are more than words

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
        hasher, first = WordHasher(), TaskContext.get().partitionId() << 32
        for i, (part, texts) in enumerate(slices(batches, limit=7 << 18)):
            yield first + i, part, *_tokens(texts, hasher)
            pa.default_memory_pool().release_unused()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value[0]
        for at, part, tokens, bounds in read(batches):
            grams = _ngrams(tokens, bounds, _numbers(tokens, known), len(known))
            learned = np.repeat(part.column("_train").to_numpy(zero_copy_only=False), np.diff(bounds))
            n = np.bincount(np.concatenate(grams.key), learned[np.concatenate(grams.at)], len(grams.keys)).astype("<i8")
            bucket = _bucket(grams.keys, split, 64)  # ascending, as the keys are
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            rows = [(int(bucket[a]), at, _steps(grams.keys[a:b]), _planes(n[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64()] + [pa.binary()] * 2)], names=["bucket", "slice", "keys", "counts"])

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same slices once more: their words do not travel with their n-grams."""
        for at, part, tokens, bounds in read(batches):
            ids = part.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            info = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), null, np.diff(bounds)]).astype("<i8")
            own, local = np.unique(tokens, return_inverse=True)
            row = at, -1, None, None, None, _pack(info.tobytes(), own.tobytes(), _planes(local.astype("<u4")))
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, [pa.int64()] * 3 + [pa.binary()] * 3)], names=["slice", "bucket", "check", "counts", "own", "state"])

    def count(table: pa.Table) -> pa.Table:
        rows, out = sorted(table.to_pylist(), key=lambda r: r["slice"]), []
        pa.default_memory_pool().release_unused()
        keys = [_unsteps(r["keys"]) for r in rows]
        cuts = np.cumsum([0, *map(len, keys)])
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([_unplanes(r["counts"], "<i8") for r in rows])
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, where, n)
        # the first slice which has learned from an n-gram tells its context of it
        own, learned = np.zeros(len(n), bool), np.flatnonzero(n)
        own[learned[np.unique(where[learned], return_index=True)[1]]] = True
        for r, k, a, b in zip(rows, keys, cuts, cuts[1:]):
            out.append((r["slice"], r["bucket"], int(np.bitwise_xor.reduce(k).view(np.int64)), _planes(sums[where[a:b]]), np.packbits(own[a:b]).tobytes(), None))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.binary()] * 3)], names=["slice", "bucket", "check", "counts", "own", "state"])

    def walk(table: pa.Table) -> pa.Table:
        known, known_n = frequent.value
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        info, own_words, local = _unpack(rows[0]["state"])
        info = np.frombuffer(info, "<i8").reshape(3, -1)
        tokens = np.frombuffer(own_words, np.uint64)[_unplanes(local, "<u4")]
        bounds = np.concatenate([[0], np.cumsum(info[2])])
        numbers = _numbers(tokens, known)
        grams = _ngrams(tokens, bounds, numbers, len(known))
        told = rows[1:]
        sums = [_unplanes(r["counts"], "<i8") for r in told]
        n = np.concatenate([np.zeros(0, np.int64), *sums])
        own = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(r["own"], np.uint8), count=len(x)) for r, x in zip(told, sums))]).astype(bool)
        one, two, three = np.append(known_n, 0)[numbers], np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        check = int(np.bitwise_xor.reduce(grams.keys).view(np.int64)) if len(grams.keys) else 0
        if len(n) != len(grams.keys) or check != reduce(xor, (r["check"] for r in told), 0):
            raise ValueError("the texts were read in another order the second time: store them before")
        for to, at, key in zip((one, two, three), grams.at, grams.key):
            to[at] = n[key]
        two[two < LEAST], three[three < LEAST] = 0, 0
        before, pair_before = np.roll(one, 1), np.roll(two, 1)  # read only where a pair or triple ends
        unigram = np.log10((one + SMOOTH) / (total + SMOOTH * (distinct + 1)))
        by_three, by_two = three > 0, (three == 0) & (two > 0)
        steps = unigram.copy()
        steps[by_two] = np.log10((two[by_two] - discount) / before[by_two])
        steps[by_three] = np.log10((three[by_three] - discount) / pair_before[by_three])
        # failures passed: from the pair before a word which its triple does not lead on, then from the word before it
        from_two = grams.at[2][(three[grams.at[2]] == 0) & (pair_before[grams.at[2]] > 0)]
        from_one = grams.at[1][~by_three[grams.at[1]] & ~by_two[grams.at[1]] & (before[grams.at[1]] >= LEAST)]
        doc = np.repeat(np.arange(len(bounds) - 1), info[2])
        passed = np.concatenate([from_two, from_one])
        asked = np.concatenate([grams.pairs[from_two - 2], tokens[from_one - 1]])
        order = np.lexsort((passed, asked))
        # arcs which this slice tells their contexts of, once each
        contexts, values = [], []
        for at, key, counted, shorter, count_of, below, name in (
            (grams.at[1], grams.key[1], two, one, before, None, lambda i: tokens[i - 1]),
            (grams.at[2], grams.key[2], three, two, pair_before, before, lambda i: grams.pairs[i - 2]),
        ):
            mine = own[key] & (counted[at] > 0) if len(at) else np.zeros(0, bool)
            i = at[mine][np.unique(key[mine], return_index=True)[1]]
            contexts.append(name(i))
            values.append(np.stack([np.ones(len(i), np.int64), counted[i], shorter[i], count_of[i], np.zeros(len(i), np.int64) if below is None else below[i]], 1))
        contexts, values = _parts(np.concatenate(contexts), np.concatenate(values))
        info = np.concatenate([info, np.add.reduceat((one > 0).astype(np.int64), bounds[:-1])[None]])
        return pa.Table.from_arrays(
            [pa.array([rows[0]["slice"]], pa.int64())] + [pa.array([x], pa.binary()) for x in (
                info.astype("<i8").tobytes(), np.bincount(doc, unigram).tobytes(), np.bincount(doc, steps).tobytes(),
                _planes(doc[passed[order]].astype("<u4")), _steps(asked[order]), _steps(contexts), _planes(values.astype("<i8")),
            )],
            names=["slice", "info", "base", "sums", "ask_docs", "ask_keys", "contexts", "parts"],
        )

    summed = _stored(docs.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(count, _COUNTS))
    passed = _stored(docs.mapInArrow(state, _COUNTS).unionByName(summed).groupBy("slice").applyInArrow(walk, _PASSED))

    least = max(1.0, settings.word_share * total), max(1.0, settings.ngram_share * total)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, parts in zip(batch.column("contexts").to_pylist(), batch.column("parts").to_pylist()):
                keys, parts = _unsteps(keys).view(np.int64), _unplanes(parts, "<i8", 5)
                at = parts[:, 3] >= np.where(parts[:, 4] == 0, *least)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), *(pa.array(x) for x in parts[at].T)], names=["key", "arcs", "own", "shorter", "n", "below"])

    found = passed.select("contexts", "parts").mapInArrow(often, "key long, arcs long, own long, shorter long, n long, below long")
    found = found.groupBy("key").agg(*(F.sum(x).alias(x) for x in ("arcs", "own", "shorter")), F.max("n").alias("n"), F.max("below").alias("below")).toPandas()
    names = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    cached = context.broadcast((names[order], _weights(found.drop(columns="key").to_numpy(np.int64)[order], discount, total, distinct)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = cached.value
        for r in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            docs_of, keys = _unplanes(r["ask_docs"], "<u4"), _unsteps(r["ask_keys"])
            at = _numbers(keys, names)
            sums, here = np.frombuffer(r["sums"]), at < len(names)
            sums = sums + np.bincount(docs_of[here], weights[at[here]], len(sums))
            rows = [(-1 - r["slice"], r["slice"], r["info"], r["base"], sums.tobytes())]
            docs_of, keys = docs_of[~here], keys[~here]
            contexts, parts = _unsteps(r["contexts"]), _unplanes(r["parts"], "<i8", 5)
            rest = _numbers(contexts, names) == len(names)
            contexts, parts = contexts[rest], parts[rest]
            edges = np.arange(buckets + 1)
            asks, tells = np.searchsorted(_bucket(keys, buckets, 64), edges), np.searchsorted(_bucket(contexts, buckets, 64), edges)
            for b in range(buckets):
                if asks[b + 1] > asks[b]:
                    own = slice(asks[b], asks[b + 1])
                    rows.append((b, r["slice"], _planes(docs_of[own]), _steps(keys[own]), None))
                if tells[b + 1] > tells[b]:
                    own = slice(tells[b], tells[b + 1])
                    rows.append((b, None, None, _steps(contexts[own]), _planes(parts[own])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64()] + [pa.binary()] * 3)], names=["bucket", "slice", "docs", "keys", "parts"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        if key[0].as_py() < 0:
            out = [(r["slice"], r["docs"], r["keys"], None, r["parts"]) for r in rows]
        else:
            told = [r for r in rows if r["slice"] is None]
            names, parts = _parts(np.concatenate([np.empty(0, np.uint64), *(_unsteps(r["keys"]) for r in told)]), np.concatenate([np.empty((0, 5), np.int64), *(_unplanes(r["parts"], "<i8", 5) for r in told)]))
            weights = np.append(_weights(parts, discount, total, distinct), 0.0)  # a context without arcs is no state
            for r in rows:
                if r["slice"] is not None:
                    doc, where = np.unique(_unplanes(r["docs"], "<u4"), return_inverse=True)
                    sums = np.bincount(where, weights[_numbers(_unsteps(r["keys"]), names)])
                    out.append((r["slice"], None, None, doc.tobytes(), sums.tobytes()))
        columns = list(zip(*out)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] + [pa.binary()] * 4)], names=["slice", "info", "base", "docs", "sums"])

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["info"] is not None)
        ids, null, tokens, known = np.frombuffer(head["info"], "<i8").reshape(4, -1)
        sums = np.frombuffer(head["sums"]).copy()
        for r in sorted((r for r in rows if r["info"] is None), key=lambda r: r["docs"] + r["sums"]):  # one order of adding
            sums[np.frombuffer(r["docs"], "<u4")] += np.frombuffer(r["sums"])
        return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "n_tokens": tokens, "n_known": known, "base_score": np.frombuffer(head["base"]), "score": sums})

    answers = passed.mapInArrow(ask, _ASKED).groupBy("bucket").applyInArrow(answer, _ANSWER)
    out = answers.groupBy("slice").applyInArrow(finish, _SCORES)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
