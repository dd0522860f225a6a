"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Filters of several widths slide over the words of a text, the maximum of each filter over all positions feeds a logistic output. The
model has a fixed size and is broadcast. It learns from all labelled documents: a bounded sample gives the start, then every shard of
the rows takes its steps from there in a task of its own and the models are averaged; scale, shift and thresholds are counted over all
rows which are kept for calibration. The embedding of a word is the sum of
the hashed rows of the word and of its first letters, so inflected and compound forms share what was learned about their root. Scoring
a text of any length is gathers, small products and segmented maxima over chunks of positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from briefloom.llm.common import LETTERS, WordHasher, mix, slices, stored, words

_CHUNK = 1 << 16


@dataclass(frozen=True)
class Settings:
    bits: int = 15  # hashed vocabulary, 16 at most
    prefixes: tuple[int, ...] = (3, 4, 5, 6)  # letters
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # of each width
    # bounds of the sample for the start: rows of each class, chosen by hash, and words of a sampled text
    rows_per_class: int = 2500
    sample_words: int = 4000
    steps: int = 900
    batch: int = 48
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7
    bounds: tuple[float, float] = (0.5, 0.9)  # thresholds stay between these
    # the pass over all rows: rows of a shard, how many shards there may be (then they have more rows), words of a step, rate
    shard_rows: int = 4000
    shards: int = 256
    step_words: int = 1 << 16
    pass_rate: float = 0.002


@dataclass
class Model:
    """Row 0 of the embedding is empty: padding, or a prefix longer than the word. kernels: width x dims x filters of each width."""

    embedding: np.ndarray
    kernels: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    scale: float = 1.0
    thresholds: dict[str | None, float] = field(default_factory=dict)


def _tokens(texts: list[bytes], hasher: WordHasher, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (1 and up) of each word and its prefixes, one row a word, and the bounds of the texts."""
    buffer, starts, ends, bounds = words(texts, LETTERS)
    capital = (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E) & (buffer[1:] != 0x97) & (buffer[:-1] == 0xC3)  # capitals of Latin-1
    buffer = buffer.copy()
    buffer[1:][capital] += 32
    first = np.append(np.flatnonzero((buffer & 0xC0) != 0x80), np.full(max(settings.prefixes) + 1, len(buffer)))  # of each code point
    letter = np.searchsorted(first, starts)
    out = np.zeros((len(starts), 1 + len(settings.prefixes)), np.uint16)
    size = np.uint64((1 << settings.bits) - 1)
    out[:, 0] = hasher(buffer, starts, ends) % size + np.uint64(1)
    for i, n in enumerate(settings.prefixes):
        cut = first[letter + n]
        at = np.flatnonzero(cut <= ends)
        out[at, i + 1] = mix(hasher(buffer, starts[at], cut[at]) + np.uint64(n)) % size + np.uint64(1)
    return out, bounds


def _padded(tokens: np.ndarray, bounds: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by `pad` empty words and at least one position long; and where each starts."""
    lengths = np.diff(bounds)
    starts = np.cumsum([0, *(np.maximum(lengths, 1) + pad)])
    out = np.zeros((starts[-1] + pad, tokens.shape[1]), tokens.dtype)
    out[np.repeat(starts[:-1] - bounds[:-1], lengths) + np.arange(len(tokens))] = tokens
    return out, starts


def _embed(embedding: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    x = embedding[tokens[:, 0]]
    for i in range(1, tokens.shape[1]):
        x += embedding[tokens[:, i]]
    return x


def logits(model: Model, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Logits of texts given as buckets; memory is bounded by the chunk, not by the longest text."""
    n = len(bounds) - 1
    widest = len(model.kernels[-1])
    flat, starts = _padded(tokens, bounds, widest - 1)
    total = len(flat) - (widest - 1)
    pooled = [np.full((n, k.shape[2]), -np.inf, np.float32) for k in model.kernels]
    for low in range(0, total, _CHUNK):
        high = min(total, low + _CHUNK)
        first = int(np.searchsorted(starts, low, "right")) - 1
        last = int(np.searchsorted(starts, high, "left"))
        cuts = np.maximum(starts[first:last], low) - low
        x = _embed(model.embedding, flat[low:high + widest - 1])
        for kernel, best in zip(model.kernels, pooled):
            sums = x[:high - low] @ kernel[0]
            for k in range(1, len(kernel)):
                sums += x[k:high - low + k] @ kernel[k]
            np.maximum(best[first:last], np.maximum.reduceat(sums, cuts, axis=0), out=best[first:last])
    features = np.concatenate([np.maximum(p + b, 0) for p, b in zip(pooled, model.bias)], axis=1)
    return (features.astype(np.float64) @ model.out + model.shift) * model.scale


def score_tokens(model: Model, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(model, tokens, bounds), -40, 40)))


def _gradients(p: dict[str, np.ndarray], own: list[np.ndarray], y: np.ndarray, s: Settings, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
    """Of the logistic loss over some texts; the gradient of a maximum goes to its position."""
    flat, starts = _padded(np.concatenate(own), np.cumsum([0, *map(len, own)]), max(s.widths) - 1)
    total, cuts = len(flat) - (max(s.widths) - 1), starts[:-1]
    doc = np.repeat(np.arange(len(own)), np.diff(starts))
    x = _embed(p["E"], flat)
    parts = []
    for w in s.widths:
        a = sum(x[k:total + k] @ p[f"W{w}"][k] for k in range(w))
        best = np.maximum.reduceat(a, cuts, axis=0)
        where = np.minimum.reduceat(np.where(a == best[doc], np.arange(total)[:, None], total), cuts, axis=0)
        parts.append((w, best + p[f"b{w}"], where))
    features = np.concatenate([np.maximum(m, 0) for _, m, _ in parts], axis=1)
    error = (1 / (1 + np.exp(-np.clip(features @ p["out"] + p["shift"], -40, 40))) - y) * weight / len(own)
    grad = {k: s.decay * v for k, v in p.items() if k[0] in "WEo"}
    grad["out"] = grad["out"] + features.T @ error
    grad["shift"] = np.array([error.sum()])
    back = error[:, None] * p["out"]
    for i, (w, m, where) in enumerate(parts):
        g = back[:, i * s.filters:(i + 1) * s.filters] * (m > 0)
        grad[f"b{w}"] = g.sum(0)
        kernel = p[f"W{w}"]
        for k in range(w):
            at = where + k
            grad[f"W{w}"][k] += np.einsum("bf,bfd->df", g, x[at])
            moved = (g[:, :, None] * kernel[k].T).reshape(-1, s.dims)
            for c in range(flat.shape[1]):
                np.add.at(grad["E"], flat[at, c].ravel(), moved)
    return grad


def _adam(p: dict[str, np.ndarray], moment: dict[str, tuple], grad: dict[str, np.ndarray], step: int, rate: float) -> None:
    for k, g in grad.items():
        one, two = moment[k]
        one += 0.1 * (g - one)
        two += 0.001 * (g * g - two)
        p[k] -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    p["E"][0] = 0


def _model(p: dict[str, np.ndarray], s: Settings) -> Model:
    return Model(p["E"].astype(np.float32), [p[f"W{w}"].astype(np.float32) for w in s.widths], [p[f"b{w}"] for w in s.widths], p["out"], float(p["shift"][0]))


def _constant(share: float, s: Settings) -> Model:
    """Where there is nothing to tell apart."""
    share = float(np.clip(share, 0.01, 0.99))
    kernels = [np.zeros((w, s.dims, s.filters), np.float32) for w in s.widths]
    return Model(np.zeros((1 << s.bits, s.dims), np.float32), kernels, [np.zeros(s.filters)] * len(kernels), np.zeros(s.filters * len(kernels)), float(np.log(share / (1 - share))), 1.0, {None: 0.7})


def _start(tokens: list[np.ndarray], toxic: np.ndarray, s: Settings, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Adam on rows in memory, drawn from both classes, which must be there."""
    p = {"E": rng.normal(0, 0.05, (1 << s.bits, s.dims)), "out": rng.normal(0.5, 0.1, s.filters * len(s.widths)), "shift": np.zeros(1)}
    for w in s.widths:
        p[f"W{w}"] = rng.normal(0, 0.3, (w, s.dims, s.filters))
        p[f"b{w}"] = np.zeros(s.filters)
    p["E"][0] = 0
    classes = [np.flatnonzero(toxic == c) for c in (0, 1)]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, s.steps + 1):
        rows = np.concatenate([rng.choice(classes[0], s.batch * 2 // 3), rng.choice(classes[1], s.batch // 3)])
        grad = _gradients(p, [tokens[i] for i in rows], toxic[rows], s)
        _adam(p, moment, grad, step, s.rate * min(1.0, 3 * (1 - step / (s.steps + 1))))
    return p


def fit(tokens: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], settings: Settings = Settings()) -> Model:
    """A model of rows in memory. A fifth of the rows calibrates, the rest trains."""
    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(toxic))
    held, rest = order[: len(order) // 5], order[len(order) // 5:]
    if len(set(toxic[rest])) < 2:
        return _constant(toxic.mean() if len(toxic) else 0.0, settings)
    model = _model(_start([tokens[i] for i in rest], toxic[rest], settings, rng), settings)
    bounds = np.cumsum([0, *(len(tokens[i]) for i in held)])
    logit = logits(model, np.concatenate([tokens[i] for i in held]), bounds) if len(held) else np.empty(0)
    _calibrate(model, pd.DataFrame({"lang": [langs[i] for i in held], "toxic": toxic[held].astype(int), "logit": logit}), settings)
    return model


def _cuts(bounds: tuple[float, float]) -> np.ndarray:
    return np.linspace(*bounds, 81)


def _best(counts: np.ndarray, bounds: tuple[float, float]) -> float:
    """The middle of the best stretch by F1. counts[class, i]: rows which reach i cuts."""
    reach = counts[:, ::-1].cumsum(1)[:, ::-1]
    hit, said = reach[1, 1:], reach[:, 1:].sum(0)
    f1 = 2 * hit / np.maximum(1, said + counts[1].sum())
    return float(np.median(_cuts(bounds)[f1 == f1.max()]))


def _calibrate(model: Model, rows: pd.DataFrame | DataFrame, settings: Settings) -> None:
    """On rows (lang, toxic, logit) not trained on: scale and shift of the logit, so that 0.7 is the cut of best F1, and thresholds by
    language; None: all rows. Rows in Spark are counted there, and only counts are collected."""
    scales = (0.5, 0.7, 1.0, 1.4, 2.0)

    def counted(scale: float, shift: float, bounds: tuple[float, float]) -> dict[str | None, np.ndarray]:
        """counts[class, number of cuts reached] by language."""
        at = (np.log(_cuts(bounds)) - np.log1p(-_cuts(bounds))) / scale - shift
        if isinstance(rows, pd.DataFrame):
            found = zip(rows["lang"], rows["toxic"], np.searchsorted(at, rows["logit"], "right"), [1] * len(rows))
        else:
            reached = F.size(F.filter(F.array(*[F.lit(float(x)) for x in at]), lambda x: x <= F.col("logit")))
            found = rows.groupBy("lang", "toxic", reached.alias("i")).count().collect()
        out: dict[str | None, np.ndarray] = {}
        for lang, y, i, n in found:
            out.setdefault(lang or None, np.zeros((2, 82)))[int(y), i] += n
        return out

    whole = sum(counted(1.0, 0.0, (0.1, 0.9)).values(), np.zeros((2, 82)))
    model.thresholds = {None: 0.7}
    if not whole.sum(1).all():
        return
    if isinstance(rows, pd.DataFrame):
        loss = [np.logaddexp(0, -rows["logit"] * k * (2 * rows["toxic"] - 1)).mean() for k in scales]
    else:
        wrong = [F.col("logit") * F.lit(k) * (F.lit(1) - 2 * F.col("toxic")) for k in scales]
        loss = list(rows.agg(*[F.avg(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))).alias(f"l{i}") for i, z in enumerate(wrong)]).first())
    scale = scales[int(np.argmin(loss))]
    cut = _best(sum(counted(scale, 0.0, (0.1, 0.9)).values()), (0.1, 0.9))
    moved = (np.log(0.7 / 0.3) - np.log(cut / (1 - cut))) / scale
    model.scale, model.shift = scale, model.shift + moved
    for lang, counts in sorted((k, v) for k, v in counted(scale, moved, settings.bounds).items() if k):
        if counts.sum(1).min() >= 20:
            model.thresholds[lang] = _best(counts, settings.bounds)


_KEYS = "doc_id long, lang string, toxic int"
_BLOCK = 1 << 13  # numbers of a model which are averaged together


def _pass(rows: DataFrame, p: dict[str, np.ndarray], shares: tuple[float, float], n_rows: int, s: Settings) -> dict[str, np.ndarray]:
    """Every shard takes steps from `p` over each of its rows once; the mean of the shards' models, by their rows.

    Shards are made by the hash of the id and ordered by it, so the steps do not depend on how the rows lie; rounding does. A task holds a model and one step's texts.
    """
    shards = int(np.clip(-(-n_rows // s.shard_rows), 1, s.shards))
    shared = rows.sparkSession.sparkContext.broadcast(p)
    # a step weighs the classes as the start does
    weights = np.array([2 / 3 / shares[0], 1 / 3 / shares[1]])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = WordHasher(), {k: v.copy() for k, v in shared.value.items()}
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in own.items()}
        held: list[tuple[np.ndarray, int]] = []
        step = seen = size = 0

        def take() -> None:
            y = np.array([c for _, c in held])
            _adam(own, moment, _gradients(own, [x for x, _ in held], y, s, weights[y]), step, s.pass_rate)

        for part, texts in slices(batches):
            tokens, bounds = _tokens(texts, hasher, s)
            for a, b, y in zip(bounds, bounds[1:], part.column("toxic").to_pylist()):
                if held and (len(held) == s.batch or size + b - a > s.step_words):
                    step += 1
                    take()
                    held, size = [], 0
                held.append((tokens[a:b], y))
                size, seen = size + b - a, seen + 1
        if held:
            step += 1
            take()
            flat = np.concatenate([own[k].ravel() for k in sorted(own)]) * seen
            blocks = [flat[i:i + _BLOCK].tobytes() for i in range(0, len(flat), _BLOCK)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "n": pa.array([seen] * len(blocks), pa.int64()), "sums": blocks})

    def total(table: pa.Table) -> pa.Table:
        # the shards' order is not fixed: one order of adding
        sums = sum(np.frombuffer(x) for x in sorted(table.column("sums").to_pylist()))
        return pa.table({"block": table.column("block")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "sums": [sums.tobytes()]})

    dealt = rows.repartition(shards, F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)))
    ordered = dealt.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "toxic", "text").select("text", "toxic")
    schema = "block int, n long, sums binary"
    found = ordered.mapInArrow(learn, schema).groupBy("block").applyInArrow(total, schema).collect()
    if not found:
        return p
    flat = np.concatenate([np.frombuffer(r.sums) / r.n for r in sorted(found, key=lambda r: r.block)])
    out, at = {}, 0
    for k in sorted(p):
        out[k] = flat[at:at + p[k].size].reshape(p[k].shape).copy()
        at += p[k].size
    return out


def _labelled(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts with their classes, by a merge join on any size: a broadcast of small labels would deal the texts of a small corpus less
    often than those of a large one, and labels of a large one must not go through the driver."""
    return texts.join(rows.hint("merge"), "doc_id")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from docs(doc_id, text, lang) and labels(doc_id, toxic). Rows of labels without a class or document are not learned from.

    A fifth of the labelled rows, by hash of the id, calibrates; all others train. The start is learned from the rows of each class with
    the lowest hashes of their ids: at most `rows_per_class`, so it may be broadcast.
    """
    s = settings
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    texts, trains = docs.select("doc_id", "text", "lang"), rows.filter(~calibrates)
    sizes = {r.toxic: r["count"] for r in trains.groupBy("toxic").count().collect()}
    n_rows = sum(sizes.values())
    if len(sizes) < 2:
        return _constant(sizes.get(1, 0) / n_rows if n_rows else 0.0, s)
    chosen = [trains.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(s.rows_per_class) for c in (0, 1)]
    sample = texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for part, texts_ in slices(batches):
            tokens, bounds = _tokens(texts_, hasher, s)
            own = [tokens[a:b].tobytes() if b - a <= s.sample_words else None for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("toxic"), pa.array(own, pa.binary())], names=["doc_id", "lang", "toxic", "tokens"])

    found = sample.mapInArrow(tokenise, _KEYS + ", tokens binary").filter("tokens is not null").toPandas()
    found = found.sort_values(["doc_id", "toxic", "lang"], kind="stable", ignore_index=True)
    toxic = found["toxic"].to_numpy(float)
    if len(set(toxic)) < 2:
        return _constant(sizes[1] / n_rows, s)
    columns = 1 + len(s.prefixes)
    p = _start([np.frombuffer(t, np.uint16).reshape(-1, columns) for t in found["tokens"]], toxic, s, np.random.default_rng(s.seed))
    model = _model(_pass(_labelled(texts, trains), p, (sizes[0] / n_rows, sizes[1] / n_rows), n_rows, s), s)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = WordHasher(), Model(*shared.value)
        for part, texts_ in slices(batches):
            own = logits(m, *_tokens(texts_, hasher, s))
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(own)], names=["lang", "toxic", "logit"])

    judged = _labelled(texts, rows.filter(calibrates)).select("text", "lang", "toxic")
    _calibrate(model, stored(judged.mapInArrow(judge, "lang string, toxic int, logit double")), s)
    return model


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """Add `score` (0 to 1; null and empty texts have the score of no words) and `toxic_flag`: the score reaches the threshold of the
    row's language, where there is a column lang; languages not calibrated have the threshold of all rows. The score itself sees the text only."""
    docs = docs.drop("score", "toxic_flag")
    shared, names = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values())), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = WordHasher(), Model(*shared.value)
        for part, texts in slices(batches):
            scores = score_tokens(m, *_tokens(texts, hasher, settings))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores)], names=[*names, "score"])

    scored = docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("score")).schema)
    common = F.lit(model.thresholds[None])
    own = {k: v for k, v in model.thresholds.items() if k is not None}
    if own and "lang" in names:
        common = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.col("lang")), common)
    return scored.withColumn("toxic_flag", F.col("score") >= common)
