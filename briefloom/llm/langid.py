"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed by Spark over a bounded sample of labelled rows. The matrix of log-probabilities (languages x buckets) has a fixed
width and a row per language, and is broadcast. Scoring works on slices of texts at once in numpy: n-gram hashes of all code points,
one gather and one segmented sum per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from briefloom.llm.common import slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    # bound of the training sample: about so many labelled rows of each language, chosen by hash
    rows_per_language: int = 2000
    smoothing: float = 0.5
    sample_chars: int = 20_000  # labelled texts beyond this length are not sampled


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, everything but letters a blank; and where each text starts."""
    low = [t.decode("utf-8", "replace").lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(low) + "    ").encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes < 128) & ((codes < 97) | (codes > 122))
    starts = 1 + np.cumsum([0, *(len(t) + 1 for t in low[:-1])]) if low else np.empty(0, np.int64)
    return np.where(blank, np.uint32(32), codes), starts


def _buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram which starts at each code point but the last three."""
    n = len(codes) - 3
    h = np.full(n, order, np.uint32)
    for k in range(order):
        h = (h ^ codes[k:n + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
    return h.astype(np.int32)


def train(labelled: DataFrame, settings: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities) from rows with text and lang; null or blank lang is not learned from.

    The sample takes each row with the chance `rows_per_language` / rows of its language, by the hash of its id.
    """
    rows = labelled.filter("lang is not null and trim(lang) <> ''")
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, 1 << settings.bits), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, settings.rows_per_language / n))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter((chance < share[F.col("lang")]) & (F.length("text") <= settings.sample_chars)).select("lang", "text")
    bits, orders = settings.bits, settings.orders

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in slices(batches):
            codes, starts = _codes(texts)
            langs = part.column("lang").to_pylist()
            ends = [*starts[1:], len(codes) - 3]
            for order in orders:
                buckets = _buckets(codes, order, bits)
                for lang, a, b in zip(langs, starts, ends):
                    own = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                    np.add.at(own, buckets[a:b], 1)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(own[at])})

    summed = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # bounded: languages x buckets
    found = summed.toPandas()
    langs = sorted(counts)
    grams = np.zeros((len(langs), 1 << bits))
    grams[found.lang.map({k: i for i, k in enumerate(langs)}).to_numpy(int), found.bucket.to_numpy(int)] = found["n"].to_numpy(float)
    grams += settings.smoothing
    return langs, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], settings: Settings = Settings()) -> DataFrame:
    """Add lang_pred and score (posterior, equal priors) to rows with a text. Null, no letter, or nothing learned: `und` and 0."""
    langs, table = model
    model_b = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table))
    bits, orders = settings.bits, settings.orders
    docs = docs.drop("lang_pred", "score", "_letter")  # columns of these names are replaced
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    asked = docs.withColumn("_letter", has_letter(F.col("text")))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model_b.value
        for part, texts in slices(batches):
            codes, starts = _codes(texts)
            sums = np.zeros((len(langs), len(texts)))
            for order in orders if langs else ():
                buckets = _buckets(codes, order, bits)
                for i in range(len(langs)):
                    # sums in double: a long text adds up millions of terms; empty texts own one blank
                    sums[i] += np.add.reduceat(logs[i][buckets], starts, dtype=np.float64)
            known = part.column("_letter").to_numpy(zero_copy_only=False) & bool(langs)
            best = sums.argmax(0) if langs else np.zeros(len(texts), int)
            with np.errstate(under="ignore"):
                score = 1 / np.exp(sums - sums.max(0)).sum(0) if langs else np.zeros(len(texts))
            columns = [part.column(c) for c in names]
            columns.append(pa.array([langs[b] if k else UNKNOWN for b, k in zip(best, known)]))
            columns.append(pa.array(np.where(known, score, 0.0)))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    return asked.mapInArrow(run, schema)


def rejects(score: Column, lang_pred: Column, least: float = 0.5) -> Column:
    """No language, or none that holds more than half of the posterior."""
    return (lang_pred == UNKNOWN) | (score < least) | F.isnan(score)
