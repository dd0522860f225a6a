"""What the operators share: reading, intermediate tables, and hashing of words over whole Arrow slices in numpy.

Texts reach the tasks as Arrow batches. A slice of them is joined to one byte buffer; words are found and hashed there without a
Python object per word. The hash of a word is a polynomial over its bytes, modulo 2**64, and mixed.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from briefloom.session import checkpoint_root

SLICE_BYTES = 2 << 20
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_folders: set[str] = set()


# Rows of texts which Spark hands to a task at once. The default of 10,000 is made for rows of numbers.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it again: cuts lineage, survives lost executors.

    The folder is removed when this Python process ends in the ordinary way.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/briefloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _folders:
        atexit.register(_remove_folders, spark)
    _folders.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _remove_folders(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None:  # the session is gone; the folder's owner cleans up
        return
    for path in _folders:
        _remove(spark, path)


def held_out(divisor: int, remainder: int, key: str = "doc_id"):
    """crc32 of the id as text has this remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(divisor)) == remainder, F.lit(False))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches into slices of about `limit` bytes of text, one row at least; with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at).cast(pa.binary()).to_pylist()
            at = to


def byte_table(separators: bytes, lower: bool = True) -> tuple[bytes, np.ndarray]:
    """Translation which lower-cases A-Z, and which bytes belong to words."""
    fold = bytes(b + 32 if lower and 65 <= b <= 90 else b for b in range(256))
    word = np.ones(256, bool)
    word[list(separators)] = False
    return fold, word


WHITE = byte_table(b" \t\n\x0b\x0c\r")
ALNUM = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))
LETTERS = byte_table(bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)))


def words(texts: list[bytes], kind: tuple[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, bounds): the words of all texts; those of text i are bounds[i] to bounds[i + 1].

    The texts are joined by a line feed, a separator in every kind, so no word crosses texts.
    """
    fold, member = kind
    buffer = np.frombuffer(b"\n".join(texts).translate(fold), np.uint8)
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = member[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buffer, starts, ends, np.searchsorted(starts, at)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser which spreads every input bit over 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of byte spans; the powers it needs are kept between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)
        self.values = mix(np.arange(1, 257, dtype=np.uint64))

    def __call__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # a chunk holds whole words
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + _CHUNK, "right")))
            n = int(ends[to - 1] - low)
            if n >= len(self.up):
                self.up, self.down = powers(_BASE, n + _CHUNK), powers(pow(_BASE, -1, 1 << 64), n + _CHUNK)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.values[buffer[low:low + n]] * self.up[:n], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64))
            at = to
        return out


def table_bytes(rows: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column of texts."""
    return int(rows.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def folder(spark: SparkSession) -> str:
    """A new folder in the shared place, removed like those of `stored`."""
    path = f"{checkpoint_root(spark)}/briefloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_remove_folders, spark)
    _folders.add(path)
    return path
