"""Token ids in binary files: every id in as many bits as the vocabulary needs, in blocks whose offsets are in the file.

A file is  payload | index | length of the index (8 bytes, little-endian) | MAGIC. Ids are packed from the lowest bit upwards, 64 ids to
`bits` 64-bit words, in blocks of BLOCK ids (the last may be shorter). The index is an Arrow stream: offsets of the blocks, and for each
document its key and where its ids start in the file. So any document is read by one look at the index and the blocks it lies in.

Documents are put in order by a range partitioning, encoded where they then lie, and written by the tasks to the shared folder under
names of their own. The list of files is a Parquet table which Spark commits: what a lost or repeated attempt has written is in no list.
A file is closed when it holds FILE_IDS ids; a document is never split between files.

Odd input: a null text is empty (its end id alone), null keys come first, equal keys in the order of a hash of their texts; equal rows
stay, side by side; a document of any length is one document; an empty table gives an empty list. Only key and text are read.
"""

from __future__ import annotations

import io
import os
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from briefloom.llm.common import slices, table_bytes

MAGIC = b"IDPACK01"
BLOCK = 1 << 14  # ids, a multiple of 64
FILE_IDS = 1 << 24
PART_BYTES = 64 << 20  # of text to a task
_SLICE = 6 << 20
_CHUNK = 1 << 18  # bytes searched at once for places to cut
_AT_ONCE = 1 << 10  # pieces the library gets at once; what it returns takes far more memory than the ids
_KNOWN = 1 << 20  # pieces remembered by a task
_READ_IDS = 1 << 20
_LIST = "part int, number int, name string, bits int, docs long, ids long, size long"


def bits_for(vocabulary: int) -> int:
    """Bits of the highest id."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits to ceil(n / 64) * bits words of 64 bits."""
    n = -(-len(ids) // 64)
    rows = np.zeros(n * 64, np.uint64)
    rows[:len(ids)] = ids
    rows = rows.reshape(n, 64)
    out = np.zeros((n, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed words."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = v & mask
    return out.reshape(-1)[:n].astype(np.uint32)


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder which all tasks share."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


# --- encoding -----------------------------------------------------------------------------------------------------


def piece_starts(data: np.ndarray, signs: bool = True) -> np.ndarray:
    """Where texts may be cut without a change of their ids: before a blank, and before and after a line feed, between two visible
    characters; and (`signs`) before an ASCII sign after an ASCII letter.

    The pre-tokenizer gives a blank before a word to that word, makes a lone line feed a piece, and has no piece with either after
    something else, or with a sign after a letter. Visible are ASCII characters from `!` to `~` and code points whose first byte in
    UTF-8 starts no white space.
    """
    found = [np.empty(0, np.int32)]
    for at in range(0, len(data), _CHUNK):  # the four bytes before a cut and the two after it tell that it is one
        low = max(0, at - 4)
        cuts = _starts(data[low:at + _CHUNK + 2], signs) + low
        found.append(cuts[(cuts >= at) & (cuts < at + _CHUNK)].astype(np.int32))
    return np.concatenate(found)


def _starts(data: np.ndarray, signs: bool) -> np.ndarray:
    if len(data) < 3:
        return np.empty(0, np.int64)
    ascii_, more = (data > 32) & (data < 127), (data & 0xC0) == 0x80
    two, three = (data >= 0xC3) & (data <= 0xDF), (data >= 0xE4) & (data <= 0xEF)
    before = ascii_.copy()  # this byte ends a visible character
    before[1:] |= more[1:] & two[:-1]
    before[2:] |= more[2:] & more[1:-1] & three[:-2]
    after = ascii_ | two | three  # this byte starts one
    alone = before[:-2] & after[2:]
    blank, line = np.flatnonzero(alone & (data[1:-1] == 32)) + 1, np.flatnonzero(alone & (data[1:-1] == 10)) + 1
    cuts = [blank, line, line + 1]
    if signs:
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        digit = (data >= 48) & (data <= 57)
        cuts.append(np.flatnonzero(letter[:-1] & (ascii_ & ~letter & ~digit)[1:]) + 1)
    return np.sort(np.concatenate(cuts), kind="stable")


class Encoder:
    """Ids of whole texts by the tokenizers library. Every distinct piece of a slice is encoded once, often seen ones once per task."""

    def __init__(self, tokenizer: str, by_pieces: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        self.by_pieces = by_pieces
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _library(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, four bytes an id."""
        out: list[bytes] = []
        for at in range(0, len(texts), _AT_ONCE):
            found = self.model.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[at:at + _AT_ONCE]], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in found]
        return out

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not self.by_pieces:
            ids = self._library(texts)
            return np.frombuffer(b"".join(ids), np.uint32), np.array([len(i) // 4 for i in ids], np.int64)
        buffer = b"".join(texts)
        if len(buffer) >= 1 << 31:
            raise ValueError("a slice of texts holds over 2 GB")
        ends = np.cumsum([0, *map(len, texts)])
        # blanks and line feeds at the seam of two texts are no harm: a seam is a cut anyway
        cuts = np.concatenate([ends.astype(np.int32), piece_starts(np.frombuffer(buffer, np.uint8), not any(t in buffer for t in self.added))])
        cuts.sort(kind="stable")
        cuts = cuts[np.append(True, cuts[1:] > cuts[:-1])]
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(buffer)])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        values = [self.known.get(p) for p in distinct]
        unseen = [i for i, v in enumerate(values) if v is None]
        for i, ids in zip(unseen, self._library([distinct[i] for i in unseen])):
            values[i] = ids
        if len(self.known) + len(unseen) > _KNOWN:  # those which come again in this slice stay
            again = np.flatnonzero(np.bincount(coded.indices.to_numpy(), minlength=len(distinct)) > 1)[:_KNOWN].tolist()
            self.known = {distinct[i]: values[i] for i in again if len(distinct[i]) <= 64}
        self.known.update((distinct[i], values[i]) for i in unseen[:_KNOWN - len(self.known)] if len(distinct[i]) <= 64)
        if not len(coded):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        joined = pa.array(values, pa.large_binary()).take(coded.indices)  # the ids of all pieces, four bytes an id
        after, data = np.frombuffer(joined.buffers()[1], np.int64), np.frombuffer(joined.buffers()[2] or b"", np.uint32)
        at = after[np.searchsorted(cuts, ends)] // 4
        return data[:at[-1]], np.diff(at)


# --- files --------------------------------------------------------------------------------------------------------


class _File:
    """One file being written; blocks leave as soon as they are full."""

    def __init__(self, system: pafs.FileSystem, path: str, bits: int):
        self.out, self.bits = system.open_output_stream(path), bits
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.size = 0
        self.blocks, self.keys, self.starts = [0], [], [0]

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate([np.empty(0, np.uint32), *self.waiting])
        for at in range(0, n, BLOCK):
            data = pack(ids[at:min(n, at + BLOCK)], self.bits)
            self.out.write(data)
            self.size += len(data)
            self.blocks.append(self.size)
        self.waiting, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        index, sink = {"blocks": pa.array([self.blocks], pa.list_(pa.int64())), "keys": pa.array([self.keys], pa.list_(pa.int64())), "starts": pa.array([self.starts], pa.list_(pa.int64()))}, io.BytesIO()
        batch = pa.RecordBatch.from_pydict(index)
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        self.out.write(sink.getvalue() + len(sink.getvalue()).to_bytes(8, "little") + MAGIC)
        self.out.close()


class TokenFile:
    """A file read at random: `document(i)`, or `documents(a, b)` as one array of ids."""

    def __init__(self, system: pafs.FileSystem, path: str, bits: int):
        self.file, self.bits = system.open_input_file(path), bits
        end = self.file.size()
        self.file.seek(end - 16)
        tail = self.file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no complete token file")
        n = int.from_bytes(tail[:8], "little")
        self.file.seek(end - 16 - n)
        index = pa.ipc.open_stream(self.file.read(n)).read_next_batch()
        self.keys = index.column("keys")[0].values
        self.blocks, self.starts = (index.column(c)[0].values.to_numpy() for c in ("blocks", "starts"))

    def __len__(self) -> int:
        return len(self.keys)

    def documents(self, a: int, b: int) -> np.ndarray:
        """Ids of documents a to b - 1; only the blocks they lie in are read."""
        low, high = int(self.starts[a]), int(self.starts[b])
        if low == high:
            return np.empty(0, np.uint32)
        first, last = low // BLOCK, -(-high // BLOCK)
        self.file.seek(int(self.blocks[first]))
        ids = unpack(self.file.read(int(self.blocks[last] - self.blocks[first])), self.bits, high - first * BLOCK)
        return ids[low - first * BLOCK:]

    def document(self, i: int) -> np.ndarray:
        return self.documents(i, i + 1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts of about _SLICE bytes at a time: a distinct piece costs the same in a slice of any size."""
    keys, texts, size = [], [], 0
    for batch, some in slices(batches, "text", _SLICE):
        keys += batch.column("key").to_pylist()
        texts += some
        size += sum(map(len, some))
        if size >= _SLICE:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int | None = 0, key: str = "doc_id", text: str = "text",
                 by_pieces: bool = True, part_bytes: int = PART_BYTES, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode docs and write them to `path` in ascending key order; returns the list of files.

    `tokenizer` is a file of the tokenizers library which every worker can read. `by_pieces` relies on its splitting texts before a blank
    (the byte-level pre-tokenizer does); without it, whole texts go through the library.
    """
    spark, bits = docs.sparkSession, bits_for(vocabulary)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(1, -(-table_bytes(rows, "text") // part_bytes), min(spark.sparkContext.defaultParallelism, 64))
    order = ["key", "_hash", "_row"]
    placed = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(parts, *order)
    folder = f"{path.rstrip('/')}/ids"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), Encoder(tokenizer, by_pieces)
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        done: list[tuple] = []
        file = name = None

        def close() -> None:
            file.close()
            done.append((part, len(done), name, bits, len(file.keys), file.ids, file.size))

        for keys, texts in _gathered(batches):
            ids, counts = encode(texts)
            at = 0
            for k, n in zip(keys, counts.tolist()):
                own = ids[at:at + n]
                at += n
                if file is None:
                    name = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.ids"
                    file = _File(system, f"{root}/{name}", bits)
                file.add(k, own if end_id is None else np.append(own, np.uint32(end_id)))
                if file.ids >= file_ids:
                    close()
                    file = None
        if file is not None:
            close()
        names = [f.split()[0] for f in _LIST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)

    files = placed.sortWithinPartitions(*order).select("key", "text").mapInArrow(write, _LIST)
    files.write.parquet(f"{path.rstrip('/')}/files")
    return file_list(spark, path)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder in order, and the number of ids before each (a row per file)."""
    files = spark.read.schema(_LIST).parquet(f"{path.rstrip('/')}/files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Documents from the files: key, start (ids before it in the whole order), n_tokens, ids (binary, little-endian, 32 bits each)."""
    folder = f"{path.rstrip('/')}/ids"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                file, at = TokenFile(system, f"{root}/{row['name']}", row["bits"]), 0
                while at < len(file):
                    to = max(at + 1, int(np.searchsorted(file.starts, file.starts[at] + _READ_IDS, "right")) - 1)
                    to = min(to, len(file))
                    ids = file.documents(at, to).astype("<u4").tobytes()
                    starts = file.starts[at:to + 1]
                    yield pa.RecordBatch.from_arrays(
                        [file.keys.slice(at, to - at), pa.array(starts[:-1] + row["before"]), pa.array(np.diff(starts)),
                         pa.array([ids[4 * (a - starts[0]):4 * (b - starts[0])] for a, b in zip(starts, starts[1:])], pa.large_binary()).cast(pa.binary())],
                        [key, "start", "n_tokens", "ids"],
                    )
                    at = to

    files = file_list(spark, path)
    return files.repartition(max(1, files.count()), "part", "number").mapInArrow(read, f"{key} long, start long, n_tokens long, ids binary")
