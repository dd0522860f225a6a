"""Cross-run de-duplication on streams, keyed state with a time to live from first sight."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 512
_US = "us_"  # names which start with an underscore are lost on the way to Python
_NO_MOMENT = -(1 << 63) // 1000  # a null moment is the earliest one that 64 bits of nanoseconds hold, in 1677
_ENTRIES = 10_000  # of a list sent to the state at once
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A watermark needs TIMESTAMP; zone-less columns are taken as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str = "ts", ttl: str = "26 hours") -> DataFrame:
    """First row of each key within the watermark. Keys are held until the stream has moved on by `ttl`."""
    return with_event_time(df, ts).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(list(keys))


def _as_text(name: str, kind: T.DataType):
    """A part of a key as text which tells all its values apart; null stays null."""
    part = F.col(name)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.when(part.isNotNull(), F.to_json(F.struct(part.alias("v")), _JSON))
    if isinstance(kind, T.TimestampType):
        part = F.unix_micros(part)
    elif isinstance(kind, T.BinaryType):
        part = F.hex(part)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        part = F.when(part == 0, F.abs(part)).otherwise(part)  # -0.0 and 0.0 are one key
    return part.cast("string")


def _from_text(name: str, kind: T.DataType):
    part = F.col(name)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.from_json(part, T.StructType([T.StructField("v", kind)]), _JSON)["v"]
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(part.cast("long"))
    return F.unhex(part) if isinstance(kind, T.BinaryType) else part.cast(kind)


def first_sights(key: np.ndarray, us: np.ndarray, seen: np.ndarray, seen_us: np.ndarray, ttl_us: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows which pass, last first sight of each key) of rows in ascending order of (key, us).

    Keys are numbers from 0 on, `seen` those with a first sight before the rows, at `seen_us`. A row passes when its key has no first
    sight yet or when that lies more than `ttl_us` before it.
    """
    n = max(key.max(initial=-1), seen.max(initial=-1)) + 1

    def beyond(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of rows up to (of, at + ttl_us): the place of the first row beyond."""
        asks = np.repeat([False, True], [len(key), len(of)])
        order = np.lexsort((asks, np.concatenate([us, at + ttl_us]), np.concatenate([key, of])))
        places = np.empty(len(order), np.int64)
        places[order] = np.cumsum(~asks[order])
        return places[len(key):]

    after, ends = beyond(key, us), np.searchsorted(key, np.arange(n), "right")
    at, last = np.searchsorted(key, np.arange(n), "left"), np.zeros(n, np.int64)
    at[seen], last[seen] = beyond(seen, seen_us), seen_us
    passed, of = np.zeros(len(key), bool), np.arange(n)
    while True:  # all keys go together from a moment that passes straight to the first one beyond its time to live
        more = at < ends[of]
        at, of = at[more], of[more]
        if not len(at):
            return np.flatnonzero(passed), last
        passed[at], last[of] = True, us[at]
        at = after[at]


class _FirstSight(StatefulProcessor):
    """Passes a row when its key is new or was first seen more than `ttl` before; sights in between change nothing.

    A group is a bucket of keys; its state is a list of (parts of the key, last first sight).
    """

    def __init__(self, parts: list[str], ttl_us: int):
        self.parts, self.ttl_us = parts, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField(p, T.StringType()) for p in self.parts]
        self.seen = handle.getListState("seen", T.StructType([*fields, T.StructField(_US, T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = [*self.parts, _US]
        held = list(self.seen.get()) if self.seen.exists() else []
        # of a batch only the distinct moments are held; the source bounds a batch (maxBytesPerTrigger)
        chunks = [chunk[columns].drop_duplicates() for chunk in rows]
        both = pd.concat([pd.DataFrame(held, columns=columns), *chunks] if held else chunks, ignore_index=True)
        number = both.groupby(self.parts, dropna=False, sort=False).ngroup().to_numpy()
        us = both[_US].to_numpy(np.int64)
        order = np.lexsort((us[len(held):], number[len(held):])) + len(held)
        found, last = first_sights(number[order], us[order], number[:len(held)], us[:len(held)], self.ttl_us)
        passed = order[found]
        # rows of later batches lie past the watermark: a first sight with its time to live before that decides none of them
        live = last + self.ttl_us > timerValues.getCurrentWatermarkInMs() * 1000
        if len(passed) or not live.all():
            _, first = np.unique(number, return_index=True)
            kept = both[self.parts].iloc[first[live]].astype(object)
            entries = list(zip(*(kept[p].where(kept[p].notna(), None) for p in self.parts), last[live].tolist()))
            self._clear()
            for at in range(0, len(entries), _ENTRIES):
                self.seen.appendList(entries[at:at + _ENTRIES])
            if entries:
                # state of a bucket without rows is dropped once the watermark is past the last time to live in it
                self.handle.registerTimer((int(last[live].max()) + self.ttl_us) // 1000 + 1)
        if len(passed):
            yield both.iloc[passed]

    def _clear(self) -> None:
        self.seen.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_first_sight(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", ttl_hours: float = 26, lateness: str = "26 hours", buckets: int = BUCKETS
) -> DataFrame:
    """(keys, ts) of the rows which pass, with exact expiry counted from first sight in event time.

    Needs the RocksDB state provider (`spark.sql.streaming.stateStore.providerClass`). Python is called once per bucket of keys, not
    per key; `buckets` belongs to a checkpoint. A key lives on one task: reduce hot keys before, or use the run-wise form in
    `runs.py`, whose cost does not depend on the number of copies.
    """
    typed = with_event_time(df, ts).withWatermark(ts, lateness)
    kinds = {f"key{i}_": typed.schema[k].dataType for i, k in enumerate(keys)}
    texts = [_as_text(k, kind).alias(p) for k, (p, kind) in zip(keys, kinds.items())]
    bucket = F.pmod(F.xxhash64(*kinds), F.lit(buckets)).alias("bucket_")
    rows = typed.select(*texts, ts, F.coalesce(F.unix_micros(ts), F.lit(_NO_MOMENT)).alias(_US)).select("*", bucket)
    schema = T.StructType([*(T.StructField(p, T.StringType()) for p in kinds), T.StructField(_US, T.LongType())])
    processor = _FirstSight(list(kinds), int(ttl_hours * 3_600_000_000))
    out = rows.groupBy("bucket_").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select(*(_from_text(p, kind).alias(k) for k, (p, kind) in zip(keys, kinds.items())), F.timestamp_micros(_US).alias(ts))
