"""Scheduled incremental runs: each trigger takes what has landed since the last one through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from briefloom.operators import history as hist
from briefloom.sources.tables import HistoryTable


def run_batch(
    batch: DataFrame, table: HistoryTable, epoch: int, limit: int, now: Column, out: str, ttl_hours: float = hist.TTL_HOURS,
    cap: int = hist.CAP, name: str = "runs",
) -> None:
    """One run: unseen items of the batch to `out`, then the history version of this epoch.

    `batch`: category, fingerprint, rank and what the output should carry. `name` tells the streams over one history apart. The version
    an epoch wrote carries its name and number: a retried epoch reads the versions before its own, overwrites its own output, and
    publishes no second version, wherever the first attempt broke off. The history may have versions of other writers.
    """
    tag = f"{name}-{epoch}"
    known = table.versions()
    done = table.version_of(tag)
    history = table.read(version=done)
    active = hist.active_history(history, now, ttl_hours, cap)
    fresh, _ = hist.filter_new(batch, active, limit)
    target = f"{out}/epoch={epoch}"
    fresh.write.mode("overwrite").parquet(target)
    written = batch.sparkSession.read.parquet(target)
    if done is None:
        table.write(hist.remember(history, written, now, cap, ttl_hours), after=known[-1] if known else -1, tag=tag)


def start_runs(
    stream: DataFrame,
    rank: Callable[[DataFrame], DataFrame],
    table: HistoryTable,
    out: str,
    checkpoint: str,
    limit: int,
    now: Callable[[DataFrame], Column] | None = None,
    name: str = "runs",
) -> StreamingQuery:
    """Process everything available, then stop; start it as often as the schedule asks. A run which fails is repeated by the next start.

    `rank` turns a micro-batch into ranked rows with fingerprints. `now` gives the clock of a run (default: wall clock).
    """

    def each(batch: DataFrame, epoch: int) -> None:
        clock = now(batch) if now else F.current_timestamp()
        run_batch(rank(batch), table, epoch, limit, clock, out, name=name)

    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
