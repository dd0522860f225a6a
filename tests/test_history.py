import io
from concurrent.futures import ThreadPoolExecutor
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from briefloom import schemas
from briefloom.operators import history as hist
from briefloom.sources.tables import HistoryTable, VersionTaken, repair_history

NOW = datetime(2026, 4, 12, 12)
now = lambda: F.lit(NOW).cast("timestamp")


def batch(spark, *prints):
    return spark.createDataFrame([("c", p, i) for i, p in enumerate(prints, 1)], "category string, fingerprint string, rank int")


def past(spark, **hours):
    return spark.createDataFrame([("c", k, NOW - timedelta(hours=h), 0) for k, h in hours.items()], schemas.HISTORY)


def test_ttl_counts_from_first_sight(spark):
    for ttl, inside, outside in ((12, 6, 13), (26, 20, 28), (26, 26, 26.01)):
        active = hist.active_history(past(spark, a=inside, b=outside), now(), ttl)
        assert [r.fingerprint for r in active.collect()] == ["a"]


def test_skips_only_what_was_met(spark):
    fresh, met = hist.filter_new(batch(spark, "a", "x", "x", "y", "a", "z"), past(spark, a=1), 2)
    assert [r.fingerprint for r in fresh.orderBy("rank").collect()] == ["x", "y"]
    assert [(r.fresh, r.skipped) for r in met.collect()] == [(2, 2)]
    fresh, met = hist.filter_new(batch(spark, "a", "a"), past(spark, a=1), 2)
    assert fresh.count() == 0 and [(r.fresh, r.skipped) for r in met.collect()] == [(0, 2)]
    assert hist.all_seen_fallback(fresh, batch(spark, "a", "a"), 1).count() == 1


def test_remember_keeps_first_sight_and_cap(spark):
    out = hist.remember(past(spark, a=20, old=30), batch(spark, "a", "b", "c"), now(), cap=2)
    assert {(r.fingerprint, r.seen_at) for r in out.collect()} == {("b", NOW), ("c", NOW)}
    out = hist.remember(past(spark, a=20), batch(spark, "a", "b"), now())
    assert {(r.fingerprint, r.seen_at) for r in out.collect()} == {("a", NOW - timedelta(hours=20)), ("b", NOW)}


def test_table_versions_and_repair(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "history"))
    assert table.read().count() == 0
    table.write(past(spark, a=1))
    table.write(past(spark, a=1, b=2))
    table.write(past(spark, z=1), version=1)  # exists: a retried run changes nothing
    assert table.versions() == [0, 1] and table.read().count() == 2 and table.read(version=1).count() == 1
    rough = spark.createDataFrame([("c", "a", "2026-04-12T00:00:00"), ("c", "b", "junk"), ("c", "", "x"), (None, "q", None)], "category string, fingerprint string, seen_at string")
    assert {(r.fingerprint, r.seen_at) for r in repair_history(rough, now()).collect()} == {("a", datetime(2026, 4, 12)), ("b", NOW)}


def test_a_broken_version_falls_back_to_the_one_before(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "history"))
    rows = spark.sql("SELECT 'ai_news' AS category, 'f1' AS fingerprint, timestamp'2025-11-20 09:00:00' AS seen_at, 1L AS pos UNION ALL SELECT NULL, 'f2', NULL, 2L")
    assert table.read().count() == 0
    table.write(rows)
    table.write(rows)
    assert table.read().count() == 1  # the row without a category is repaired away
    for part in (tmp_path / "history" / "version=1").glob("part-*"):
        part.write_bytes(b"no parquet")
    for crc in (tmp_path / "history" / "version=1").glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        table.read().count()
    assert [r.fingerprint for r in table.read(on_error="empty").collect()] == ["f1"]


def test_of_two_writers_one_gets_the_version(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "history"))
    table.write(past(spark, a=1))
    table.write(past(spark, b=1), after=0)
    with pytest.raises(VersionTaken):
        table.write(past(spark, c=1), after=0)  # made from version 0, which is not the newest any more
    assert table.write(past(spark, d=1)) == 2 and table.versions() == [0, 1, 2]
    raced = []

    def change(history):
        if not raced:  # another writer publishes while this one computes
            raced.append(table.write(past(spark, e=1)))
        return history.unionByName(past(spark, f=1))

    assert table.update(change) == 4
    assert {r.fingerprint for r in table.read().collect()} == {"e", "f"}
    # work which is done is not done again, whatever was published since
    assert table.write(past(spark, g=1), tag="run-1") == 5 and table.write(past(spark, h=1)) == 6
    assert table.write(past(spark, i=1), tag="run-1") == 5 and table.versions()[-1] == 6
    assert not [n for n in table._names() if n.startswith("staged")]


def test_two_threads_publish_different_versions(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "history"))
    rows = [past(spark, **{f"k{i}": 1}) for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(table.write, rows))
    assert sorted(got) == list(range(6)) == table.versions()
    assert {r.fingerprint for v in range(1, 7) for r in table.read(version=v).collect()} == {f"k{i}" for i in range(6)}


def test_history_in_buckets_is_not_shuffled(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "history"), buckets=4)
    kind = F.when(F.col("id") % 2 == 0, "c").otherwise("d").alias("category")
    entries = spark.range(500).select(kind, F.col("id").cast("string").alias("fingerprint"), now().alias("seen_at"), F.col("id").alias("pos"))
    table.write(entries)
    items = spark.range(400, 600).select(kind, F.col("id").cast("string").alias("fingerprint"), F.col("id").alias("rank"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        active = hist.active_history(table.read(), now(), cap=None)
        out = hist.anti_history(items, active)
        shown = io.StringIO()
        with redirect_stdout(shown):
            out.explain()
        # the items go to the buckets; the history stays where it is
        assert shown.getvalue().count("Exchange hashpartitioning") == 1 and out.count() == 100
        fresh, _ = hist.filter_new(items, active, 10)
        shown = io.StringIO()
        with redirect_stdout(shown):
            fresh.explain()
        own = shown.getvalue().split("SortMergeJoin", 1)[1].split("\n")
        history_side = own[next(i for i, line in enumerate(own) if "+- Sort" in line and ":" not in line.split("+-")[0]):]
        assert "Bucketed: true" in "\n".join(history_side) and "Exchange" not in "\n".join(history_side)
        assert sorted(r.rank for r in fresh.collect()) == list(range(500, 520))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
