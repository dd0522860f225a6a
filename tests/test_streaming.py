import random
from datetime import datetime, timedelta

from briefloom.sources.tables import HistoryTable
from briefloom.streaming import dedup as sd, runs
from pyspark.sql import functions as F

T0 = datetime(2026, 4, 1)


def land(spark, path, rows):
    data = [(k, T0 + timedelta(hours=h)) for k, h in rows]
    spark.createDataFrame(data, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(path))


def drain(spark, df, root):
    q = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def test_first_sight_over_restarts(spark, tmp_path):
    source = tmp_path / "in"
    land(spark, source, [("a", 0), ("a", 10), ("b", 1)])
    stream = lambda: sd.stream_first_sight(spark.readStream.schema("k string, ts timestamp").parquet(str(source)), ["k"], "ts", 26, "100 hours")
    drain(spark, stream(), tmp_path)
    land(spark, source, [("a", 20), ("a", 27), ("a", 40), ("b", 26)])
    out = drain(spark, stream(), tmp_path)
    hours = sorted((r.k, (r.ts - T0).total_seconds() / 3600) for r in out.collect())
    # 27 is past 26 hours after the first sight at 0; 10 and 20 do not extend it
    assert hours == [("a", 0), ("a", 27), ("b", 1)]


def test_first_sight_calls_python_by_bucket(spark, tmp_path, monkeypatch):
    """Far fewer calls than keys; and over restarts each key has the rows which a plain walk passes, for keys of any type and null."""
    rng = random.Random(5)
    schema = "k string, n long, d double, b binary, t timestamp, l array<string>, ts timestamp"
    kinds = [
        (rng.choice(["a", "1", "", None]), rng.choice([1 << 60, (1 << 60) + 1, None]), rng.choice([0.0, -0.0, 0.1, None]),
         rng.choice([b"", b"\xff", None]), rng.choice([T0, T0 + timedelta(microseconds=1), None]), rng.choice([["a, b"], ["a", "b"], [None], None]))
        for _ in range(300)
    ]
    calls, source = spark.sparkContext.accumulator(0), str(tmp_path / "in")
    plain = sd._FirstSight.handleInputRows

    def counted(self, key, rows, timers):
        calls.add(1)
        yield from plain(self, key, rows, timers)

    monkeypatch.setattr(sd._FirstSight, "handleInputRows", counted)
    keys, want, last = ["k", "n", "d", "b", "t", "l"], [], {}
    for batch in range(3):
        rows = [(*rng.choice(kinds), T0 + timedelta(hours=40 * batch + rng.randrange(40), microseconds=rng.randrange(3))) for _ in range(2000)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        out = drain(spark, sd.stream_first_sight(stream, keys, "ts", 26, "1000 hours", buckets=4), tmp_path)
        for *key, ts in sorted(rows, key=lambda r: r[-1]):
            key = repr([v + 0.0 if isinstance(v, float) else v for v in key])
            if key not in last or ts - last[key] > timedelta(hours=26):
                last[key] = ts
                want.append((key, ts))
    got = [(repr([bytes(v) if isinstance(v, bytearray) else v for v in r[:-1]]), r.ts) for r in out.collect()]
    assert sorted(got) == sorted(want) and len(last) > 100
    assert 0 < calls.value <= 12


def test_runs_share_history(spark, tmp_path):
    source = tmp_path / "in"
    history = HistoryTable(spark, str(tmp_path / "history"))

    def rank(batch):
        return batch.select(F.lit("c").alias("category"), F.col("k").alias("fingerprint"), F.unix_micros("ts").alias("rank"))

    def run():
        stream = spark.readStream.schema("k string, ts timestamp").parquet(str(source))
        clock = lambda _: F.lit(T0).cast("timestamp")
        runs.start_runs(stream, rank, history, str(tmp_path / "fresh"), str(tmp_path / "state"), 10, clock).awaitTermination()

    land(spark, source, [("a", 0), ("a", 1), ("b", 2)])
    run()
    land(spark, source, [("b", 3), ("c", 4)])
    run()
    fresh = spark.read.option("basePath", str(tmp_path / "fresh")).parquet(str(tmp_path / "fresh" / "epoch=*"))
    assert sorted((r.epoch, r.fingerprint) for r in fresh.collect()) == [(0, "a"), (0, "b"), (1, "c")]
    assert history.versions() == [0, 1]
