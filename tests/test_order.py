"""Order keys and distributed places beside plain Python, with one group that holds a third of the rows."""

import io
import random
from contextlib import redirect_stdout

from briefloom.operators import dedup, order
from briefloom.sources import payloads
from pyspark.sql import functions as F


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_long_responses_and_many_sources_keep_their_order(spark):
    n = 1_100_000
    long = spark.range(2).select(F.col("id").alias("payload_order"), F.explode(F.sequence(F.lit(0), F.when(F.col("id") == 0, n - 1).otherwise(2))).alias("pos"))
    rows = long.select(order.sequence(F.col("payload_order"), F.col("pos")).alias("seq"), "payload_order")
    # every entry of the first response is before every one of the second
    ends = rows.groupBy("payload_order").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("a").collect()
    assert [r.payload_order for r in ends] == [0, 1] and ends[0].b < ends[1].a and ends[0].b.pos == n - 1
    small = spark.range(2).select(F.col("id").alias("seq"))
    union = payloads.union_sources(*[small.withColumn("part", F.lit(i)) for i in range(130)])
    assert [(r.part, r.seq.pos) for r in union.orderBy("seq").collect()] == [(i, j) for i in range(130) for j in range(2)]


def test_unions_of_unions(spark):
    part = lambda name: spark.range(2).select(F.col("id").alias("seq"), F.lit(name).alias("p"))
    inner = payloads.union_sources(part("b"), part("c"))
    out = payloads.union_sources(part("a"), inner, part("d")).orderBy("seq").collect()
    assert [r.p for r in out] == ["a", "a", "b", "b", "c", "c", "d", "d"]


def test_earliest_key_is_the_greatest(spark):
    keys = [([1], 0, 5), ([0], 9, 9), ([0, 3], 0, 0), ([0], 9, 8), ([2], -1, 0)]
    df = spark.createDataFrame([(k,) for k in keys], f"seq {order.KEY}")
    got = df.filter("size(seq.source) = 1").agg(F.max_by("seq", order.first_most(df)).alias("x")).first().x
    assert (got.source, got.payload, got.pos) == ([0], 9, 8)
    best = dedup.longest_per_url(df.filter("size(seq.source) = 1").selectExpr("seq", "'u' url", "'d' `desc`")).first()
    assert best.seq.pos == 8


def test_places_without_a_window_over_everything(spark):
    rng = random.Random(8)
    rows = [(i, "hot" if rng.random() < 0.3 else rng.choice("abcdefg"), rng.randint(0, 50)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = order.numbered(df, [F.col("v").desc(), F.col("id")], "place")
        assert "SinglePartition" not in plan(out) and "Window" not in plan(out)
        want = {i: n for n, (i, _, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
        assert {r.id: r.place for r in out.collect()} == want
        grouped = order.numbered(df.withColumn("g", F.when(F.col("g") != "a", F.col("g"))), [F.col("v"), F.col("id")], "place", ["g"])
        assert "SinglePartition" not in plan(grouped)
        got = {r.id: r.place for r in grouped.collect()}
        for g in {r[1] for r in rows}:
            own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
            assert [got[r[0]] for r in own] == list(range(len(own)))
        assert order.numbered(df.limit(0), [F.col("id")], "place").count() == 0
        assert order.numbered(df.limit(0), [F.col("id")], "place", ["g"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_maximum_of_a_hot_group_takes_many_tasks(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 else f"k{rng.randint(0, 400)}", rng.randint(0, 10 ** 6)) for i in range(6000)]
    df = spark.createDataFrame(rows, "seq int, key string, q int").select(order.sequence(F.col("seq"), F.lit(0)).alias("seq"), "key", "q")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = order._laid_out(df, ["key"], [F.col("seq")])
        assert laid.filter("key = 'hot'").select("_part").distinct().count() > 1
        got = {r.s: r.before for r in order.running_max(df, F.col("q"), [F.col("seq")], "before", ["key"]).select("seq.payload", "before").toDF("s", "before").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    most = {}
    for i, k, q in rows:
        assert got[i] == most.get(k)
        most[k] = max(q, most.get(k, q))


def test_landed_files_are_numbered_by_name(spark, tmp_path):
    for name in ("b.json", "a.json", "c.json"):
        (tmp_path / name).write_text('{"hits": [{"title": "%s", "objectID": "1"}, {"title": "second", "objectID": "2"}]}' % name)
    out = payloads.hn_hits(payloads.read_payloads(spark, str(tmp_path))).orderBy("seq").collect()
    assert [r.title for r in out] == [f"[HN] {t}" for n in "abc" for t in (f"{n}.json", "second")]
    landed = spark.createDataFrame([("s", "y"), ("s", "x"), (None, "z"), ("t", "x")], "src string, path string")
    got = {(r.src, r.path): r.payload_order for r in payloads.with_order(landed, by=["src"]).collect()}
    assert got == {("s", "x"): 0, ("s", "y"): 1, (None, "z"): 0, ("t", "x"): 0}


def test_search_results_are_placed_in_all_and_per_run(spark):
    body = '{"items": [{"full_name": "a/a", "html_url": "https://g/a", "stargazers_count": 3}, {"full_name": "b/b", "html_url": "https://g/b", "stargazers_count": 9}]}'
    raw = spark.createDataFrame([(0, "r1", body), (1, "r2", body.replace("b/b", "c/c").replace("g/b", "g/c"))], "payload_order int, run string, payload string")
    stars = spark.createDataFrame([("a/a", "2026-04-01T00:00:00Z")], "repo string, starred_at string")
    since = F.to_timestamp(F.lit("2026-03-30"))
    out = payloads.repo_search(raw.drop("run"), stars, since)
    assert "SinglePartition" not in plan(out)
    assert [(r.seq.pos, r.url[-1]) for r in out.orderBy("seq").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    each = payloads.repo_search(raw, stars, since, ["run"]).orderBy("run", "seq").collect()
    assert [(r.run, r.seq.pos, r.url[-1]) for r in each] == [("r1", 0, "a"), ("r1", 1, "b"), ("r2", 0, "a"), ("r2", 1, "c")]
