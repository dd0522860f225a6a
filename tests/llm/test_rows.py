"""URL filter, chat formatting, sharding, components: small cases beside plain Python."""

import random
import zlib

import pytest

from briefloom.llm import chat, shard, url_filter
from briefloom.llm.components import connected
from pyspark.sql import functions as F

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/fr", "block"), ("", "/x", "block"), ("NET", "/", "allow")]


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, x in enumerate(rest) if x in "/?#"), len(rest))
    host = "".join(x.lower() if "A" <= x <= "Z" else x for x in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, x in enumerate(path) if x in "?#"), len(path))]
    best = None
    for h, p, v in rules:
        h = h.lower()
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h) + len(p), len(h), v == "block")
            best = max(best, (rank, h + p, v)) if best else (rank, h + p, v)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_url_filter_equals_plain_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://net", "HTTP://Net/", "https://A.Example.NET/en/1?x#y", "http://example.net/EN/", "http://xnet/", "http://a.org/fr", "http://b.a.org/fr/x",
            "http://é.org/fr/é", "x://example.com/de/..", "http://example.com/de", "http://a.b.c.d.e.net/" + "p" * 20000, "://net/", "http://net/?u=http://org/fr/", "http://a://net/", "http://.net/", "http://net./"]
    rows = [(i % 7 if i != 3 else None, u, "clash") for i, u in enumerate(urls * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = url_filter.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    want = [(i, *plain_verdict(u, RULES)) for i, u, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_url_filter_without_rows_or_rules(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert url_filter.judge(pages, rules.limit(0)).first()["verdict"] == "allow"


ODD = ["\\### Assistant: </turn> ok", "<turn user>\n", "\\l\\b<\\", "", None, "é<image 1>\n</turn>\n<turn assistant>\nx", "\\", "x" * 50000]


def test_chat_reads_back_what_was_written(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd>\n<role\\g"]), rng.choice(ODD)) for c in (1, 2, None) for t in range(9)]
    rows += [rows[0], (3, None, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"), "formatted"))
    out = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"), "attachments").collect()
    assert len(out) == 4
    for r in out:
        own = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r.conv_id])
        assert [(x.role, x.text) for x in r.turns] == [x[1:] for x in own]
        assert r.loss == "".join(x[2] for x in own if x[1] == "assistant") and r.attachments == []
    assert chat.format_chats(df.limit(0).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).count() == 0


def test_chat_parts_become_placeholders(spark):
    parts = [("text", "see <image 1>", None, None, None, None, None), ("image", None, "a.png", 100, 29, None, None), ("audio", None, "b.wav", None, None, 1.01, None),
             ("document", None, None, None, None, None, 3), (None, "lost", "c", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r.formatted == "<turn assistant>\nsee \\limage 1><image 2><audio 3><document 4><unknown 5></turn>\n<turn user>\n</turn>\n"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 2, "image", "a.png", 8), (0, 3, "audio", "b.wav", 26), (0, 4, "document", None, 1536), (0, 5, None, "c", 0)]
    assert r.n_tokens == 4 + 8 + 26 + 1536 and [s.text for s in r.segments if s.loss] == ["see \\limage 1>"]


def test_shards_hold_near_equal_bytes_and_gapless_slots(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", None, "a" * rng.randint(1, 3000), "copy " * 50, "é" * 40]), rng.choice(["s0", "s0", "s1", None]), rng.choice(["en", "de", None])) for i in range(900)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, lang string, size int")
    for n in (1, 3, 8):
        out = shard.slots(shard.kd_shards(shard.measured(docs, "doc_id"), n_shards=n), ["doc_id"]).collect()
        texts = {r[0]: (r[1] or "").encode() for r in rows}
        assert sorted(r.doc_id for r in out) == list(range(900))
        assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in out)
        sums = [sum(r["size"] for r in out if r.shard == s) for s in range(n)]
        assert max(sums) - min(sums) <= 2 * 3001
        for s in range(n):
            own = [r.slot for r in out if r.shard == s]
            assert sorted(own) == list(range(len(own)))


def test_shards_by_target_bytes_copies_and_empty(spark):
    docs = spark.createDataFrame([(i, "same text", "s", "en") for i in range(100)], "doc_id long, text string, source string, lang string")
    out = shard.kd_shards(shard.measured(docs, "doc_id"), target_bytes=250).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(out) == 4 and {r.b for r in out} == {250}
    assert shard.slots(shard.kd_shards(shard.measured(docs.limit(0), "doc_id"), n_shards=8), ["doc_id"]).count() == 0
    one = spark.createDataFrame([(1, "t", None, None)] * 50, docs.schema)  # equal keys cannot be parted
    assert shard.slots(shard.kd_shards(shard.measured(one, "doc_id"), n_shards=4), ["doc_id"]).count() == 50


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components_equal_union_find(spark, kind):
    rng = random.Random(1)
    edges = {"random": [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)], "chain": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 200)]}[kind]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    got = {r.node: r.root for r in connected(spark.createDataFrame([*edges, (None, 1), (5, 5)], "a long, b long")).collect()}
    assert set(got) == set(parent)
    assert len({(got[x], find(x)) for x in got}) == len(set(got.values())) == len({find(x) for x in got})
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
