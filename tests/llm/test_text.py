"""Toxicity, language ID, BPE, decontamination, Jaccard join, embeddings and language-model scores beside brute force."""

import collections
import functools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from briefloom.llm import bpe, decontam, embed_dedup, jaccard, langid, lm_score, toxicity
from briefloom.llm.common import held_out
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DOCS = "doc_id long, text string, lang string"
ODD = [None, "", " \n\t", "é", "12 34 !?", "\x00\x1c", "a" * 30000, "x y " * 9000, "İ", "中文 字"]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "en", 0.5, "clash") for i, t in enumerate(ODD + ODD[:3])] + [(None, "null id", None, None, None)], DOCS + ", score double, lang_pred string")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_held_out_is_crc32_of_the_id_as_text(spark):
    rows = spark.createDataFrame([(i,) for i in range(-20, 200)] + [(None,)], "doc_id long").select("doc_id", held_out(3, 1).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and crc(r.doc_id, 3) == 1) for r in rows)


# --- 5 ---


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.filter(~held_out(4, 2)))
    rows = langid.predict(docs, model).filter(held_out(4, 2)).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    docs = odd_docs(spark)
    model = langid.train(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise(" ")))
    out = langid.predict(docs, model).collect()
    assert len(out) == len(ODD) + 4 and out[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


# --- 1 ---


def test_toxicity_learns_from_all_rows(spark):
    """A word which is in no row of the starting sample, only in rows (one of them very long) beyond its bounds."""
    s = toxicity.Settings(rows_per_class=40, sample_words=30, steps=200, shard_rows=400, pass_rate=0.02)
    rng = random.Random(4)
    fill = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(n))
    rows = [(i, f"{fill(8)} vilewort" if i % 6 == 0 else f"{fill(35)} zurkel" if i % 3 == 0 else fill(9 + i % 40), "en", int(i % 3 == 0)) for i in range(1800)]
    df = spark.createDataFrame(rows, DOCS + ", toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"), s)
    new = spark.createDataFrame([(1, fill(10) + " zurkel", "en"), (2, fill(10) + " vilewort", "en"), (3, fill(11), "en")], DOCS)
    scores = {r.doc_id: r.score for r in toxicity.score(new, model, s).collect()}
    assert min(scores[1], scores[2]) > 0.7 > scores[3]
    again = toxicity.train(df.repartition(7), df.select("doc_id", "toxic").repartition(3), s)
    scores = {r.doc_id: r.score for r in toxicity.score(new, again, s).collect()}
    assert min(scores[1], scores[2]) > 0.7 > scores[3]


def test_toxicity_deals_texts_alike_on_any_size(spark):
    """Few labels must not be broadcast where many are not: the shuffle would grow faster than the input."""
    texts = spark.createDataFrame([(i % 50, f"t{i}", "en") for i in range(60)] + [(None, "x", "en")], DOCS)
    found = toxicity._labelled(texts, spark.createDataFrame([(i, i % 2) for i in (*range(40), 7)] + [(None, 1)], "doc_id long, toxic int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.columns == ["doc_id", "text", "lang", "toxic"] and sorted(r.text for r in found.collect()) == sorted(f"t{i}" for i in range(60) for _ in range((i % 50 < 40) + (i % 50 == 7)))


def test_toxicity_learns_words_and_roots(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(700):
        text = [word() for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["Vilewort", "zurk" + word()])
        rows.append((i, " ".join(text), "en", int(bad)))
    df = spark.createDataFrame(rows, DOCS + ", toxic int")
    settings = toxicity.Settings(steps=300)
    model = toxicity.train(df.filter("doc_id < 500"), df.select("doc_id", "toxic"), settings)
    held = toxicity.score(df.filter("doc_id >= 500"), model, settings).collect()
    found = [r for r in held if r.score >= 0.7]
    assert sum(r.toxic for r in found) >= 0.9 * sum(r.toxic for r in held) and sum(r.toxic for r in found) >= 0.9 * len(found)
    odd = odd_docs(spark)
    out = toxicity.score(odd, model, settings).collect()
    assert len(out) == len(ODD) + 4 and all(0 <= r.score <= 1 and r.toxic_flag is not None for r in out)
    assert toxicity.score(odd.limit(0), model, settings).count() == 0
    blind = toxicity.train(df, df.select("doc_id", F.lit(None).cast("int").alias("toxic")), settings)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, blind, settings).collect())


def test_long_texts_are_scored_in_chunks():
    rng = np.random.default_rng(0)
    s = toxicity.Settings()
    model = toxicity.fit([rng.integers(1, 999, (20, 5)).astype(np.uint16) for _ in range(40)], np.arange(40) % 2 * 1.0, ["en"] * 40, toxicity.Settings(steps=5))
    tokens = rng.integers(1, 32767, (300_000, 1 + len(s.prefixes))).astype(np.uint16)
    bounds = np.array([0, 7, 7, 200_000, 300_000])
    whole = toxicity.score_tokens(model, tokens, bounds)
    parts = [toxicity.score_tokens(model, tokens[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds, bounds[1:])]
    assert np.allclose(whole, parts)


# --- 7 ---


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, coder):
    ranks, library = coder
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x250)] + list("中文😀 '\u2028\u3000\x85") + ["'ll", " the", "  ", "<|endoftext|>"] * 30
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["ab" * 60000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for share in (1e-6, 2.0):  # with and without words encoded beforehand
        tokens = bpe.encode(docs, ranks, public_tokenizers.PATTERN, share)
        out = {r.doc_id: r for r in bpe.decode(tokens, ranks).collect()}
        for i, t in enumerate(texts):
            assert out[i].ids == library.encode_ordinary(t or ""), repr(t)[:80]
            assert bytes(out[i].decoded) == (t or "").encode()
    assert bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_fold_column_equals_fold_in_tasks(spark, coder):
    ranks, _ = coder
    rng = random.Random(6)
    words = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 12))) for _ in range(100)] + [b" tokenization", b"aaaaaaaaaaaaaaaa", "éèê".encode()]
    df = spark.createDataFrame([(w,) for w in words], "w binary").repartition(4)
    for r in df.select("w", bpe.fold(F.col("w"), bpe.rank_literal(ranks)).alias("ids")).collect():
        assert tuple(r.ids) == bpe.fold_bytes(bytes(r.w), ranks)


def test_bpe_plans_do_not_hold_the_ranks(spark, coder, monkeypatch):
    ranks, library = coder
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    plans, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: plans.append(df._jdf.queryExecution().toString()) or collect(df))
    found = bpe.frequent_words(docs, ranks, public_tokenizers.PATTERN)
    assert found and all(list(ids) == library.encode_ordinary(word) for word, ids in found.items())
    assert plans and max(map(len, plans)) < 100_000  # the ranks alone are more than a million characters


def test_words_folded_together_equal_words_folded_alone(coder):
    ranks, _ = coder
    rng, pieces = random.Random(16), list(ranks)
    words = [bytes(rng.randrange(256) for _ in range(rng.randrange(50))) for _ in range(500)] + [b"", b"a" * 39, b"ab" * 3000]
    words += [b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    some = {b"a": 7, b"ab": 2, b"bc": 9, b"abc": 4, b"c": 1, b"ca": 3}  # b has no rank, but pieces of it have
    for table, own in ((ranks, words), (some, [b"abc", b"cabc", b"aabca", b"acabab", b"abcabcab", b"ca", b"cca"])):
        ids, counts = bpe.fold_words(own, table, bpe.read_pairs(table))
        assert [tuple(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [bpe.fold_bytes(w, table) for w in own]
    with pytest.raises(KeyError):
        bpe.fold_words([b"cb"], some, bpe.read_pairs(some))


# --- 8 ---


def plain_contamination(docs, items):
    import re

    rx = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: rx.findall((t or "").encode().translate(LOWER))
    windows = collections.defaultdict(set)
    for k, t in items:
        w = cut(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[s:s + 13])].add(str(k))
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s:s + n]))):
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(6)] + ["É", "x-y", "中"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([40, 13, 14, 12, 3, 20, 0, 13])] + [(8, None), (9, "W1 w2,W3"), (1, "again " + say(15))]
    items.append((10, items[0][1]))
    docs = [(i, rng.choice(["", say(5) + " ", "ZZ "]) + rng.choice([t for _, t in items if t] + [say(30)]) + rng.choice(["", " q " * 200])) for i in range(60)]
    docs += [(100 + i, t) for i, t in enumerate(ODD)] + [docs[0], (None, docs[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontam.contamination(df, bench, block_bytes=block_bytes).collect()]
    want = plain_contamination(docs, items)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in decontam.contamination(df, bench, block_bytes=block_bytes).collect())


def test_decontamination_without_benchmark_or_documents(spark):
    df, bench = odd_docs(spark).select("doc_id", "text"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.contamination(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.contamination(df.limit(0), bench).count() == 0


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, 500)
    index = decontam.FMIndex(s, 3)
    for n in (1, 2, 5):
        for at in range(0, 480, 37):
            phrase = s[at:at + n]
            if (phrase == 0).any():
                continue
            low, high = index.search(np.array([phrase]), np.array([n]))
            places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert places == [i for i in range(501 - n) if (s[i:i + n] == phrase).all()]


# --- 10 ---


def plain_classes(docs):
    sets = []
    for _, t in docs:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(docs):
        low.setdefault(find(i), []).append(k)
    return [(k, len(s), min((x for x in low[find(i)] if x is not None), default=None) if s else k) for i, ((k, _), s) in enumerate(zip(docs, sets))]


@pytest.mark.parametrize("block", [1024, 7])
def test_jaccard_classes_equal_brute_force(spark, block):
    rng = random.Random(12)
    say = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(n)]
    passage = say(30)
    docs = [(900 - i, t) for i, t in enumerate(ODD)] + [(None, "one two three four five"), (50, "one two three four five"), (51, "One TWO three four five")]
    key = 1000
    for _ in range(25):
        base = say(rng.choice([1, 4, 5, 9, 30, 120]))
        for _ in range(rng.choice([1, 2, 3, 14])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(say(1))
            text = text + say(rng.choice([0, 3])) + (passage if rng.random() < 0.3 else [])
            docs.append((key, " ".join(text)))
            key += 1
    rng.shuffle(docs)
    docs += docs[:4]
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, component_id int").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(df, block=block).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_classes(docs)))
    assert jaccard.classes(df.limit(0)).count() == 0


# --- 4 ---


@pytest.mark.parametrize("block", [1024, 9])
def test_embedding_links_are_exact_and_found(spark, block):
    rng = np.random.default_rng(9)
    rows = []
    for c in range(40):
        centre = rng.normal(size=24)
        for _ in range(int(rng.choice([1, 2, 5, 30]))):
            rows.append((len(rows), int(c % 3), (centre + rng.normal(size=24) * rng.choice([0, 0.1, 0.3]) * rng.random()).tolist()))
    rows += [(9000, None, rows[0][2]), (9001, 0, None), (9002, 0, [0.0] * 24), (9003, 0, [float("nan")] * 24), (9004, 0, [None] + [1.0] * 23), (9005, 0, [float("inf")] * 24), (9006, 0, []), (9007, 1, [1e300, 1e300]), (9008, 1, [1e-300, 1e-300]), rows[3]]
    good = lambda v: v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if good(v) and lab is not None else None for _, lab, v in rows]
    links = [{j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93} for i in range(len(rows))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, embedding array<double>, copies int").repartition(3)
    got = embed_dedup.near_duplicates(df, embed_dedup.Settings(block=block)).collect()
    assert len(got) == len(rows)
    found = collections.Counter()
    for r in got:
        found[r.vec_id] += r.n_links
    want = collections.Counter()
    for (k, _, _), own in zip(rows, links):
        want[k] += len(own)
    assert not {k: (found[k], want[k]) for k in found if found[k] > want[k]} and sum(found.values()) >= 0.97 * sum(want.values())
    assert {r.vec_id for r in got if r.n_links} <= {k for k in want if want[k]} and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert all(r.n_links == 0 and r.component_id == r.vec_id for r in got if 9000 <= r.vec_id <= 9006)
    assert {r.component_id for r in got if r.vec_id in (9007, 9008)} == {9007}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


# --- 2 ---


def test_lm_packs_only_bytes_which_are_used():
    """Counts are small: seven of their eight bytes are not sent. Packed numbers come back whole."""
    rng = np.random.default_rng(3)
    assert len(lm_score._planes(np.ones(1000, np.int64))) < 1100
    for n in (0, 1, 2, 1000):
        for most in (0, 1, 300, 1 << 40, (1 << 63) - 1):
            rows = rng.integers(0, most, (n, 5), endpoint=True)
            assert np.array_equal(lm_score._unplanes(lm_score._planes(rows), "<i8", 5), rows)
            assert np.array_equal(lm_score._unplanes(lm_score._planes(-rows[:, 0]), "<i8"), -rows[:, 0])
        keys = np.sort(np.repeat(rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64, endpoint=True), 2))
        assert np.array_equal(lm_score._unsteps(lm_score._steps(keys)), keys)



def test_language_model_sums_to_one_and_base_is_exact(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randint(0, 60))) + rng.choice(["", " of The same old Phrase", f" rare{i}"])) for i in range(300)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [docs[0], (None, "null id")]
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, n_tokens int").repartition(4)
    settings = lm_score.Settings(word_share=1e-3, ngram_share=2e-3)
    model, _ = lm_score.train(df.filter(~held_out(10, 0)), settings)
    size = len(model.hashes) + 1
    rest = 1 - 10.0 ** model.log_unigram[:-1]  # what words that are not frequent get at the root
    chances = 10.0 ** np.array(model.log_unigram[:-1])
    assert len(model.fail) > 10 and model.arcs and rest.min() > 0
    for state in range(1, len(model.fail)):
        total = 0.0
        for w in range(size - 1):
            s, p = state, 0.0
            while s and (s * size + w) not in model.arcs:
                p += model.backoff[s]
                s = model.fail[s]
            total += 10 ** (p + (model.arcs[s * size + w][0] if s else model.log_unigram[w]))
        s, p = state, 0.0
        while s:
            p += model.backoff[s]
            s = model.fail[s]
        total += 10**p * (1 - chances.sum())
        assert math.isclose(total, 1, rel_tol=1e-6)
    cut = lambda t: [*(t or "").encode().translate(LOWER).split(), None]
    c = collections.Counter(w for i, t in docs if i is None or crc(i, 10) != 0 for w in cut(t))
    n, v = sum(c.values()), len(c)
    out = lm_score.score(df, ~held_out(10, 0), settings).collect()
    want = collections.Counter()
    for i, t in docs:
        w = cut(t)
        want[(i, len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("shares", [(1e-6, 1e-5), (0.02, 0.05), (2.0, 2.0)])
def test_language_model_uses_all_ngrams_whatever_the_shares(spark, shares):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 50)) + [f"rare{i // 2}"])) for i in range(200)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [docs[0], (None, "null id w1 w2")]
    c = collections.Counter()
    cut = lambda t: (*(t or "").encode().translate(LOWER).split(), None)
    for i, t in docs:
        if i is None or crc(i, 10) != 0:
            w = cut(t)
            c.update(w[k:k + n] for n in (1, 2, 3) for k in range(len(w) - n + 1))
    n, v = sum(k for g, k in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    after = collections.defaultdict(list)
    for g, k in c.items():
        if len(g) > 1 and k >= 2:
            after[g[:-1]].append(g[-1])

    @functools.cache
    def chance(h, w):
        if not h:
            return (c[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        if w in after[h]:
            return (c[(*h, w)] - 0.5) / c[h]
        rest = (1 - sum(chance(h, x) for x in after[h])) / (1 - sum(chance(h[1:], x) for x in after[h])) if after[h] else 1
        return rest * chance(h[1:], w)

    out = lm_score.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), ~held_out(10, 0), lm_score.Settings(*shares)).collect()
    want = [(-1 if i is None else i, sum(math.log10(chance(w[max(0, k - 2):k], w[k])) for k in range(len(w)))) for i, t in docs for w in [cut(t)]]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in out)
    assert [g[0] for g in got] == [x[0] for x in sorted(want)] and np.allclose([g[1] for g in got], [x[1] for x in sorted(want)], rtol=1e-6)
    assert all(chance(h, x) < 1 for h in [("x",), ("y",)] for x in after[h])


def test_language_model_of_nothing(spark):
    df = odd_docs(spark).select("doc_id", "text")
    out = lm_score.score(df, F.lit(False)).collect()
    assert len(out) == len(ODD) + 4 and all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score for r in out)
    assert lm_score.score(df.limit(0), F.lit(True)).count() == 0


# --- pipeline ---


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i, t, "en", None, 0) for i, t in enumerate(ODD)], docs.schema)
    # extra columns whose names the operators use themselves
    now = docs.unionByName(odd).withColumns({n: F.col("doc_id").cast("string") for n in ("score", "n_hit", "lang_pred", "component_id", "toxic_flag", "ids")})
    columns, schema = now.columns, now.schema
    sizes = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, spark.createDataFrame(stage(spark, now, SF).toArrow(), schema)
        assert now.columns == columns and now.exceptAll(before).count() == 0, name
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    tokens = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert tokens.count() == sizes[-1]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert not any(x[4] for x in plain_contamination([(r.doc_id, r.text) for r in now.collect()], items))
    kept = [(r.doc_id, r.text) for r in now.collect()]
    assert all(c == k for k, n, c in plain_classes(kept) if n)
    assert now.filter("score <> string(doc_id) or ids <> string(doc_id)").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
