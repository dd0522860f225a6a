"""Merkle manifest, token files and prefix trie beside plain Python; ordered places and lookups with hot keys."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from briefloom.llm import merkle, ordering, prefix_trie, queries, token_files
from briefloom.llm.common import stored
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- running positions, lookups -----------------------------------------------------------------------------------


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(None if rng.random() < 0.4 else rng.choice("ab"), rng.randint(0, 30), rng.randint(-5, 5)) for _ in range(4000)]
    df = stored(spark.createDataFrame(rows, "g string, o int, v int").withColumn("id", F.monotonically_increasing_id()))
    out = ordering.running(df, [F.col("o"), F.col("id")], ("g",), ("v",), rows_per_part=300).collect()
    for g in (None, "a", "b"):
        own = sorted((r for r in out if r.g == g), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda r: (r.o, r.id))
        plain = {r.id: r.v for r in df.filter(F.col("g").eqNullSafe(g)).collect()}
        assert [r.v for r in own] == np.cumsum([plain[r.id] for r in own]).tolist()
    assert ordering.running(df.limit(0), [F.col("o")], ("g",)).count() == 0


def test_lookup_of_hot_missing_and_null_keys(spark):
    rows = stored(spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"), "id"))
    facts = stored(spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")))
    want = {r.id: (2 * r.k if r.k is not None and r.k < 10_000 else None) for r in rows.collect()}
    assert {r.id: r.x for r in ordering.lookup(rows, "k", facts).collect()} == want
    assert ordering.lookup(rows.limit(0), "k", facts).count() == 0


# --- 11: Merkle manifest ------------------------------------------------------------------------------------------


def plain_tree(digests):
    """All levels, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_way(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + 8])))
        at //= 8
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of documents, by the contract."""
    def fields(*values):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def low(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    groups = {}
    for d, s, g, n, t in rows:
        bad = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups.setdefault(g, []).append((d is not None, d or 0, fields(d, s, g, n, t), fields(d, s, g, n, low(t) if bad else t)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, (known, d, leaf, other) in enumerate(sorted(groups[g])):
            way = plain_way(trees[g], i) + plain_way(top, j)
            at = other
            for before, after in way:
                at = h(before, at, after)
            out.append((d if known else None, leaf, trees[g][-1][0], top[-1][0], h(*(x for s in way for x in s)), at))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def documents(n, langs, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "Été A", "copy COPY", "x" * 30_000, "low", "é" * 9]
    return [(rng.choice([i, i, i, None, 5]), rng.choice(["s", None, ""]), rng.choice(langs), rng.choice([None, 3]), rng.choice(texts)) for i in range(n)]


def check_manifest(spark, rows, tmp_path, n):
    path = str(tmp_path / f"sf{n}")
    # an extra column whose name the operator uses
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", digest string").write.parquet(f"{path}/documents.parquet")
    got = queries.QUERIES["op11_merkle_manifest"](spark, path).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(plain_manifest(rows), key=key)
    return got


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (9, ["en"]), (64, ["en"]), (65, [None]), (30, [None, "", "é", "a", "Z", "-", "zz", "b", "c", "d"])])
def test_manifest_equals_plain_trees(spark, tmp_path, n, langs):
    check_manifest(spark, documents(n, langs), tmp_path, n)


def test_manifest_of_repeated_rows_and_joined_ancestors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    rows = documents(520, ["en", "en", "en", "de", None], 3)
    got = check_manifest(spark, rows + [rows[0]] * 150, tmp_path, 0)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_no_rows(spark, tmp_path):
    assert check_manifest(spark, [], tmp_path, 0) == []


# --- 12: token files ----------------------------------------------------------------------------------------------

TOKENIZER = public_tokenizers.path(queries.JSON_FILE)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2 ** 32 - 1))
def test_packing_is_a_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-n // 64) * bits * 8 and (token_files.unpack(data, bits, n) == ids).all()


@pytest.fixture(scope="module")
def encoders():
    return token_files.Encoder(TOKENIZER), token_files.Encoder(TOKENIZER, by_pieces=False)


ODD = [*"ab'é€ \n\t\u00a0\u3000\u0085\u2003.1,#_-中😀\u0301|<>\r\x00Ж", "'s", "'ll", "<|endoftext|>", " the", "\n\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=14).map("".join), max_size=5))
def test_pieces_have_the_ids_of_whole_texts(encoders, texts):
    texts = [t.encode() for t in texts]
    (a, n), (b, m) = (e(texts) for e in encoders)
    assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


def test_encoder_holds_little(encoders):
    """The library gets bounded lots, and cuts found chunk by chunk are those of the whole text."""
    class Model:
        def __init__(self, model):
            self.model, self.lots = model, []

        def encode_batch_fast(self, texts, **options):
            self.lots.append(len(texts))
            return self.model.encode_batch_fast(texts, **options)

    text = " ".join(f"w{i} é{i}\n{i}x-y 中{i}" for i in range(40_000)).encode()
    data = np.frombuffer(text, np.uint8)
    assert len(text) > 4 * token_files._CHUNK
    assert (token_files.piece_starts(data) == token_files._starts(data, True)).all()
    own = token_files.Encoder(TOKENIZER)
    own.model = Model(own.model)
    ids, counts = own([text, b"", text[:100]])
    assert sum(own.model.lots) > 100_000 and max(own.model.lots) <= 4096
    plain = encoders[1]
    want, many = plain([text, b"", text[:100]])
    assert (ids == want).all() and (counts == many).all()
    ids, counts = own([b"", b""])
    assert len(ids) == 0 and counts.tolist() == [0, 0]


def plain_tokens(rows):
    from tokenizers import Tokenizer

    model, out, start = Tokenizer.from_file(TOKENIZER), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice(["", None, "short", "The quick brown fox's tail, é <|endoftext|> 12", "no blank " * 3000, "x" * 50_000])) for i in rng.sample(range(-50, 400), 200)]
    rows += [(None, "first"), (5000, "last")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, ids int").repartition(3)
    for part_bytes, file_ids, n_files in ((1 << 16, 5000, 20), (1 << 30, 1 << 24, 1)):
        path = f"{tmp_path}/{n_files}"
        files = token_files.write_tokens(docs, path, TOKENIZER, queries.VOCABULARY, part_bytes=part_bytes, file_ids=file_ids)
        found = files.collect()
        assert len(found) >= n_files and {f.bits for f in found} == {16} and sum(f.docs for f in found) == len(rows)
        got = token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
        assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == plain_tokens(rows)


def test_a_document_is_read_without_the_rest(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i} " * (i % 700)) for i in range(1500)], "doc_id long, text string")
    (f,) = token_files.write_tokens(docs, str(tmp_path), TOKENIZER, queries.VOCABULARY, end_id=None, part_bytes=1 << 40).orderBy("number").collect()[:1]
    system, root = token_files.place(f"{tmp_path}/ids")
    file = token_files.TokenFile(system, f"{root}/{f.name}", f.bits)
    assert len(file.blocks) > 3
    encode = token_files.Encoder(TOKENIZER, by_pieces=False)
    for i in (0, 1, len(file) // 3, len(file) // 2, len(file) - 1):
        d = file.keys[i].as_py()
        assert file.document(i).tolist() == encode([f"document {d} ".encode() * (d % 700)])[0].tolist()
    assert len(file.documents(3, 3)) == 0 and len(file.documents(0, len(file))) == f.ids


def test_files_of_repeated_rows_and_of_none(spark, tmp_path):
    rows = [(7, "same text")] * 300 + [(7, "another"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write_tokens(docs, f"{tmp_path}/a", TOKENIZER, queries.VOCABULARY, part_bytes=500)
    got = token_files.read_tokens(spark, f"{tmp_path}/a").select("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert [r.doc_id for r in got] == [3] + [7] * 301 and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    token_files.write_tokens(docs.limit(0), f"{tmp_path}/b", TOKENIZER, queries.VOCABULARY)
    assert token_files.read_tokens(spark, f"{tmp_path}/b").count() == 0
    with open(f"{tmp_path}/broken", "wb") as out:
        out.write(b"x" * 40)
    with pytest.raises(ValueError):
        token_files.TokenFile(*token_files.place(f"{tmp_path}/broken"), 16)


# --- 13: prefix trie ----------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    members = {(): set(turns)}
    ends = {}
    for c, x in turns.items():
        head = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seq = tuple(turns.get(base, [])[:head] + x[head:])
        for d in range(1, len(seq) + 1):
            members.setdefault(seq[:d], set()).add(c)
        ends.setdefault(seq, []).append(c)
    if not turns:
        return []
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids.get(p, []))
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], h(",".join(map(str, sorted(ends.get(p, [])))))) for p, m in members.items()]


CHAT = "conv_id long, turn long, role string, text string"


def check_trie(spark, rows, path):
    spark.createDataFrame([(*r, 1) for r in rows], CHAT + ", depth int").write.parquet(f"{path}/conversations.parquet")
    got = [tuple(r) for r in queries.QUERIES["op13_prefix_trie"](spark, str(path)).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(plain_trie(rows), key=key)


def test_trie_equals_plain_walk(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for c in [*range(-12, 60, 2), *range(60, 75), 10_000]:
        for t in range(rng.choice([1, 1, 2, 6, 9, 14])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "é", None, "", "b" * 3000])))
    rows += [rows[0], rows[0], (None, 1, "user", "nobody's"), (77, None, None, None)]
    check_trie(spark, rows, tmp_path)


def test_trie_of_copies_long_chains_and_nothing(spark, tmp_path):
    copies = [(c, t, "user", f"same {t}") for c in range(0, 300) for t in range(3)]
    long = [(1000, t, "user", f"turn {t}") for t in range(700)] + [(1010, t, "user", f"turn {t}") for t in range(400)]
    check_trie(spark, copies + long, tmp_path / "a")
    check_trie(spark, [], tmp_path / "b")


def test_contraction_of_a_forest(spark):
    """A chain, a star, a random tree, a bushy chain, and trees with many roots, all in one forest."""
    rng = random.Random(11)
    parent, n = {}, 300
    for tree, shape in enumerate((lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i), lambda i: max(0, i - rng.choice([1, 1, 1, 1, 2])), lambda i: None if rng.random() < 0.1 else i // 2)):
        for i in range(n):
            p = shape(i) if i else None
            parent[tree * n + i] = None if p is None else tree * n + p
    weight = {i: rng.randint(-9, 9) for i in parent}
    total = dict(weight)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    df = spark.createDataFrame([(i, p, weight[i]) for i, p in parent.items()], "key long, parent long, w long")
    assert {r.key: r.w for r in prefix_trie.subtree_totals(df, ["w"]).collect()} == total
    assert prefix_trie.subtree_totals(df.limit(0), ["w"]).count() == 0
