"""The registered queries of this subpackage, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from briefloom.llm import bpe, chat, decontam, embed_dedup, jaccard, langid, lm_score, merkle, prefix_trie, shard, token_files, toxicity, url_filter
from briefloom.llm.common import folder, held_out, stored, table
from briefloom.llm.ordering import lookup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- 1: toxicity --------------------------------------------------------------------------------------------------


@register("op1_toxicity")
def op1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    learned = docs.filter(~held_out(3, 1))
    model = toxicity.train(learned, table(spark, sf, "labels").filter(~held_out(3, 1)))
    scored = toxicity.score(docs.drop("lang").withColumn("held_out", held_out(3, 1)), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# --- 2: language-model scores -------------------------------------------------------------------------------------


@register("op2_lm_score")
def op2(spark, sf):
    scored = lm_score.score(table(spark, sf, "documents").select("doc_id", "text"), ~held_out(10, 0))
    return scored.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 3: URL filters -----------------------------------------------------------------------------------------------

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@register("op3_url_filter", """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
p AS (SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT p.page_id, max_by(h || q, length(h || q)) AS rule, max_by(v, length(h || q)) AS verdict FROM p JOIN r
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)""")
def op3(spark, sf):
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf, "pages"), rules)


# --- 4: embedding near-dedup --------------------------------------------------------------------------------------


@register("op4_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)""")
def op4(spark, sf):
    return embed_dedup.near_duplicates(table(spark, sf, "embeddings"))


# --- 5: language ID -----------------------------------------------------------------------------------------------


@register("op5_language_id")
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(4, 2))
    model = langid.train(docs.filter("not held_out"))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


# --- 6: chat formatting -------------------------------------------------------------------------------------------

PLANTED = "\\### Assistant: </turn> ok"
_ESC = "replace(replace({0}, '\\', '\\b'), '<', '\\l')"


@register("op6_chat_format", f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn >') + length(replace({_ESC.format('role')}, '>', '\\g')) + 1 + length({_ESC.format('text')}) + length('</turn>') + 1) AS BIGINT)
    AS formatted_chars
FROM m GROUP BY conv_id""")
def op6(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], rows.schema)
    messages = rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    chats = chat.format_chats(messages).select("conv_id", "formatted", "segments")
    read = chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"), "formatted")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


# --- 7: byte-level BPE --------------------------------------------------------------------------------------------

RANK_FILE = "byte_bpe_50k.tiktoken"


@register("op7_byte_bpe")
def op7(spark, sf):
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    tokens = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    read = bpe.decode(tokens.select("doc_id", "ids"), ranks)
    return read.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# --- 8: benchmark decontamination ---------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op8_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + 12], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x:x + n - 1], ' '))) AS p
  FROM d, sizes WHERE len(w) >= n),
occ AS (SELECT r, s, n, item_id FROM pos JOIN win USING (n, p)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS at FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""")
def op8(spark, sf):
    found = decontam.contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


# --- 9: sharding --------------------------------------------------------------------------------------------------


@register("op9_kd_sharding")
def op9(spark, sf):
    rows = stored(shard.measured(table(spark, sf, "documents"), "doc_id"))
    placed = shard.slots(shard.kd_shards(rows, n_shards=8), ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# --- 10: n-gram Jaccard join --------------------------------------------------------------------------------------


@register("op10_jaccard_join")
def op10(spark, sf):
    return jaccard.classes(table(spark, sf, "documents").select("doc_id", "text"))


# --- 11: Merkle manifest ------------------------------------------------------------------------------------------

# crc32 of a text of ASCII characters, by its table
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fields(text: str) -> str:
    return " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", text))


@register("op11_merkle_manifest", f"""
WITH RECURSIVE {_CRC_TABLE},
f AS (SELECT row_number() OVER () AS r, doc_id, lang, sha256({_fields('text')}) AS leaf, sha256({_fields(f"translate(text, '{_UPPER}', '{_LOWER}')")}) AS low,
  coalesce({_CRC.format('doc_id')} % 3 = 0, false) AS bad FROM documents, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f),
lv(g, h, pos, n, d) AS (SELECT lang, 0, pos, n, leaf FROM p
  UNION ALL SELECT g, h + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY g, h, pos // 8, n),
sub AS (SELECT g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM lv WHERE n = 1),
tp(h, pos, n, d) AS (SELECT 0, j, m, d FROM sub
  UNION ALL SELECT h + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM tp WHERE n > 1 GROUP BY h, pos // 8, n),
q AS (SELECT p.*, sub.d AS subroot, j FROM p JOIN sub ON sub.g IS NOT DISTINCT FROM p.lang),
beside AS (
  SELECT r, h, coalesce(string_agg(d, '' ORDER BY o.pos) FILTER (o.pos < q.pos >> (3 * h)), '') AS b, coalesce(string_agg(d, '' ORDER BY o.pos) FILTER (o.pos > q.pos >> (3 * h)), '') AS a
  FROM q JOIN lv o ON o.g IS NOT DISTINCT FROM q.lang AND o.n > 1 AND o.pos // 8 = q.pos >> (3 * h + 3) GROUP BY r, h, q.pos
  UNION ALL
  SELECT r, 100 + h, coalesce(string_agg(d, '' ORDER BY o.pos) FILTER (o.pos < j >> (3 * h)), ''), coalesce(string_agg(d, '' ORDER BY o.pos) FILTER (o.pos > j >> (3 * h)), '')
  FROM q JOIN tp o ON o.n > 1 AND o.pos // 8 = j >> (3 * h + 3) GROUP BY r, h, j),
way AS (SELECT r, list(b ORDER BY h) AS bs, list(a ORDER BY h) AS bfs, string_agg(b || a, '' ORDER BY h) AS proof FROM beside GROUP BY r),
fold(r, i, d) AS (SELECT r, 1, CASE WHEN bad THEN low ELSE leaf END FROM q
  UNION ALL SELECT fold.r, i + 1, sha256(bs[i] || d || bfs[i]) FROM fold JOIN way USING (r) WHERE i <= len(bs)),
done AS (SELECT r, arg_max(d, i) AS folded FROM fold GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT d FROM tp WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root,
  folded = (SELECT d FROM tp WHERE n = 1) AS verified FROM q JOIN done USING (r) LEFT JOIN way USING (r)""")
def op11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")

    def leaf(text):
        return F.unhex(merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]))

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    forged = F.when(tampered, leaf(F.translate("text", _UPPER, _LOWER)))
    leaves = docs.select(F.col("lang").alias("g"), F.col("doc_id").alias("key"), leaf(F.col("text")).alias("digest"), F.struct("doc_id", forged.alias("forged")).alias("tag"))
    shown = [F.lower(F.hex(c)).alias(c) for c in ("subroot", "root")]
    folded = merkle.fold(F.lower(F.hex(F.coalesce("tag.forged", "digest"))), F.col("proof"))
    out = merkle.proofs(leaves).select(
        "tag.doc_id", F.lower(F.hex("digest")).alias("leaf"), *shown, merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# --- 12: binary token files ---------------------------------------------------------------------------------------

JSON_FILE, VOCABULARY = "byte_bpe_50k.json", 50_257


@register("op12_token_files")
def op12(spark, sf):
    place = folder(spark)
    token_files.write_tokens(table(spark, sf, "documents"), place, public_tokenizers.path(JSON_FILE), VOCABULARY)
    return token_files.read_tokens(spark, place).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# --- 13: conversation prefix trie ---------------------------------------------------------------------------------


def _rebuilt(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Conversation c with the first turns of c - c % 5 in place of its own: as many as `head` says."""
    def head(c):
        return F.crc32(c.cast("string").cast("binary")) % 9

    c = F.col("conv_id")
    target = F.explode(F.sequence(c - 4, c + 4))
    lent = turns.filter((F.col("place") <= 8) & (c % 5 == 0)).select(c.alias("from"), target.alias("conv_id"), "place", "content", "bytes")
    lent = lent.filter((c - c % 5 == F.col("from")) & (F.col("place") <= head(c))).drop("from").join(conversations, "conv_id", "left_semi")
    lent = stored(lent)
    counts = lent.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_lent"))
    own = lookup(turns.filter(F.col("place") > head(c)), "conv_id", counts)
    moved = F.col("place") - head(c) + F.coalesce("_lent", F.lit(0))
    return lent.unionByName(own.select("conv_id", moved.alias("place"), "content", "bytes"))


@register("op13_prefix_trie", f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id AS c, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS b,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, {_CRC.format('c')} % 9 AS h FROM (SELECT DISTINCT c FROM t), crc_table),
r AS (SELECT cs.c, 0 AS k, p, x, b FROM cs JOIN t ON t.c = cs.c - cs.c % 5 AND p <= h UNION ALL SELECT cs.c, 1, p, x, b FROM cs JOIN t ON t.c = cs.c AND p > h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k, p) AS d, x, b FROM r),
s AS (SELECT c, d, b, md5(string_agg(x, ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS key FROM n UNION ALL SELECT c, 0, 0, '' FROM cs),
nodes AS (SELECT key, d, min(c) AS c, count(*) AS n, max(b) AS b FROM s GROUP BY key, d),
up AS (SELECT a.c, a.d, p.key AS pkey FROM nodes a JOIN s p ON p.c = a.c AND p.d = a.d - 1),
e AS (SELECT key, d, c FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1),
ids AS (SELECT key, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM e GROUP BY key, d),
kids AS (SELECT pkey AS key, d - 1 AS d, count(*) AS n_children FROM up GROUP BY ALL),
w AS (SELECT nodes.*, n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes LEFT JOIN kids USING (key, d)),
tot AS (SELECT s.key, s.d, sum(w.leaf) AS n_leaves, sum((w.n - 1) * w.b) AS saved FROM w JOIN s ON s.c = w.c AND s.d <= w.d GROUP BY s.key, s.d)
SELECT w.c AS conv_id, w.d AS depth, pn.c AS parent_conv_id, w.n AS n_convs, coalesce(w.n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM w JOIN tot USING (key, d) LEFT JOIN ids USING (key, d) LEFT JOIN up ON up.c = w.c AND up.d = w.d LEFT JOIN nodes pn ON pn.key = up.pkey AND pn.d = w.d - 1""")
def op13(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    turns = stored(prefix_trie.numbered_turns(rows))
    ids = stored(turns.select("conv_id").distinct())
    nodes = prefix_trie.trie(_rebuilt(turns, ids), ids)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
