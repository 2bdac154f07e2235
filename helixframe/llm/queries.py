"""Registered queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, read_back
from .decontamination import find_passages
from .html_text import extract_text
from .language import fit_language, held_out, identify_language
from .near_texts import near_duplicates
from .negatives import hard_negatives
from .pieces import encode_texts, ids_digest
from .prefix_trie import conversation_trie
from .quality import fit_quality, score_quality
from .sharding import assign_shards, tree
from .shared import table
from .token_counts import count_tokens
from .urls import filter_urls
from .vectors import near_vectors

MODEL_PATH = os.environ.get("PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")

URL_RULES = """
SELECT * FROM VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/') AS rules(action, host, path)
"""
#: One more conversation, whose texts hold control strings.
PLANTED_CHAT = r"""
SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS c(conv_id, turn, role, text)
"""


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every row of ``pages`` under the five rules; null urls and such without ``://`` have empty parts and are allowed."""
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url", spark.sql(URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, quality_score, accepted)`` for every document, repeated ids and null texts included; fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=["doc_id"])


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text for every document (null texts are empty: the end id alone), and whether the spans tile the text."""
    out = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", MODEL_PATH)
    tiled = (F.element_at("begins", 1) == 0) & (F.element_at("ends", -1) == F.octet_length(F.coalesce("text", F.lit(""))))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), tiled.alias("spans_cover_text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document under the vocabulary of the model file (``token_counts`` says which probabilities); 0 for null and empty texts."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", MODEL_PATH).select("doc_id", "n_tokens", "n_pretokens")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text; the loss mask covers the turns whose role the template counts."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_chats(given.union(spark.sql(PLANTED_CHAT)))
    read = chats.select("conv_id", "valid", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"))
    read = read.withColumn("lossy", F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("lossy").cast("long").alias("loss_chars"), F.sha2("lossy", 256).alias("loss_sha256"), "formatted_chars", "valid")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; "" for null, empty and text-free pages."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``; invalid vectors stand alone."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item found in each document; documents with none have no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_passages(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", keep=["doc_id"])
    hit = found.select("doc_id", F.explode("hits").alias("h"))
    return hit.select("doc_id", F.col("h.item").alias("item_id"), F.col("h.begin").alias("begin"), F.col("h.end").alias("end"), F.col("h.edits").alias("edits"))


def op9_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct (doc_id, text) with its group and how many input rows it stands for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, "doc_id", "text").select("doc_id", "class_id", "kept", "copies")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row by the law ``key``; sizes are UTF-8 bytes of the whole text plus 8, null texts count none."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(docs, "doc_id", tree(24), tree(25))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations; no rows for an empty table."""
    return conversation_trie(table(spark, sf_dir, "conversations"), heads=(20, 4))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negatives of each anchor and positive among all rows of ``embeddings``; invalid rows take no part."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, repeated ids and null texts included; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs)
    return identify_language(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_pieces": op3_pieces,
    "op4_token_counts": op4_token_counts,
    "op5_chat_format": op5_chat_format,
    "op6_html_text": op6_html_text,
    "op7_near_vectors": op7_near_vectors,
    "op8_decontamination": op8_decontamination,
    "op9_near_texts": op9_near_texts,
    "op10_sharding": op10_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_language": op13_language,
}

#: The shards of ``tree(24)`` by region, rack and place, as SQL: names and weights of the children at each level.
_REGIONS, _RACKS, _PLACES = [("g0", 12), ("g1", 12)], [(f"k{i}", 4) for i in range(3)], [(str(i), 1) for i in range(4)]


def _least(path: str, children: list[tuple[str, int]]) -> str:
    """The child of ``path`` with the smallest draw of key ``k``."""
    draw = "-ln((('0x' || substr(md5(k || {} || ':{}'), 1, 13))::UBIGINT + 0.5) / 4503599627370496.0) / {}"
    return f"list_min([{', '.join('{d: ' + draw.format(path, name, float(w)) + ', n: ' + repr(name) + '}' for name, w in children)}]).n"


#: CRC-32 of the text ``k`` in SQL, by the table ``t`` that follows from its polynomial.
_CRC = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t)"
_CRC_OF = "xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295)"

ORACLES = {
    # The table of CRC-32 follows from its polynomial; slots count in the order of the file.
    "op10_sharding": f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, chr(0) || 'null') AS k, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT rid, doc_id, k, octet_length(b) + 8 AS size, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS text_crc32 FROM d, crc),
r AS (SELECT *, '/' || {_least("''", _REGIONS)} AS p1, {_least("''", [*_REGIONS, ("s24", 1)])} = 's24' AS moved FROM s),
q AS (SELECT *, p1 || '/' || {_least('p1', _RACKS)} AS p2 FROM r),
l AS (SELECT *, (substr(p2, 3, 1)::INT * 12 + substr(p2, 6, 1)::INT * 4 + {_least('p2', _PLACES)}::INT)::INT AS shard FROM q)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY rid) - 1 AS slot, CASE WHEN moved THEN 24 ELSE shard END::INT AS grown_shard FROM l
""",
    "op1_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j AS (SELECT p.*, max(struct_pack(l := length(rhost || rpath), rule := rhost || rpath, action := action)) AS best
      FROM (SELECT row_number() OVER () AS rid, * FROM p) p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
      GROUP BY ALL)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM j
""",
    "op5_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m(mark) AS (VALUES ('<s>'), ('</s>'), ('[SYS]'), ('[/SYS]'), ('[INST]'), ('[/INST]'), ('[ANS]'), ('[ROLE]'), ('[TEXT]'), ('[/TEXT]')),
e AS (SELECT c.*, length(text) + (length(text) - length(replace(text, '\', '')))
        + (SELECT sum((length(c.text) - length(replace(c.text, mark, ''))) // length(mark)) FROM m) AS chars,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  (3 + sum(chars + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + length(role) END))::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN prev IS NULL WHEN 'user' THEN coalesce(prev, 'system') IN ('system', 'assistant') WHEN 'assistant' THEN coalesce(prev, '') = 'user' ELSE false END AND (nxt IS NOT NULL OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
""",
    # A node is named by its depth and a digest of all its turns; subtree sums follow the path of each node's smallest member.
    "op11_prefix_trie": rf"""
WITH {_CRC},
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id),
h AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, {_CRC_OF} % 4 AS h FROM (SELECT *, conv_id::VARCHAR AS k FROM n), crc),
m AS (SELECT h.*, least(h, coalesce(b.n, 0)) AS taken FROM h LEFT JOIN n b ON b.conv_id = h.base),
r AS (SELECT conv_id, pos - h + taken AS depth, d, words FROM c JOIN m USING (conv_id) WHERE pos > h UNION ALL SELECT m.conv_id, pos, d, words FROM m JOIN c ON c.conv_id = m.base AND pos <= taken),
p AS (SELECT *, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r),
q AS (SELECT conv_id, depth, sha256(path) AS node, CASE WHEN depth = 1 THEN '' ELSE sha256(left(path, -64)) END AS parent, words, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p
      UNION ALL SELECT conv_id, 0, '', NULL, 0, conv_id NOT IN (SELECT conv_id FROM r) FROM n),
v AS (SELECT depth, node, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM q GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM v WHERE parent IS NOT NULL GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (depth, node)),
s AS (SELECT q.depth, q.node, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * w.words) AS saved_tokens FROM w JOIN q ON q.conv_id = w.conv_id AND q.depth <= w.depth GROUP BY ALL)
SELECT w.conv_id, w.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (depth, node) LEFT JOIN v u ON u.depth = w.depth - 1 AND u.node = w.parent
""",
    "op12_hard_negatives": """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda x: coalesce(x[1], 0) * coalesce(x[2], 0))), 0)::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
""",
}
