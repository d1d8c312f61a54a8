"""The registered queries of this package: thin wrappers that derive the contracts' columns."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import chat, collocations, decontaminate, exact_dedup, line_dedup, mixing, pieces, postings, prefix_trie, quality, sharding, simhash, toxicity
from colonnade.llm.common import read_table, text_of
from colonnade.llm.samples import remainder
from colonnade.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def fresh_index(spark: SparkSession, id_type: str = "bigint") -> exact_dedup.DigestIndex:
    """An empty index in the shared folder, for a run that is to know nothing of earlier ones."""
    name = f"digests_{uuid.uuid4().hex}"
    return exact_dedup.DigestIndex.open(spark, name, f"{shared_dir(spark)}/{name}", id_type)


@query("op1_sharding", sql=r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))) AS crc),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d),
q AS (SELECT *, CAST((2 * before + size) * 40 // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(b), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q, tab""")
def op1(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.crc32(text_of("text")).alias("text_crc32"), sharding.byte_size("text").alias("bytes"))
    cut = sharding.assign_shards(rows, ["doc_id"], F.col("bytes"), 40)
    return cut.select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_line_dedup", sql=r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS doc, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
l AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY doc ORDER BY line) AS pos FROM a WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
f AS (SELECT p.doc, p.pos AS b, q.pos AS e, sum(r.w) AS w, max(CASE WHEN r.pos = p.pos THEN r.w END) AS w_b, max(CASE WHEN r.pos = q.pos THEN r.w END) AS w_e,
  string_agg(r.x, chr(10) ORDER BY r.pos) AS run FROM l p JOIN l q ON q.doc = p.doc AND q.pos BETWEEN p.pos AND p.pos + 9
  JOIN l r ON r.doc = p.doc AND r.pos BETWEEN p.pos AND q.pos GROUP BY ALL),
m AS (SELECT * FROM f WHERE w >= 10 AND (w - w_e < 10 OR w - w_b < 10)),
g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc, b) AS k FROM m),
z AS (SELECT DISTINCT l.doc, l.line FROM g JOIN l ON l.doc = g.doc AND l.pos BETWEEN g.b AND g.e WHERE g.k > 1)
SELECT d.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(z.line) AS INTEGER) AS n_deleted,
  sha256(coalesce(string_agg(a.x, chr(10) ORDER BY a.line) FILTER (z.line IS NULL), '')) AS clean_sha256
FROM d JOIN a ON a.doc = d.doc LEFT JOIN z ON z.doc = a.doc AND z.line = a.line GROUP BY d.doc, d.doc_id""")
def op4(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, "doc_id", "text").select(
        "row.doc_id", "n_lines", F.size("deleted").alias("n_deleted"), F.sha2("clean", 256).alias("clean_sha256"))


TURN = r"""c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok') u)"""


@query("op5_chat_formatting", sql=rf"""
WITH {TURN},
t AS (SELECT *, 4 + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
  14 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\b'), '<', '\l')) AS chars,
  row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
p AS (SELECT *, sum(tokens) OVER w - tokens AS before,
  i = 1 AND role = 'system' AS sys FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
y AS (SELECT *, coalesce(max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id), 0) AS lead FROM p),
s AS (SELECT *, greatest(32, (512 - 128 - lead) // 2) AS stride FROM y),
w AS (SELECT *, min(before) OVER k AS w_start, max(before + tokens) OVER k AS w_end FROM s
  WINDOW k AS (PARTITION BY conv_id, before // stride, tokens > stride)),
f AS (SELECT conv_id, chars FROM w UNION ALL SELECT a.conv_id, b.chars FROM (SELECT DISTINCT conv_id, w_start, greatest(0, least(128, 512 - lead - (w_end - w_start))) AS room FROM w) a
    JOIN w b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND NOT b.sys AND b.before < a.w_start AND b.before >= a.w_start - a.room
  UNION ALL SELECT a.conv_id, b.chars FROM (SELECT DISTINCT conv_id, w_start FROM w WHERE w_start > 0) a JOIN w b ON a.conv_id = b.conv_id AND b.sys)
SELECT g.*, n.formatted_chars FROM (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM w GROUP BY conv_id) g
JOIN (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id) n ON g.conv_id IS NOT DISTINCT FROM n.conv_id""")
def op5(spark, sf_dir):
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.windows(table.unionByName(own)))


@query("op6_mixing", sql=r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS t,
  coalesce(sum(3.0::DOUBLE * source_size) OVER k, 0) AS c, sum(w) OVER () - coalesce(sum(w) OVER k, 0) AS open_w FROM s
  WINDOW k AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT c, open_w, t FROM o WHERE 3.0::DOUBLE * source_size >= w * (t - c) / open_w ORDER BY ratio, source NULLS LAST LIMIT 1),
g AS (SELECT o.source, o.source_size, coalesce(least(3.0::DOUBLE * o.source_size, o.w * (l.t - l.c) / l.open_w), 3.0::DOUBLE * o.source_size) AS target FROM o LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
x AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS quota,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE < quota THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x""")
def op6(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs, "doc_id", "text", "source", (5, 2, 1)).select("doc_id", "size", "source_size", "target", "taken")


#: Folder of the public tokenizer files; TOKENIZERS overrides it.
MODEL = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")


@query("op2_sentencepiece")
def op2(spark, sf_dir):
    """Ids of every whole text, and the digest of the text that they decode to."""
    model = pieces.read_model(MODEL)
    coded = pieces.encode(read_table(spark, sf_dir, "documents"), "doc_id", "text", model, proof=True)
    return coded.select("doc_id", F.col("ids").alias("token_ids"), F.size("ids").cast("bigint").alias("n_tokens"), "decoded_sha256")


def scored(docs, score, parts, held):
    """The contract's columns of a classifier whose held-out fold has remainder ``held`` of ``parts``."""
    fold = F.coalesce(remainder("doc_id", parts) == held, F.lit(False))
    return docs.select("doc_id", fold.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def fit_toxicity(spark, docs, sf_dir):
    return toxicity.fit(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", remainder("doc_id", 4) != 2)


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, toxicity.score("text", fit_toxicity(spark, docs, sf_dir)), 4, 2)


@query("op7_quality")
def op7(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "quality", remainder("doc_id", 5) != 0)
    return scored(docs, quality.score("text", model), 5, 0)


@query("op8_simhash")
def op8(spark, sf_dir):
    return simhash.components(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op9_exact_dedup", sql=r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, row_number() OVER w AS r, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM k""")
def op9(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return exact_dedup.dedup_batch(docs, "doc_id", "text", fresh_index(spark), "documents").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_neighbours")
def op10(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return postings.search(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0)


@query("op11_decontaminate", sql=r"""
WITH w AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS run FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM b WHERE len(w) > 0) b),
d AS (SELECT doc, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS run FROM (SELECT doc, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM w, (SELECT DISTINCT n FROM i) m) x),
h AS (SELECT doc, k, n, item FROM d JOIN i USING (n, run)),
t AS (SELECT doc, count(DISTINCT k + j) AS n_hit FROM (SELECT doc, k, unnest(generate_series(0, n - 1)) AS j FROM h) u GROUP BY doc),
s AS (SELECT doc, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc, item FROM h WHERE item IS NOT NULL) g GROUP BY doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN t USING (doc) LEFT JOIN s USING (doc)""")
def op11(spark, sf_dir):
    found = decontaminate.scan(read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op12_prefix_trie", sql=r"""
WITH t AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) u),
n AS (SELECT c, count(*) AS own, CAST(c AS VARCHAR) AS s FROM t GROUP BY c),
z AS (SELECT c, own, c - c % 20 AS base, xor(list_reduce(list_concat([4294967295], CAST(range(8 * len(s)) AS BIGINT[])), lambda a, i:
  xor((CASE WHEN i % 8 = 0 THEN xor(a, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE a END) >> 1,
    3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(a, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE a END) % 2))), 4294967295) % 4 AS h FROM n),
k AS (SELECT z.c, z.base, z.h, least(z.h, coalesce(b.own, 0)) AS took FROM z LEFT JOIN n b ON b.c = z.base),
r AS (SELECT k.c, t.pos AS d, role, text FROM k JOIN t ON t.c = k.base AND t.pos <= k.h
  UNION ALL SELECT k.c, t.pos - k.h + k.took, role, text FROM k JOIN t ON t.c = k.c AND t.pos > k.h),
p AS (SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d) AS key FROM r
  UNION ALL SELECT c, 0, 0, '' FROM n),
o AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saves FROM p GROUP BY key, d),
g AS (SELECT left(key, length(key) - 64) AS key, count(*) AS n_children FROM o WHERE d > 0 GROUP BY 1),
x AS (SELECT o.*, coalesce(n_children, 0) AS n_children FROM o LEFT JOIN g USING (key)),
b AS (SELECT left(key, 64 * i) AS key, sum(saves) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS i FROM x) y GROUP BY 1),
e AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(key, d) AS key FROM p GROUP BY c) l GROUP BY key)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM x JOIN b USING (key) LEFT JOIN e USING (key) LEFT JOIN o u ON x.d > 0 AND u.key = left(x.key, length(x.key) - 64)""")
def op12(spark, sf_dir):
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


@query("op13_collocations", sql=r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS phrase FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM w, generate_series(1, 5) s(m)) x),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE m > 1),
k AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n.n, CAST(1000::HUGEINT * c.a * n.n // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c) c JOIN n ON n.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(p, 1, k), ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(p, k + 1, c.m), ' ')),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT lang, a, array_to_string(list_slice(p, b, b + q - 1), ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, m - q + 1)) AS b FROM (SELECT *, unnest(generate_series(2, m - 1)) AS q FROM c WHERE m > 2) y) z),
v AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = s.lang AND i.phrase = s.phrase AND i.a >= s.a))
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM v WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000""")
def op13(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return collocations.collocations(collocations.frequent_phrases(docs, "doc_id", "text", "lang")).drop("seen_in")
