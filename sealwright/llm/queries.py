"""One query per operator, over its whole table; ORACLE_SQL has DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, decontamination, language_id, line_dedup, media, order_minhash, resampling, source_mixing, suffix_dedup, token_counts, token_output, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_and_index(spark, table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, token_counts.redactions(F.col("text")), token_output.tokenizer_file("byte_bpe_50k.tiktoken"), keep_text=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages")).drop("payload", "url")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_start", "item_start")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(spark, table(spark, sf_dir, "documents"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), token_output.tokenizer_file("word_bpe_49k.json"))
    return d.select("doc_id", F.shiftright(F.octet_length("__bpe.ids").cast("long"), 2).alias("n_tokens"), F.sha2("__bpe.ids", 256).alias("ids_sha256"), F.sha2("__bpe.decoded", 256).alias("decoded_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_source_mixing, op3_token_counts, op4_language_id, op5_warc, op6_suffix_dedup, op7_decontamination, op8_media_columns, op9_order_minhash, op10_line_dedup, op11_bpe, op12_resampling, op13_conversation_trie)}

#: CRC-32 by a table of 256 values made here.
_CRC = """t AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tbl FROM t WHERE k = 8)"""


def _crc32(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen({text}))]), lambda c, x: xor(tbl[xor(c % 256, x) + 1], c // 256)), 4294967295)"


ORACLE_SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h FROM p),
f AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h, n) AS f FROM d),
bits AS (SELECT *, [('0x' || substr(h, 5 * i + 1, 5))::BIGINT FOR i IN range(8)] AS g FROM f)
SELECT page_id, n AS payload_bytes,
       array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((x >> s) & 31) + 1)::INT, 1) FOR s IN [15, 10, 5, 0]], '') FOR x IN g], '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM bits""",
    "op6_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(n - 49)) AS p FROM h WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE f.m < w.doc_id),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g
      FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM c)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT r.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(max(x), 2 * max(b) + 1) AS kept
      FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r) r JOIN h USING (doc_id) GROUP BY r.doc_id)
SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)""",
    # all aligned pairs of equal words
    "op7_decontamination": """
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
i AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS l, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
iw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM i WHERE w[1] <> ''),
m AS (SELECT doc_id, item_id, p, p - q AS g, least(13, n) AS size FROM dw JOIN iw USING (word) WHERE least(n, l - (p - q)) - greatest(0, q - p) >= least(13, n)),
c AS (SELECT doc_id, item_id, size, count(*) OVER (PARTITION BY doc_id, item_id, g ORDER BY p RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS k FROM m)
SELECT doc_id, item_id, size::INT AS n_words, max(k)::INT AS n_matches, max(k) / size AS similarity FROM c GROUP BY doc_id, item_id, size HAVING max(k) >= 0.8 * size - 1e-9""",
    "op10_line_dedup": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
w AS (SELECT doc_id, i, {'a': line, 'b': lead(line) OVER d, 'c': lead(line, 2) OVER d} AS k, lead(i, 2) OVER d IS NOT NULL AS whole FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w WHERE whole),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i FROM r WHERE n > 1), (SELECT unnest([0, 1, 2]) AS o)),
s AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p IS NULL OR p < i - 1) AS n_spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c) GROUP BY doc_id),
k AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS kept FROM x ANTI JOIN c USING (doc_id, i) GROUP BY x.doc_id)
SELECT l.doc_id, coalesce(len(l.lines), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op12_resampling": f"""
WITH RECURSIVE {_CRC},
x AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents UNION ALL SELECT NULL, coalesce(text, ''), NULL FROM benchmark),
w AS (SELECT row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM x),
d AS (SELECT word, {_crc32('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), crc),
n AS (SELECT row, bucket, count(*) AS n FROM w JOIN d USING (word) GROUP BY row, bucket),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE row IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (WHERE row IS NULL), 0) AS t FROM n GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
f AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE row IS NOT NULL GROUP BY row),
r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM (SELECT * FROM x WHERE row IS NOT NULL) LEFT JOIN f USING (row)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM k""",
    "op13_conversation_trie": f"""
WITH RECURSIVE {_CRC},
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT conv_id, md5(strlen(role) || ':' || role || text) AS what, length(text) AS points, turn FROM o),
p AS (SELECT conv_id, what, points, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, what) AS place FROM u),
v AS (SELECT conv_id, conv_id - conv_id % 100 AS base, n, {_crc32('conv_id::VARCHAR')} % 6 AS h FROM (SELECT conv_id, count(*) AS n FROM p GROUP BY conv_id), crc),
q AS (SELECT v.*, least(v.h, coalesce(b.n, 0)) AS taken FROM v LEFT JOIN v b ON b.conv_id = v.base),
r AS (SELECT q.conv_id, place - h + taken AS depth, what, points FROM q JOIN p USING (conv_id) WHERE place > h
      UNION ALL SELECT q.conv_id, place, what, points FROM q JOIN p ON p.conv_id = q.base WHERE place <= taken),
y AS (SELECT conv_id, depth, points, md5(string_agg(what, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM r
      UNION ALL SELECT q.conv_id, 0, 0, '', NOT EXISTS (FROM r WHERE r.conv_id = q.conv_id) FROM q),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(points) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM y GROUP BY depth, k),
e AS (SELECT n.*, up.k AS up FROM n LEFT JOIN y up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1),
c AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY depth, up),
z AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN c USING (depth, k)),
s AS (SELECT y.depth, y.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM z JOIN y ON y.conv_id = z.conv_id AND y.depth <= z.depth GROUP BY y.depth, y.k)
SELECT z.conv_id, z.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, z.n_convs, z.n_children, n_leaves, saved_tokens, z.ends_sha256
FROM z JOIN s USING (depth, k) LEFT JOIN n up ON up.depth = z.depth - 1 AND up.k = z.up""",
}
