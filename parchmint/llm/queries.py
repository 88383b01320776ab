"""The queries of this folder, thin digests of what its operators return, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm import ann, chunk_bpe, line_dedup, mixing, ngram_join, order_minhash, quality, quotes, token_files, url_filter
from parchmint.llm import pipeline as stages
from parchmint.llm.common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP1_SQL = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), split AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM parts
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, frequent.k IS NOT NULL AND doc_id < keeper AS gone
  FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(ngram_join.real_id("id").alias("doc_id"), F.col("n").alias("n_shingles"), ngram_join.real_id("component").alias("component_id"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learned(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_chat_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_digest(quotes.formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def quote_digest(found: DataFrame) -> DataFrame:
    return found.select("conv_id", "turn", "role", "thread", "depth", "position", "reply_to", "n_quotes", "n_linked", "far_conv", "far_turn", F.sha2("own_text", 256).alias("own_sha256"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.shares(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filtered(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token_files")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return token_files.digests(spark, folder).select(ngram_join.real_id("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_adaptive_scan_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


OP4_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT DISTINCT conv_id, turn, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations
), raws AS (
  SELECT conv_id, turn, text, unnest(ls) AS raw, unnest(range(len(ls))) AS i FROM parts
), leads AS (
  SELECT *, regexp_extract(raw, '^[ \t>]*') AS lead FROM raws
), leveled AS (
  SELECT *, length(lead) - length(replace(lead, '>', '')) AS level,
         CASE WHEN contains(lead, '>') THEN regexp_replace(raw, '^[ \t>]*>', '') ELSE raw END AS body FROM leads
), kinds AS (
  SELECT *, CASE WHEN regexp_full_match(body, '[ \t\r\f\x0B]*') THEN -1 ELSE level END AS kind FROM leveled
), marks AS (
  SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY conv_id, turn, text ORDER BY i) = kind THEN 0 ELSE 1 END AS new FROM kinds
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, text ORDER BY i) - 1 AS place FROM marks
), own AS (
  SELECT conv_id, turn, text,
         regexp_replace(regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^[ \t\r\f\x0B\n]+', ''), '[ \t\r\f\x0B\n]+$', '') AS own_text
  FROM runs GROUP BY conv_id, turn, text
), raw_passages AS (
  SELECT conv_id, turn, text, place, any_value(kind) AS level, string_agg(body, ' ' ORDER BY i) AS body
  FROM runs WHERE kind >= 0 GROUP BY conv_id, turn, text, place
  UNION ALL SELECT conv_id, turn, text, -1, 0, own_text FROM own
  UNION ALL SELECT conv_id, turn, text, -2, 0, body FROM runs WHERE kind = 0
), passages AS (
  SELECT conv_id, turn, text, place, level,
         trim(translate(regexp_replace(body, '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS body
  FROM raw_passages
), quotes AS (SELECT * FROM passages WHERE level > 0 AND body <> '')
, originals AS (SELECT DISTINCT conv_id, turn, body FROM passages WHERE level = 0 AND body <> '')
, inner_links AS (
  SELECT q.conv_id, q.turn, q.text, q.place, q.level, q.body, max(o.turn) AS near
  FROM quotes q LEFT JOIN originals o ON o.conv_id IS NOT DISTINCT FROM q.conv_id AND o.body = q.body AND o.turn < q.turn
  GROUP BY ALL
), links AS (
  SELECT l.conv_id, l.turn, l.text, l.place, l.level, l.near, min(CASE WHEN o.body IS NOT NULL THEN struct_pack(c := o.conv_id, t := o.turn) END) AS far
  FROM inner_links l LEFT JOIN originals o ON l.near IS NULL AND o.body = l.body AND o.conv_id IS NOT NULL AND o.turn IS NOT NULL AND o.conv_id IS DISTINCT FROM l.conv_id
  GROUP BY l.conv_id, l.turn, l.text, l.place, l.level, l.near
), per_message AS (
  SELECT conv_id, turn, text, count(*) AS n_quotes, count(*) FILTER (WHERE near IS NOT NULL OR far IS NOT NULL) AS n_linked,
         arg_min(near, level * 1000000 + place) FILTER (WHERE near IS NOT NULL) AS reply_to,
         arg_min(far, level * 1000000 + place) FILTER (WHERE far IS NOT NULL) AS far
  FROM links GROUP BY conv_id, turn, text
), replies AS (
  SELECT conv_id, turn, min(reply_to) AS reply_to FROM per_message WHERE reply_to IS NOT NULL GROUP BY conv_id, turn
), climb AS (
  SELECT conv_id, turn, reply_to AS up, 1 AS depth FROM replies
  UNION ALL SELECT c.conv_id, c.turn, r.reply_to, c.depth + 1 FROM climb c JOIN replies r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.turn = c.up
), tops AS (
  SELECT conv_id, turn, arg_max(up, depth) AS thread, max(depth) AS depth FROM climb GROUP BY conv_id, turn
)
SELECT c.conv_id, c.turn, c.role, coalesce(t.thread, c.turn) AS thread, coalesce(t.depth, 0)::BIGINT AS depth, p.reply_to,
       rank() OVER (PARTITION BY c.conv_id ORDER BY coalesce(t.thread, c.turn) NULLS FIRST, coalesce(t.depth, 0), p.reply_to NULLS FIRST, c.turn NULLS FIRST, sha256(c.text) NULLS FIRST) - 1 AS position,
       coalesce(p.n_quotes, 0) AS n_quotes, coalesce(p.n_linked, 0) AS n_linked, p.far.c AS far_conv, p.far.t AS far_turn, sha256(o.own_text) AS own_sha256
FROM conversations c
JOIN own o ON o.conv_id IS NOT DISTINCT FROM c.conv_id AND o.turn IS NOT DISTINCT FROM c.turn AND o.text IS NOT DISTINCT FROM c.text
LEFT JOIN per_message p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.turn IS NOT DISTINCT FROM c.turn AND p.text IS NOT DISTINCT FROM c.text
LEFT JOIN tops t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.turn = c.turn
"""


#: Conversations whose turns quote the two before them: as (conv_id, turn, role, text), in both dialects.
QUOTED_SQL = r"""
SELECT c.conv_id, c.turn, c.role,
       coalesce(CASE WHEN c.turn % 4 = 3 THEN concat('> > ', replace(b.text, chr(10), concat(chr(10), '> > ')), chr(10)) END, '')
       || coalesce(CASE WHEN c.turn % 4 <> 0 THEN concat('> ', replace(a.text, chr(10), concat(chr(10), '> ')), chr(10)) END, '')
       || coalesce(c.text, '') AS text
FROM conversations c
LEFT JOIN (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn) a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1
LEFT JOIN (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn) b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2
"""


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator over conversations that do quote."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView(view := f"conversations_{uuid.uuid4().hex}")
    return quote_digest(quotes.formatted(spark.sql(QUOTED_SQL.replace("FROM conversations", f"FROM {view}"))))


def quoted_sql() -> str:
    return OP4_SQL.replace("FROM conversations", "FROM quoted").replace("WITH RECURSIVE ", f"WITH RECURSIVE quoted AS ({QUOTED_SQL}), ")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0'), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER onward)::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY (3 * source_size)::DOUBLE / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), aims AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels
), budgets AS (
  SELECT *, coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) AS epochs,
         floor(target)::BIGINT - coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) * source_size AS rest
  FROM aims
), keyed AS (
  SELECT source, key, sum(size)::BIGINT AS at_key,
         (sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size))::BIGINT AS ahead
  FROM sized GROUP BY source, key
)
SELECT s.doc_id, s.size, b.source_size, b.target,
       (b.epochs * s.size + CASE WHEN s.size = 0 THEN 0
          ELSE s.size * least(greatest(b.rest - k.ahead, 0), k.at_key) // k.at_key END)::BIGINT AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
             JOIN keyed k ON s.source IS NOT DISTINCT FROM k.source AND s.key = k.key
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if (name.startswith("op") or name in ("pipeline", "quoted_conversations")) and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_chat_quotation_linking": OP4_SQL, "quoted_conversations": quoted_sql(), "op5_mixing_sources": OP5_SQL}
