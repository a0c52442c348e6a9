"""The registered queries of this subpackage: one per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit_sql, ball_simhash, cap_filters, chat_collapse, filter_audit, language_id, license_scan, lm_scoring, lz_fingerprint, merkle_manifest, pareto_mix, piece_coding, quality_eb, residual_packing
from .common import read

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("base_starts")


def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(read(spark, sf_dir, "embeddings"))


def site(docs: DataFrame) -> tuple:
    """Host and path of a document: its source, and its language within it."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.coalesce("lang", F.lit("")))


def op4_quality_eb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_eb.classify(docs, read(spark, sf_dir, "labels"), *site(docs))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.taken(read(spark, sf_dir, "documents")).drop("copies")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.render(read(spark, sf_dir, "conversations"))


def op8_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def op10_ball_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def op12_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_coding.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECES), decoded="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified(merkle_manifest.manifest(read(spark, sf_dir, "documents"))).drop("path", "tampered")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_lm_scoring, op2_license_scan, op3_cap_filters, op4_quality_eb, op5_pareto_mix, op6_language_id, op7_chat_collapse, op8_residual_packing, op9_lz_fingerprint, op10_ball_simhash, op11_filter_audit, op12_piece_coding, op13_merkle_manifest)
    return {f.__name__: f for f in ops}


SQL = {
    "op3_cap_filters": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), fine AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN low ON vec_id = low.a LEFT JOIN n ON vec_id = n.a""",
    "op5_pareto_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    length(bin(greatest(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0), 1)::BIGINT)) - 1 AS class, (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0 AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
    2 * source_size::DOUBLE AS cap FROM s
), f AS (
  SELECT *, row_number() OVER o AS place,
    ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM f WHERE level <= cap / w) * w, cap)) AS target FROM f
), p AS (
  SELECT *, target - whole * source_size AS need FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(least(2.0::DOUBLE, target / source_size)) ELSE 0 END AS whole FROM t)
), c AS (
  SELECT d.source, d.class, sqrt(pow(2.0::DOUBLE, d.class)) AS m, sum(d.size)::BIGINT AS words, any_value(greatest(0, p.need)) AS need FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY d.source, d.class
), e AS (
  SELECT source, class, m, CASE WHEN upto > 0 THEN (need - above) / upto ELSE 0 END AS scale FROM (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
    sum(m * words) OVER (PARTITION BY source ORDER BY class ROWS UNBOUNDED PRECEDING) AS upto FROM c)
), i AS (
  SELECT source, greatest(0, arg_max(scale, class)) AS scale FROM e WHERE scale * m < 1 GROUP BY source
), o AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.need, sqrt(pow(2.0::DOUBLE, d.class)) * coalesce(i.scale, 0) AS p FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN i ON d.source IS NOT DISTINCT FROM i.source
), q AS (
  SELECT *, (u / (1 - u)) / (least(greatest(p, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) / (1 - least(greatest(p, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE))) AS q,
    need - coalesce(sum(size) FILTER (p >= 1) OVER (PARTITION BY source), 0) AS left_over FROM o
), r AS (
  SELECT *, p < 1 AND left_over > 0 AND coalesce(sum(size) OVER (PARTITION BY source, p < 1 ORDER BY q, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 <= left_over AS first FROM q
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN p >= 1 OR first THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    "op7_chat_collapse": r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(nullif(coalesce(list_position(['system', 'user', 'assistant', 'tool'], role), 0), 0), 5) AS rank, role, text,
    md5(coalesce('v' || length(role) || ':' || role, 'n') || '|' || coalesce('v' || length(text) || ':' || text, 'n')) AS h FROM conversations
), k AS (
  SELECT *, coalesce('c' || conv_id, 't' || h) AS key FROM t
), p AS (
  SELECT *, string_agg(h, '') OVER (w ROWS UNBOUNDED PRECEDING) AS pre, row_number() OVER w AS k, count(*) OVER (PARTITION BY key) AS n FROM k WINDOW w AS (PARTITION BY key ORDER BY turn NULLS FIRST, rank, role NULLS FIRST, h)
), whole AS (
  SELECT pre, arg_min(key, (conv_id IS NULL, coalesce(conv_id, 0), key)) AS key, min(conv_id) AS conv_id, count(*) AS n_snapshots, min(n) AS n_turns FROM p WHERE k = n GROUP BY pre
), kept AS (
  SELECT * FROM whole WHERE pre NOT IN (SELECT pre FROM p WHERE k < n)
)
SELECT s.conv_id, s.n_turns::BIGINT AS n_turns, s.n_snapshots::BIGINT AS n_snapshots,
  string_agg('<|' || coalesce(k.role, '') || '|>' || chr(10) || coalesce(k.text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY k.turn NULLS FIRST, k.rank, k.role NULLS FIRST, k.h) AS rendered
FROM kept s JOIN k USING (key) GROUP BY s.key, s.conv_id, s.n_turns, s.n_snapshots""",
}


def oracle_sql() -> dict[str, str]:
    return SQL | {"op11_filter_audit": audit_sql.FILTER_AUDIT, "op13_merkle_manifest": audit_sql.MERKLE_MANIFEST}
