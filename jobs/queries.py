"""The jobs as queries: run twice into one new folder of the shared root, then the output as it stands, and SQL for it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import model
from quillspark.workspace import shared_root

from . import preflight_audit, refresh_index
from .common import read


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "refresh-index")
    for _ in range(2):
        refresh_index.refresh(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    found = refresh_index.current(spark, f"{at}/out")
    return found.select("source", "file_path", "start_line", "end_line", "part_index", "part_total", "tokens", "content_hash", F.size("vector").alias("vector_size"))


def job2_preflight_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "preflight-audit")
    for _ in range(2):
        preflight_audit.audit(spark, f"{sf_dir}/documents.parquet", at, "first")
    profile, findings, summary = (read(spark, f"{at}/{name}/snapshot=first", schema) for name, schema in (("profile", preflight_audit.PROFILE), ("findings", preflight_audit.FINDINGS), ("summary", preflight_audit.SUMMARY)))
    none = F.lit(None).cast("string")
    rows = profile.select(F.lit("profile").alias("section"), "source", "language", "id", F.col("digest").alias("kind"), F.col("tokens").alias("amount"), F.concat_ws("/", "bytes", "lines", "longest_line").alias("related"))
    rows = rows.unionByName(findings.select(F.lit("findings").alias("section"), "source", "language", "id", "kind", "amount", "related"))
    figures = [f.split(" ")[0] for f in preflight_audit.SUMMARY.split(", ")[2:]]
    return rows.unionByName(summary.unpivot(["source", "language"], figures, "kind", "amount").select(F.lit("summary").alias("section"), "source", "language", none.alias("id"), "kind", "amount", none.alias("related")))


_WORD = r"[^\x20\x09-\x0D]"
_UNITS = 4 * model.MAX_CHUNK_TOKENS
REFRESH_INDEX = rf"""
WITH RECURSIVE l AS (SELECT coalesce(nullif(source, ''), '(none)') AS source, coalesce(nullif(source, ''), '(none)') || '/' || doc_id || '.md' AS file_path, string_split(text, chr(10)) AS ls FROM documents WHERE regexp_matches(text, '{_WORD}')),
w AS (SELECT source, file_path, ls, 1::BIGINT AS k, 1::BIGINT AS s, length(ls[1])::BIGINT AS held FROM l
 UNION ALL SELECT source, file_path, ls, k + 1, CASE WHEN held + 1 + length(ls[k + 1]) > {_UNITS} THEN k + 1 ELSE s END, CASE WHEN held + 1 + length(ls[k + 1]) > {_UNITS} THEN length(ls[k + 1]) ELSE held + 1 + length(ls[k + 1]) END FROM w WHERE k < len(ls)),
c AS (SELECT source, file_path, s AS start_line, max(k) AS end_line, array_to_string(any_value(ls)[s:max(k)], chr(10)) AS content FROM w GROUP BY source, file_path, s),
p AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line) AS part_index, count(*) OVER (PARTITION BY file_path) AS part_total FROM c)
SELECT source, file_path, start_line::INT AS start_line, end_line::INT AS end_line, part_index::INT AS part_index, part_total::INT AS part_total, ceil(length(content) / 4.0)::INT AS tokens,
sha256('generic' || chr(0) || file_path || chr(0) || chr(0) || part_index || chr(0) || content) AS content_hash, {refresh_index.DEFAULTS["vector_size"]}::INT AS vector_size FROM p"""

PREFLIGHT_AUDIT = rf"""
WITH d AS (SELECT doc_id, doc_id::VARCHAR AS id, coalesce(nullif(source, ''), '(none)') AS source, coalesce(nullif(lang, ''), '(none)') AS language, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, strlen(t)::BIGINT AS bytes, len(string_split(t, chr(10)))::BIGINT AS lines, ceil(length(t) / 4.0)::BIGINT AS tokens, list_max(list_transform(string_split(t, chr(10)), lambda x: ceil(length(x) / 4.0)))::BIGINT AS longest_line,
 regexp_matches(t, '{_WORD}') AS has_word, CASE WHEN strlen(t) > {model.MAX_FILE_BYTES} THEN 'too-large' END AS skip, sha256(t) AS digest FROM d),
g AS (SELECT digest, min(doc_id)::VARCHAR AS first, count(*) AS copies FROM p GROUP BY digest),
q AS (SELECT p.*, g.first, g.copies, copies > 1 AND id <> first AS copy FROM p JOIN g USING (digest)),
f AS (SELECT source, language, id, 'empty' AS kind, bytes AS amount, NULL AS related FROM q WHERE NOT has_word UNION ALL SELECT source, language, id, skip, bytes, NULL FROM q WHERE skip IS NOT NULL
 UNION ALL SELECT source, language, id, 'over-budget', tokens, NULL FROM q WHERE tokens > {model.CONTEXT_BUDGET} UNION ALL SELECT source, language, id, 'long-line', longest_line, NULL FROM q WHERE longest_line > {model.MAX_CHUNK_TOKENS}
 UNION ALL SELECT source, language, id, 'copy', copies, first FROM q WHERE copy AND has_word),
n AS (SELECT source, language, count(*) AS findings FROM f GROUP BY ALL),
s AS (SELECT source, language, count(*)::BIGINT AS documents, sum(bytes)::BIGINT AS bytes, sum(tokens)::BIGINT AS tokens, count(*) FILTER (copy AND has_word)::BIGINT AS copies, coalesce(any_value(n.findings), 0)::BIGINT AS findings,
 coalesce(sum(tokens) FILTER (has_word AND skip IS NULL AND NOT copy), 0)::BIGINT AS tokens_to_embed, ({preflight_audit.DEFAULTS["microcents_per_token"]} * coalesce(sum(tokens) FILTER (has_word AND skip IS NULL AND NOT copy), 0))::BIGINT AS cost_microcents
 FROM q LEFT JOIN n USING (source, language) GROUP BY source, language)
SELECT 'profile' AS section, source, language, id, digest AS kind, tokens AS amount, bytes || '/' || lines || '/' || longest_line AS related FROM q
UNION ALL SELECT 'findings', source, language, id, kind, amount, related FROM f
UNION ALL SELECT 'summary', source, language, NULL, kind, amount, NULL FROM (UNPIVOT s ON documents, bytes, tokens, copies, findings, tokens_to_embed, cost_microcents INTO NAME kind VALUE amount)"""

QUERIES = {"job1_refresh_index": job1_refresh_index, "job2_preflight_audit": job2_preflight_audit}
ORACLES = {"job1_refresh_index": REFRESH_INDEX, "job2_preflight_audit": PREFLIGHT_AUDIT}
