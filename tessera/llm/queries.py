"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.decontamination import find_leaks
from tessera.llm.licenses import scan_licenses
from tessera.llm.linededup import drop_boilerplate
from tessera.llm.lm import score_documents
from tessera.llm.mixing import mix_documents
from tessera.llm.neardup import near_duplicates
from tessera.llm.quality import quality_rules
from tessera.llm.secretscan import scan_secrets
from tessera.llm.sharding import shard_documents
from tessera.llm.toxicity import score_toxicity


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).drop("source")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 16)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_WORDS = r"'[^\x20\x09-\x0D]+'"

# Every pair of documents with a shingle in common is counted, and links are followed to their end.
_OP3 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)] END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) LEFT JOIN n USING (doc_id)"""

_OP4 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
r AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
      sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM w),
l AS (SELECT max((budget - full_before) / weight_from) AS level, max(budget) AS budget FROM r WHERE (budget - full_before) / weight_from * weight <= most),
t AS (SELECT source, source_size, least(level * weight, most) AS target FROM r, l),
q AS (SELECT d.*, t.source_size, t.target, md5(coalesce(doc_id::VARCHAR, '')) AS h,
      sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, unnest([0, 1]) AS k FROM q WHERE size > 0 AND target > 0),
f AS (SELECT *, (ahead + k * source_size) / target AS f FROM c),
o AS (SELECT f, sum(size) OVER (ORDER BY f, coalesce('s' || source, 'n'), h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM f),
e AS (SELECT max(f) AS last FROM o, l WHERE upto <= budget)
SELECT q.doc_id, q.size, q.source_size, q.target,
(q.size * (CASE WHEN q.target > 0 THEN (q.ahead / q.target <= last)::INTEGER + ((q.ahead + q.source_size) / q.target <= last)::INTEGER ELSE 0 END))::BIGINT AS taken FROM q, e"""

_OP9 = r"""
WITH p AS (SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, host, regexp_replace(regexp_replace(t, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|main|aside|blockquote|pre)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM p),
l AS (SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM b),
n AS (SELECT host, count(*) AS pages FROM l GROUP BY 1),
c AS (SELECT host, x, count(*) AS c FROM (SELECT DISTINCT page_id, host, unnest(lines) AS x FROM l) GROUP BY 1, 2),
m AS (SELECT host, list(x) AS common FROM c JOIN n USING (host) WHERE c >= 3 AND c > 0.2 * pages GROUP BY 1),
k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept FROM l LEFT JOIN m USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_neardup": _OP3, "op4_mixing": _OP4, "op9_line_dedup": _OP9.replace("\\\\", "\\")}
