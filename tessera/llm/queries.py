"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import class_lm, fingerprints, jaccard_join, line_dedup, mixing, packing, pii, quality_rules, substring_dedup, url_filter
from tessera.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.group_documents(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_mixing, op3_packing, op4_jaccard_join, op5_pii,
        op6_line_dedup, op7_url_filter, op8_substring_dedup, op9_class_lm, op10_fingerprints,
    )
}  # fmt: skip

ORACLES: dict[str, str] = {
    # sizes and targets by water-filling, the order of documents by MD5 as in the operator
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	
]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS demand FROM s0),
s2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY cap / w, rank) AS k FROM s2),
s4 AS (SELECT *, (demand - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
lv AS (SELECT arg_min(level, k) AS level FROM s4 WHERE level * w <= cap),
t AS (SELECT source, source_size, rank, coalesce(least(cap, w * (SELECT level FROM lv)), cap) AS target FROM s4),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - source_size - before)) AS taken,
  CASE WHEN target > 0 THEN least(1.0, before / target) ELSE 0 END AS y FROM p),
z AS (SELECT *, CASE rank % 3 WHEN 0 THEN CASE WHEN y >= 0.625 THEN 1 ELSE 0 END WHEN 1 THEN 2 ELSE CASE WHEN y >= 0.375 THEN 4 ELSE 3 END END AS seg FROM q),
u AS (SELECT *, CASE seg WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 ELSE 0.5 END AS t0, CASE seg WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 ELSE 1.0 END AS w0,
  CASE seg WHEN 2 THEN 0.0 WHEN 0 THEN -1.0 WHEN 1 THEN -1.0 ELSE 1.0 END AS slope, y - CASE seg WHEN 1 THEN 0.625 WHEN 4 THEN 0.375 ELSE 0.0 END AS rest FROM z)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  round(CASE WHEN taken > 0 THEN least(1.0, t0 + CASE WHEN rest <= 0 THEN 0.0 ELSE 2 * rest / (w0 + sqrt(greatest(0.0, w0 * w0 + 2 * slope * rest))) END) END, 9) AS position
FROM u""",
    # all pairs of documents that share a shingle, then the smallest id that links reach
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	
]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e0 AS (SELECT x, y FROM pr JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM e0 UNION ALL SELECT y, x FROM e0),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = w.doc_id""",
}
