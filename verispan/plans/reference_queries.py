"""Problem 3: references that do not hold, over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions.keys import norm_id
from verispan.operators.references import Reference, orphan_references, orphan_report
from verispan.plans.registry import CORE
from verispan.session import table


def project_references(spark: SparkSession, base: str) -> list[Reference]:
    claims = table(spark, base, "m7_claims")
    manifest = table(spark, base, "m7_image_manifest")
    tasks = table(spark, base, "m7_template_annotator_a")
    return [
        Reference("m7_claims", "m7_image_manifest", claims, norm_id("claim_id"), norm_id("image_id"), F.col("ingested_at"), manifest, norm_id("image.image_id"), F.col("ingested_at"), F.col("deleted_at").isNotNull()),
        Reference("m7_template_annotator_a", "m7_claims", tasks, F.col("task_id"), norm_id("claim_id"), F.col("ingested_at"), claims, norm_id("claim_id"), F.col("ingested_at"), F.col("deleted_at").isNotNull()),
    ]


_BLANKS = "E' \\t\\n\\r\\x0b\\x0c\u00a0\u2007\u202f\u200b\ufeff'"
_ID = "nullif(lower(trim({0}, " + _BLANKS + ")), '')"

_LINKS = f"""
WITH child AS (
  SELECT 'm7_claims' AS child_table, 'm7_image_manifest' AS parent_table, {_ID.format("claim_id")} AS child_key,
         {_ID.format("image_id")} AS k, ingested_at AS t FROM m7_claims
  UNION ALL
  SELECT 'm7_template_annotator_a', 'm7_claims', task_id, {_ID.format("claim_id")}, ingested_at FROM m7_template_annotator_a
), parent AS (
  SELECT parent_table, k, min(t) AS first_t, bool_and(gone) AS all_gone FROM (
    SELECT 'm7_image_manifest' AS parent_table, {_ID.format("image.image_id")} AS k, ingested_at AS t, deleted_at IS NOT NULL AS gone FROM m7_image_manifest
    UNION ALL
    SELECT 'm7_claims', {_ID.format("claim_id")}, ingested_at, deleted_at IS NOT NULL FROM m7_claims
  ) WHERE k IS NOT NULL GROUP BY 1, 2
)"""

P3_FOUND_SQL = (
    _LINKS
    + """, seen AS (
  SELECT child_table, child_key, min(t) AS first_seen FROM child WHERE child_key IS NOT NULL GROUP BY 1, 2
), judged AS (
  SELECT c.child_table, c.child_key,
         CASE WHEN p.k IS NULL THEN 0 WHEN p.all_gone THEN 1 WHEN p.first_t > s.first_seen THEN 2 END AS kind
  FROM (SELECT DISTINCT child_table, parent_table, child_key, k FROM child WHERE child_key IS NOT NULL AND k IS NOT NULL) c
  JOIN seen s USING (child_table, child_key) LEFT JOIN parent p ON p.parent_table = c.parent_table AND p.k = c.k
)
SELECT child_table, child_key, CASE min(kind) WHEN 0 THEN 'missing' WHEN 1 THEN 'deleted' ELSE 'late' END AS orphan_kind
FROM judged WHERE kind IS NOT NULL GROUP BY 1, 2"""
)

P3_REPORT_SQL = (
    _LINKS
    + """
SELECT c.child_table, coalesce(strftime(c.t, '%Y-%m'), 'none') AS period, count(*) AS n_rows,
       count(*) FILTER (c.k IS NULL) AS n_null_ref,
       count(*) FILTER (c.k IS NOT NULL AND p.k IS NULL) AS n_missing,
       count(*) FILTER (p.all_gone) AS n_deleted,
       count(*) FILTER (NOT p.all_gone AND p.first_t > c.t) AS n_late
FROM child c LEFT JOIN parent p ON p.parent_table = c.parent_table AND p.k = c.k GROUP BY 1, 2"""
)


@CORE.add("p3_found", P3_FOUND_SQL)
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return orphan_references(project_references(spark, base))


@CORE.add("p3_report", P3_REPORT_SQL)
def p3_report(spark: SparkSession, base: str) -> DataFrame:
    return orphan_report(project_references(spark, base))
