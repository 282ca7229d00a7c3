"""Queries of stand-in models, synthetic data and benchmark mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions.keys import norm_id
from verispan.operators import providers
from verispan.plans.claim_queries import _U
from verispan.plans.reference_queries import _ID
from verispan.plans.registry import CORE
from verispan.session import table
from verispan.sources import records

_REQUESTS = f"SELECT DISTINCT {_ID.format('image_id')} AS image_id, {_ID.format('object_category')} AS object_category FROM m7_claims WHERE {_ID.format('image_id')} IS NOT NULL AND {_ID.format('object_category')} IS NOT NULL"


@CORE.add("stand_in_scores", f"SELECT image_id, object_category, NOT ({_U.format(chr(34) + 'image_id' + chr(34) + ' || ' + repr('|') + ' || object_category || ' + repr('|available'))} < 0.1) AS detector_available, CASE WHEN NOT ({_U.format('image_id || ' + repr('|') + ' || object_category || ' + repr('|available'))} < 0.1) THEN round({_U.format('image_id || ' + repr('|') + ' || object_category || ' + repr('|detector'))}, 6) END AS detector_score FROM ({_REQUESTS})")
def stand_in_scores(spark: SparkSession, base: str) -> DataFrame:
    """Scores of the stand-in detector for every image and category that claims ask for."""
    c = table(spark, base, "m7_claims").select(norm_id("image_id").alias("image_id"), norm_id("object_category").alias("object_category")).where("image_id is not null and object_category is not null").distinct()
    return providers.stand_in_detector(c).select("image_id", "object_category", "detector_available", "detector_score")


_V = lambda k: _U.format(f"'syn_' || i || '|' || o || '|smoke-{k}'")


@CORE.add("synthetic_claims", f"SELECT 'syn_' || i AS image_id, CAST(o AS INT) AS ordinal, 'syn_' || i || '_' || o AS claim_id, round({_V('det')}, 6) AS det, round(2 * {_V('sim')} - 1, 6) AS sim, CAST({_V('y')} < 0.3 AS INT) AS y, true AS is_synthetic FROM range(200) a(i), range(1, 4) b(o)")
def synthetic_claims(spark: SparkSession, base: str) -> DataFrame:
    """The data set of smoke runs."""
    return records.synthetic_claims(spark, 200)


@CORE.add("presence_questions", """SELECT supported_task, count(*) AS n, count(DISTINCT object_category) AS n_categories FROM (SELECT nullif(regexp_extract(lower(trim(prompt)), '^(?:is|are) there (?:(?:an?|the|any)\\s+)?(.+?)(?: (?:in|on) (?:the|this) (?:image|picture|photo))?\\s*\\?*$', 1), '') AS object_category,
  coalesce(regexp_extract(lower(trim(prompt)), '^(?:is|are) there (?:(?:an?|the|any)\\s+)?(.+?)(?: (?:in|on) (?:the|this) (?:image|picture|photo))?\\s*\\?*$', 1) <> '', false) AS supported_task FROM vlm_responses) GROUP BY 1""")  # fmt: skip
def presence_questions(spark: SparkSession, base: str) -> DataFrame:
    """Prompts that ask whether an object is there, and those that ask something else."""
    r = table(spark, base, "vlm_responses").select(F.col("prompt").alias("question"), F.col("caption").alias("answer"), F.col("image_path").alias("image"))
    return records.map_yes_no(r).groupBy("supported_task").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("object_category").alias("n_categories"))
