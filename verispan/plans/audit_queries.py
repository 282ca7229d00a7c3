"""Contracts, leakage audits and agreement over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions.keys import norm_hash, norm_id, norm_label, norm_split, norm_tag
from verispan.functions.scalar import cosine
from verispan.operators import audits, metrics
from verispan.plans.claims import rounded
from verispan.plans.reference_queries import _BLANKS, _ID
from verispan.plans.registry import CORE
from verispan.session import table

_SPLIT = "CASE lower(trim({0}, " + _BLANKS + ")) WHEN 'train' THEN 'train' WHEN 'validation' THEN 'validation' WHEN 'val' THEN 'validation' WHEN 'calibration' THEN 'calibration' WHEN 'cal' THEN 'calibration' WHEN 'test' THEN 'test' END"
_STRIPPED = "regexp_replace(lower(trim({0}, " + _BLANKS + ")), '^sha256:', '')"
_HASH = f"CASE WHEN regexp_full_match({_STRIPPED}, '[0-9a-f]{{{{8,}}}}') AND NOT regexp_full_match({_STRIPPED}, '0+|f+') THEN {_STRIPPED} END"
_LABEL = "CASE WHEN lower(trim({0}, " + _BLANKS + ")) IN ('supported', 'hallucinated', 'unknown') THEN lower(trim({0}, " + _BLANKS + ")) END"
_TAG = "nullif(upper(regexp_replace(lower(trim({0}, " + _BLANKS + ")), '^annotator_', '')), '')"


def _claims(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "m7_claims")


_BREAKS = {
    "empty_key": f"{_ID.format('claim_id')} IS NULL",
    "detector_availability": "(evidence.detector_score IS NOT NULL) <> coalesce(evidence.detector_available, false)",
    "similarity_availability": "(evidence.clip_score IS NOT NULL) <> coalesce(evidence.similarity_available, false)",
    "detector_range": "isnan(evidence.detector_score) OR evidence.detector_score < 0 OR evidence.detector_score > 1",
    "similarity_range": "isnan(evidence.clip_score) OR evidence.clip_score < -1 OR evidence.clip_score > 1",
    "zero_substitution": "evidence.detector_score = 0 AND NOT coalesce(evidence.detector_available, false)",
}


@CORE.add("evidence_violations", " UNION ALL ".join(f"SELECT '{k}' AS violation, count(*) FILTER ({v}) AS n, count(*) AS n_rows, round(avg(evidence.detector_score), 6) AS mean_score FROM m7_claims" for k, v in _BREAKS.items()))
def evidence_violations(spark: SparkSession, base: str) -> DataFrame:
    """Every rule with the rows that break it, also where none does, beside the rows read."""
    e = lambda c: F.col(f"evidence.{c}")
    v = audits.evidence_violations(_claims(spark, base), norm_id("claim_id"), e("detector_score"), e("detector_available"), e("clip_score"), e("similarity_available"))
    n = v.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
    read = _claims(spark, base).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(e("detector_score")), 6).alias("mean_score"))
    rules = spark.createDataFrame([(k,) for k in _BREAKS], "violation string")
    return rules.join(n, "violation", "left").crossJoin(F.broadcast(read)).select("violation", F.coalesce("n", F.lit(0)).alias("n"), "n_rows", "mean_score")  # one row


@CORE.add("provenance_counts", "SELECT coalesce(evidence.vlm_generation_source, 'none') AS provenance, count(*) AS n, count(*) FILTER (is_synthetic) AS n_synthetic FROM m7_claims GROUP BY 1")
def provenance_counts(spark: SparkSession, base: str) -> DataFrame:
    return _claims(spark, base).groupBy(F.coalesce("evidence.vlm_generation_source", F.lit("none")).alias("provenance")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_synthetic").alias("n_synthetic"))


@CORE.add("images_in_several_splits", f"""SELECT image_id, count(DISTINCT s) AS n_values, min(s) AS first_value, max(s) AS last_value FROM (SELECT {_ID.format("image_id")} AS image_id, {_SPLIT.format("split")} AS s FROM m7_claims)
  WHERE image_id IS NOT NULL AND s IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) > 1""")  # fmt: skip
def images_in_several_splits(spark: SparkSession, base: str) -> DataFrame:
    return audits.in_several(_claims(spark, base), norm_id("image_id"), norm_split("split"), "image_id")


@CORE.add("hashes_in_several_splits", f"""SELECT file_hash, count(DISTINCT s) AS n_values, min(s) AS first_value, max(s) AS last_value FROM (SELECT {_HASH.format("image.file_hash")} AS file_hash, {_SPLIT.format("split")} AS s FROM m7_image_manifest)
  WHERE file_hash IS NOT NULL AND s IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) > 1""")  # fmt: skip
def hashes_in_several_splits(spark: SparkSession, base: str) -> DataFrame:
    return audits.in_several(table(spark, base, "m7_image_manifest"), norm_hash("image.file_hash"), norm_split("split"), "file_hash")


@CORE.add("claim_split_disagreement", f"""SELECT c.s AS child_value, p.s AS parent_value, count(*) AS n FROM (SELECT {_ID.format("image_id")} AS k, {_SPLIT.format("split")} AS s FROM m7_claims) c
  LEFT JOIN (SELECT {_ID.format("image.image_id")} AS k, min({_SPLIT.format("split")}) AS s, list({_SPLIT.format("split")}) AS all_s FROM m7_image_manifest GROUP BY 1) p ON c.k = p.k
  WHERE c.k IS NOT NULL AND CASE WHEN c.s IS NULL THEN p.s IS NOT NULL ELSE NOT coalesce(list_contains(p.all_s, c.s), false) END GROUP BY 1, 2""")  # fmt: skip
def claim_split_disagreement(spark: SparkSession, base: str) -> DataFrame:
    return audits.disagreeing(_claims(spark, base), norm_id("image_id"), norm_split("split"), table(spark, base, "m7_image_manifest"), norm_id("image.image_id"), norm_split("split"))


@CORE.add("split_hash_overlap", f"""WITH d AS (SELECT DISTINCT {_SPLIT.format("split")} AS s, {_HASH.format("image_hash")} AS h FROM m7_claims)
  SELECT a.s AS side_a, b.s AS side_b, count(*) AS n_shared FROM d a JOIN d b ON a.h = b.h AND a.s < b.s GROUP BY 1, 2""")  # fmt: skip
def split_hash_overlap(spark: SparkSession, base: str) -> DataFrame:
    return audits.shared_keys(_claims(spark, base), norm_split("split"), norm_hash("image_hash"))


@CORE.add("duplicate_claims", f"SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS n_repeated, CAST(sum(n - 1) AS BIGINT) AS n_extra_rows FROM (SELECT {_ID.format('image_id')} AS i, {_ID.format('claim_id')} AS c, count(*) AS n FROM m7_claims GROUP BY 1, 2)")
def duplicate_claims(spark: SparkSession, base: str) -> DataFrame:
    return audits.duplicate_keys(_claims(spark, base), [norm_id("image_id"), norm_id("claim_id")])


@CORE.add("images_without_claims", f"SELECT DISTINCT {_ID.format('image.image_id')} AS image_id FROM m7_image_manifest WHERE {_ID.format('image.image_id')} NOT IN (SELECT {_ID.format('image_id')} FROM m7_claims WHERE {_ID.format('image_id')} IS NOT NULL)")
def images_without_claims(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "m7_image_manifest").select(norm_id("image.image_id").alias("image_id")).where("image_id is not null").distinct()
    return m.join(_claims(spark, base).select(norm_id("image_id").alias("image_id")), "image_id", "left_anti")


@CORE.add("eligible_images", f"SELECT image_id, CAST(max(w) AS INT) AS width, CAST(max(h) AS INT) AS height FROM (SELECT {_ID.format('image.image_id')} AS image_id, image.width AS w, image.height AS h FROM m7_image_manifest WHERE deleted_at IS NULL) WHERE w >= 400 AND h >= 400 AND image_id IS NOT NULL GROUP BY 1")
def eligible_images(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "m7_image_manifest").where("deleted_at is null and image.width >= 400 and image.height >= 400")
    return d.select(norm_id("image.image_id").alias("image_id"), "image.width", "image.height").where("image_id is not null").groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))


@CORE.add("quality_report", f"""SELECT coalesce({_SPLIT.format("split")}, 'total') AS split, count(*) AS n_claims, count(DISTINCT {_ID.format("image_id")}) AS n_images, round(avg(CAST(evidence.detector_score IS NOT NULL AS INT)), 6) AS detector_coverage FROM m7_claims
  WHERE {_SPLIT.format("split")} IS NOT NULL GROUP BY ROLLUP ({_SPLIT.format("split")})""")  # fmt: skip
def quality_report(spark: SparkSession, base: str) -> DataFrame:
    d = _claims(spark, base).select(norm_split("split").alias("split"), norm_id("image_id").alias("i"), F.col("evidence.detector_score").isNotNull().cast("double").alias("on")).where("split is not null")
    g = d.rollup("split").agg(F.count(F.lit(1)).alias("n_claims"), F.countDistinct("i").alias("n_images"), F.avg("on").alias("detector_coverage"))
    return rounded(g.select(F.coalesce("split", F.lit("total")).alias("split"), "n_claims", "n_images", "detector_coverage"))


_LAST = f"""WITH l AS (SELECT item, annotator, arg_max(label, (t, label)) AS label FROM (SELECT {_ID.format("claim_id")} AS item, {_TAG.format("annotator_id")} AS annotator, {_LABEL.format("ground_truth_status")} AS label, labelled_at AS t FROM annotation_records)
  WHERE item IS NOT NULL AND annotator IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2),
 d AS (SELECT item, arg_max(label, (t, label)) AS decision FROM (SELECT {_ID.format("claim_id")} AS item, {_LABEL.format("adjudicated_status")} AS label, adjudicated_at AS t FROM adjudication_records) WHERE item IS NOT NULL AND label IS NOT NULL GROUP BY 1)"""


def _labels(spark: SparkSession, base: str) -> DataFrame:
    return audits.latest(table(spark, base, "annotation_records"), {"item": norm_id("claim_id"), "annotator": norm_tag("annotator_id")}, norm_label("ground_truth_status"), F.col("labelled_at"))


@CORE.add("adjudicated_status", _LAST + """ SELECT a.item, a.label AS label_a, b.label AS label_b, CASE WHEN a.label = b.label THEN a.label ELSE decision END AS final_status FROM l a JOIN l b ON a.item = b.item AND a.annotator = 'A' AND b.annotator = 'C' LEFT JOIN d ON d.item = a.item""")
def adjudicated_status(spark: SparkSession, base: str) -> DataFrame:
    d = audits.latest(table(spark, base, "adjudication_records"), {"item": norm_id("claim_id")}, norm_label("adjudicated_status"), F.col("adjudicated_at"))
    return audits.adjudicated(_labels(spark, base), "A", "C", d)


@CORE.add("annotator_kappa", _LAST + """ SELECT b AS annotator, n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM (
  SELECT b.annotator AS b, count(*) AS n, avg(CAST(a.label = b.label AS INT)) AS po, avg(CAST(a.label = 'supported' AS INT)) * avg(CAST(b.label = 'supported' AS INT)) + avg(CAST(a.label = 'hallucinated' AS INT)) * avg(CAST(b.label = 'hallucinated' AS INT))
    + avg(CAST(a.label = 'unknown' AS INT)) * avg(CAST(b.label = 'unknown' AS INT)) AS pe FROM l a JOIN l b ON a.item = b.item AND a.annotator = 'A' AND b.annotator <> 'A' GROUP BY 1)""")  # fmt: skip
def annotator_kappa(spark: SparkSession, base: str) -> DataFrame:
    """Cohen's kappa of annotator A with every other one over their common claims."""
    l = _labels(spark, base)
    a = l.where("annotator = 'A'").select("item", F.col("label").alias("a"))
    j = l.where("annotator != 'A'").join(a, "item")
    return rounded(metrics.cohens_kappa(j, F.col("a"), F.col("label"), ("supported", "hallucinated", "unknown"), ["annotator"]))


@CORE.add("label_cosine", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) b USING (label)""")
def label_cosine(spark: SparkSession, base: str) -> DataFrame:
    """Cosine of every vector with the first one of its label."""
    e = table(spark, base, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return rounded(e.join(first, "label").select("vec_id", cosine(F.col("embedding"), F.col("first")).alias("similarity")))


@CORE.add("category_counts", f"SELECT v.category_name, v.supercategory, count(c.k) AS n_claims FROM category_vocab v LEFT JOIN (SELECT {_ID.format('object_category')} AS k FROM m7_claims) c ON c.k = lower(v.category_name) GROUP BY 1, 2")
def category_counts(spark: SparkSession, base: str) -> DataFrame:
    c = _claims(spark, base).select(norm_id("object_category").alias("k")).groupBy("k").agg(F.count("k").alias("n"))
    v = table(spark, base, "category_vocab").select("category_name", "supercategory", F.lower("category_name").alias("k"))
    return v.join(c, "k", "left").groupBy("category_name", "supercategory").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_claims"))
