"""Splits, cohorts, digests, cache keys and dataset joins over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions.keys import norm_id, norm_label, norm_split, norm_tag
from verispan.operators import audits, datasets, hashing, splitting
from verispan.plans.audit_queries import _LAST, _SPLIT, _TAG
from verispan.plans.claims import rounded
from verispan.plans.reference_queries import _ID
from verispan.plans.registry import CORE
from verispan.session import table

_IMG = _ID.format("image.image_id")
_CLM = _ID.format("claim_id")
_IMAGES = f"SELECT DISTINCT {_IMG} AS image_id FROM m7_image_manifest WHERE {_IMG} IS NOT NULL"
SHARES = (("train", 0.6), ("validation", 0.15), ("calibration", 0.15), ("test", 0.1))


def _images(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "m7_image_manifest").select(norm_id("image.image_id").alias("image_id")).where("image_id is not null").distinct()


def _cuts(rank: str) -> str:
    upto, out = 0.0, "CASE"
    for name, s in SHARES[:-1]:
        upto += s
        out += f" WHEN {rank} <= round(n * {upto!r}) THEN '{name}'"
    return out + f" ELSE '{SHARES[-1][0]}' END"


def _slices(key: str) -> str:
    return f"SELECT image_id, {_cuts('r')} AS split FROM (SELECT image_id, row_number() OVER (ORDER BY {key}, image_id) AS r, count(*) OVER () AS n FROM ({_IMAGES}))"


@CORE.add("sliced_splits", _slices("image_id"))
def sliced_splits(spark: SparkSession, base: str) -> DataFrame:
    """Contiguous slices of the sorted ids."""
    return splitting.sliced(_images(spark, base), "image_id", SHARES)


@CORE.add("seeded_splits", _slices("md5('seed-1|' || image_id)"))
def seeded_splits(spark: SparkSession, base: str) -> DataFrame:
    return splitting.sliced(_images(spark, base), "image_id", SHARES, "seed-1")


@CORE.add("claim_splits", f"SELECT s.split, count(*) AS n_claims, count(DISTINCT c.image_id) AS n_images FROM (SELECT {_ID.format('image_id')} AS image_id FROM m7_claims) c JOIN ({_slices('image_id')}) s USING (image_id) GROUP BY 1")
def claim_splits(spark: SparkSession, base: str) -> DataFrame:
    """Claims follow their image's split."""
    c = table(spark, base, "m7_claims").select(norm_id("image_id").alias("image_id"))
    return c.join(sliced_splits(spark, base), "image_id").groupBy("split").agg(F.count(F.lit(1)).alias("n_claims"), F.countDistinct("image_id").alias("n_images"))


@CORE.add("counted_splits", f"SELECT image_id, CASE WHEN r <= 20 THEN 'train' WHEN r <= 30 THEN 'validation' ELSE 'test' END AS split FROM (SELECT image_id, row_number() OVER (ORDER BY md5('count|' || image_id)) AS r FROM ({_IMAGES})) WHERE r <= 40")
def counted_splits(spark: SparkSession, base: str) -> DataFrame:
    """Exact numbers per split of a seeded order: a sample of forty images."""
    return splitting.counted(_images(spark, base), "image_id", (("train", 20), ("validation", 10), ("test", 10)), "count")


_GROUPS = f"""g AS (SELECT DISTINCT {_IMG} AS image_id, coalesce(lower(trim(image.dataset_source)), 'none') || '/' || substr({_IMG}, -2) AS grp FROM m7_image_manifest WHERE {_IMG} IS NOT NULL),
  gr AS (SELECT grp, row_number() OVER (ORDER BY md5('group|' || grp), grp) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM g))"""


@CORE.add("grouped_splits", f"WITH {_GROUPS} SELECT image_id, grp AS \"group\", {_cuts('r')} AS split FROM g JOIN gr USING (grp)")
def grouped_splits(spark: SparkSession, base: str) -> DataFrame:
    """Groups (source and last two characters of the id) that stay together."""
    m = table(spark, base, "m7_image_manifest").withColumn("image_id", norm_id("image.image_id"))
    group = F.concat(F.coalesce(F.lower(F.trim("image.dataset_source")), F.lit("none")), F.lit("/"), F.substring("image_id", -2, 2))
    return splitting.grouped(m, "image_id", group, SHARES, "group")


@CORE.add("cohort", f"SELECT image_id, CAST(r AS BIGINT) AS rank FROM (SELECT image_id, row_number() OVER (ORDER BY md5('cohort|' || image_id)) AS r FROM ({_IMAGES})) WHERE r <= 50")
def cohort(spark: SparkSession, base: str) -> DataFrame:
    """A seeded sample of fifty images: a sampling operator."""
    return splitting.cohort(_images(spark, base), "image_id", 50, "cohort")


@CORE.add("preregistered_splits", f"""SELECT image_id, split, CASE WHEN split = 'train' AND r - 10 <= 5 THEN 'cal' WHEN split = 'train' AND r - 10 <= 15 THEN 'eval' END AS pilot FROM (
  SELECT image_id, r, CASE WHEN r <= 10 THEN 'test' WHEN r <= 40 THEN 'train' ELSE 'calibration' END AS split FROM (SELECT image_id, row_number() OVER (ORDER BY md5('prereg|' || image_id)) AS r FROM ({_IMAGES})) WHERE r <= 60)""")  # fmt: skip
def preregistered_splits(spark: SparkSession, base: str) -> DataFrame:
    """Fixed sizes with a pilot at the beginning of the train split."""
    return splitting.preregistered(_images(spark, base), "image_id", (("test", 10), ("train", 30), ("calibration", 20)), 15, 5, "prereg")


@CORE.add("image_shards", f"SELECT image_id, CAST((row_number() OVER (ORDER BY image_id) - 1) % 8 AS INT) AS shard FROM ({_IMAGES})")
def image_shards(spark: SparkSession, base: str) -> DataFrame:
    return splitting.shards(_images(spark, base), "image_id", 8)


@CORE.add("corruption_manifest", f"SELECT image_id, family, severity FROM ({_IMAGES}), (VALUES ('blur'), ('jpeg'), ('noise')) f(family), (VALUES ('light'), ('medium'), ('heavy')) s(severity)")
def corruption_manifest(spark: SparkSession, base: str) -> DataFrame:
    return splitting.condition_grid(_images(spark, base), "image_id", ("blur", "jpeg", "noise"), ("light", "medium", "heavy"))


_CATS = f"SELECT {_ID.format('image_id')} AS image_id, list_sort(list_distinct(list({_ID.format('object_category')}))) AS cats FROM m7_claims WHERE {_ID.format('image_id')} IS NOT NULL AND {_ID.format('object_category')} IS NOT NULL GROUP BY 1"


@CORE.add("picked_objects", f"SELECT image_id, cats[CAST('0x' || substr(md5('pick|' || image_id), 1, 8) AS BIGINT) % len(cats) + 1] AS picked FROM ({_CATS})")
def picked_objects(spark: SparkSession, base: str) -> DataFrame:
    """One of each image's categories, by seed."""
    c = table(spark, base, "m7_claims").select(norm_id("image_id").alias("image_id"), norm_id("object_category").alias("c")).where("image_id is not null and c is not null")
    g = c.groupBy("image_id").agg(F.collect_set("c").alias("cats"))  # the distinct categories of one image
    return g.select("image_id", splitting.pick_one(F.col("cats"), "pick", F.col("image_id")).alias("picked"))


@CORE.add("binomial_precision", f"SELECT split, n, round(1.959963984540054 * sqrt(p * (1 - p) / n), 6) AS half_width FROM (SELECT {_SPLIT.format('split')} AS split, count(*) AS n, avg(CAST(evidence.detector_score >= 0.5 AS INT)) AS p FROM m7_claims GROUP BY 1) WHERE split IS NOT NULL")
def binomial_precision(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "m7_claims").groupBy(norm_split("split").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("evidence.detector_score") >= 0.5).cast("double")).alias("p")).where("split is not null")
    return rounded(g.select("split", "n", splitting.binomial_half_width(F.col("n"), F.col("p")).alias("half_width")))


_DIGEST = """SELECT {k} n, sha256(concat_ws('|', CAST(n AS VARCHAR), CAST(s0 AS VARCHAR), CAST(s1 AS VARCHAR), CAST(s2 AS VARCHAR), CAST(s3 AS VARCHAR))) AS digest FROM (
  SELECT {k} count(*) AS n, """ + ", ".join(f"sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS HUGEINT)) AS s{i}" for i in range(4)) + " FROM (SELECT {k} sha256({row}) AS h FROM {src}) {g})"  # fmt: skip


def _row_sql(*cols: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce('=' || replace(replace(CAST({c} AS VARCHAR), '\\', '\\\\'), '|', '\\p'), '~')" for c in cols) + ")"


@CORE.add("claims_digest", _DIGEST.format(k="", row=_row_sql("claim_id", "image_id", "object_category", "caption", "split"), src="m7_claims", g=""))
def claims_digest(spark: SparkSession, base: str) -> DataFrame:
    """The digest of the claims, whatever their order."""
    return hashing.digest(table(spark, base, "m7_claims"), hashing.canonical_row(*(F.col(c) for c in ("claim_id", "image_id", "object_category", "caption", "split"))))


@CORE.add("split_digests", _DIGEST.format(k="split,", row=_row_sql("image_id"), src=f"({_slices('image_id')})", g="GROUP BY split"))
def split_digests(spark: SparkSession, base: str) -> DataFrame:
    return hashing.split_digests(sliced_splits(spark, base), "image_id")


@CORE.add("split_isolation", f"""WITH d AS (SELECT DISTINCT {_SPLIT.format("split")} AS s, {_CLM} AS k FROM m7_claims WHERE {_CLM} IS NOT NULL) SELECT a.s AS split_a, b.s AS split_b, count(*) AS n_shared FROM d a JOIN d b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2""")
def split_isolation(spark: SparkSession, base: str) -> DataFrame:
    """Claims that occur in two splits."""
    d = table(spark, base, "m7_claims").select(norm_id("claim_id").alias("claim_id"), norm_split("split").alias("split"))
    return hashing.split_isolation(d, "claim_id")


_CACHE_PARTS = ("image_hash", "model_name", "model_revision", "prompt", "gen_config.max_new_tokens", "gen_config.num_beams", "is_synthetic")
_CACHE_KEY = "sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in _CACHE_PARTS) + "))"


@CORE.add("cache_keys", f"SELECT {_CACHE_KEY} AS cache_key, count(*) AS n, count(DISTINCT response_id) AS n_responses FROM vlm_responses GROUP BY 1")
def cache_keys(spark: SparkSession, base: str) -> DataFrame:
    """Content keys of the answers: rows of one key are one request."""
    k = hashing.content_key(*(F.col(p) for p in _CACHE_PARTS))
    return table(spark, base, "vlm_responses").groupBy(k.alias("cache_key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("response_id").alias("n_responses"))


@CORE.add("cache_hits", f"""WITH r AS (SELECT {_CACHE_KEY} AS k, coalesce(is_synthetic, false) AS s, caption FROM vlm_responses), c AS (SELECT DISTINCT k, s FROM r WHERE caption IS NOT NULL)
  SELECT r.s AS is_synthetic, count(*) AS n_requests, count(*) FILTER (c.k IS NOT NULL) AS n_hits FROM r LEFT JOIN c ON r.k = c.k AND r.s = c.s GROUP BY 1""")  # fmt: skip
def cache_hits(spark: SparkSession, base: str) -> DataFrame:
    """Requests that the stored answers can serve; an entry without answer is a miss."""
    r = table(spark, base, "vlm_responses").select(hashing.content_key(*(F.col(p) for p in _CACHE_PARTS)).alias("k"), F.coalesce("is_synthetic", F.lit(False)).alias("is_synthetic"), F.col("caption").alias("value"))
    return hashing.lookup(r.drop("value"), r, "k").groupBy("is_synthetic").agg(F.count(F.lit(1)).alias("n_requests"), F.count_if("hit").alias("n_hits"))


@CORE.add("manifest_splits", f"""SELECT coalesce(p.s, c.s) AS split_final, c.s AS split_own, count(*) AS n FROM (SELECT {_ID.format("image_id")} AS k, {_SPLIT.format("split")} AS s FROM m7_claims) c
  LEFT JOIN (SELECT {_IMG} AS k, min({_SPLIT.format("split")}) AS s FROM m7_image_manifest GROUP BY 1) p ON c.k = p.k GROUP BY 1, 2""")  # fmt: skip
def manifest_splits(spark: SparkSession, base: str) -> DataFrame:
    """The manifest's split overwrites the claim's."""
    c = table(spark, base, "m7_claims").select(norm_id("image_id").alias("image_id"), norm_split("split").alias("split_own"))
    m = table(spark, base, "m7_image_manifest").select(norm_id("image.image_id").alias("image_id"), norm_split("split").alias("split"))
    return datasets.with_parent_split(c, "image_id", "split_own", m, "image_id", "split").groupBy("split_final", "split_own").agg(F.count(F.lit(1)).alias("n"))


@CORE.add("evidence_fallback", f"""WITH t AS (SELECT {_ID.format("image_id")} AS i, {_CLM} AS c, {_ID.format("object_category")} AS o, evidence.detector_score AS v FROM m7_claims),
  r AS (SELECT {_ID.format("image_id")} AS i, {_CLM} AS c, {_ID.format("object_category")} AS o FROM m7_template_annotator_a), e AS (SELECT i, c, min(v) AS v FROM t WHERE v IS NOT NULL GROUP BY 1, 2), l AS (SELECT i, o, min(v) AS v FROM t WHERE v IS NOT NULL GROUP BY 1, 2)
  SELECT CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN l.v IS NOT NULL THEN 'loose' ELSE 'none' END AS found_by, count(*) AS n, round(avg(coalesce(e.v, l.v)), 6) AS mean_score FROM r LEFT JOIN e USING (i, c) LEFT JOIN l ON l.i = r.i AND l.o = r.o GROUP BY 1""")  # fmt: skip
def evidence_fallback(spark: SparkSession, base: str) -> DataFrame:
    """Evidence of every task: by image and claim, else by image and category."""
    key = [norm_id("image_id").alias("image_id"), norm_id("claim_id").alias("claim_id"), norm_id("object_category").alias("category")]
    t = table(spark, base, "m7_claims").select(*key, F.col("evidence.detector_score").alias("score"))
    d = datasets.with_fallback(table(spark, base, "m7_template_annotator_a").select(*key), ["image_id", "claim_id"], ["image_id", "category"], t, "score")
    return rounded(d.groupBy("found_by").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")))


@CORE.add("condition_scores", f"""WITH s AS (SELECT {_ID.format("image_id")} AS i, {_ID.format("object_category")} AS o, CASE WHEN is_synthetic THEN 'synthetic' ELSE 'clean' END AS cond, min(evidence.detector_score) AS v FROM m7_claims WHERE evidence.detector_score IS NOT NULL AND NOT isnan(evidence.detector_score) AND is_synthetic IS NOT NULL GROUP BY 1, 2, 3)
  SELECT i AS image_id, o AS category, max(v) FILTER (cond = 'clean') AS clean, max(v) FILTER (cond = 'synthetic') AS synthetic FROM s WHERE i IS NOT NULL AND o IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (cond = 'clean') > 0""")  # fmt: skip
def condition_scores(spark: SparkSession, base: str) -> DataFrame:
    """Scores by condition in one map per (image, category), only where the clean one is there."""
    s = table(spark, base, "m7_claims").where("is_synthetic is not null").select(norm_id("image_id").alias("image_id"), norm_id("object_category").alias("category"), F.when(F.col("is_synthetic"), "synthetic").otherwise("clean").alias("condition"), F.col("evidence.detector_score").alias("score"))
    keys = s.select("image_id", "category").where("image_id is not null and category is not null").distinct()
    d = datasets.with_conditions(keys, ["image_id", "category"], s, "condition", "score")
    return d.select("image_id", "category", F.col("scores")["clean"].alias("clean"), F.try_element_at("scores", F.lit("synthetic")).alias("synthetic"))


_TRUTH = _LAST + f""", c AS (SELECT {_CLM} AS item, min({_ID.format("image_id")}) AS i, min({_ID.format("object_category")}) AS o FROM m7_claims WHERE {_CLM} IS NOT NULL GROUP BY 1),
  s AS (SELECT i, list_distinct(list(o) FILTER (label = 'supported')) AS truth, list_distinct(list(o) FILTER (label = 'hallucinated')) AS wrong FROM l JOIN c USING (item) WHERE i IS NOT NULL GROUP BY 1)"""


@CORE.add("labels_by_sets", _TRUTH + """ SELECT CASE WHEN list_contains(truth, o) THEN 0 WHEN list_contains(wrong, o) THEN 1 ELSE -1 END AS label, count(*) AS n FROM c JOIN s USING (i) GROUP BY 1""")
def labels_by_sets(spark: SparkSession, base: str) -> DataFrame:
    """Claims labelled by the sets of true and of hallucinated objects of their image."""
    l = audits.latest(table(spark, base, "annotation_records"), {"item": norm_id("claim_id"), "annotator": norm_tag("annotator_id")}, norm_label("ground_truth_status"), F.col("labelled_at"))
    c = table(spark, base, "m7_claims").select(norm_id("claim_id").alias("item"), norm_id("image_id").alias("image_id"), norm_id("object_category").alias("o")).where("item is not null").groupBy("item").agg(F.min("image_id").alias("image_id"), F.min("o").alias("o"))
    s = l.join(c, "item").where("image_id is not null").groupBy("image_id").agg(*(F.collect_set(F.when(F.col("label") == k, F.col("o"))).alias(n) for k, n in (("supported", "truth"), ("hallucinated", "wrong"))))  # categories of one image
    return c.join(s, "image_id").groupBy(F.coalesce(datasets.label_by_sets(F.col("o"), F.col("truth"), F.col("wrong")), F.lit(-1)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@CORE.add("final_labels", _LAST + f""", c AS (SELECT DISTINCT {_CLM} AS item FROM m7_claims WHERE {_CLM} IS NOT NULL) SELECT final, disagree, count(*) AS n FROM (SELECT c.item, a.label <> b.label AND a.label IS NOT NULL AND b.label IS NOT NULL AS x, coalesce(a.label <> b.label, false) AS disagree,
  CASE WHEN a.label = b.label THEN a.label WHEN a.label IS NOT NULL AND b.label IS NOT NULL THEN d.decision END AS final FROM c LEFT JOIN l a ON a.item = c.item AND a.annotator = 'A' LEFT JOIN l b ON b.item = c.item AND b.annotator = 'B' LEFT JOIN d ON d.item = c.item) GROUP BY 1, 2""")  # fmt: skip
def final_labels(spark: SparkSession, base: str) -> DataFrame:
    """Claims with the labels of annotators A and B and the decision."""
    l = audits.latest(table(spark, base, "annotation_records"), {"item": norm_id("claim_id"), "annotator": norm_tag("annotator_id")}, norm_label("ground_truth_status"), F.col("labelled_at"))
    d = audits.latest(table(spark, base, "adjudication_records"), {"item": norm_id("claim_id")}, norm_label("adjudicated_status"), F.col("adjudicated_at"))
    c = table(spark, base, "m7_claims").select(norm_id("claim_id").alias("item")).where("item is not null").distinct()
    pick = lambda t: l.where(F.col("annotator") == t).select("item", "label")
    return datasets.final_labels(c, ["item"], pick("A"), pick("B"), d).groupBy("final", F.coalesce("disagree", F.lit(False)).alias("disagree")).agg(F.count(F.lit(1)).alias("n"))


@CORE.add("task_loads", f"SELECT {_TAG.format('metadata.annotator_tag')} AS annotator, count(DISTINCT {_CLM}) AS n_claims, count(DISTINCT {_ID.format('image_id')}) AS n_images FROM m7_template_annotator_a GROUP BY 1")
def task_loads(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "m7_template_annotator_a")
    return t.groupBy(norm_tag("metadata.annotator_tag").alias("annotator")).agg(F.countDistinct(norm_id("claim_id")).alias("n_claims"), F.countDistinct(norm_id("image_id")).alias("n_images"))


@CORE.add("manifest_errors", f"""WITH i AS (SELECT {_IMG} AS image_id FROM m7_image_manifest), c AS (SELECT {_CLM} AS claim_id, {_ID.format("image_id")} AS image_id FROM m7_claims), l AS (SELECT {_CLM} AS claim_id FROM annotation_records)
  SELECT error, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT 'repeated_image' AS error, image_id AS key, count(*) AS n FROM i WHERE image_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'repeated_claim', claim_id, count(*) FROM c WHERE claim_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'image_without_id', NULL, count(*) FROM i WHERE image_id IS NULL HAVING count(*) > 0 UNION ALL SELECT 'claim_without_id', NULL, count(*) FROM c WHERE claim_id IS NULL HAVING count(*) > 0
  UNION ALL SELECT 'unknown_image', image_id, count(*) FROM c WHERE image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM i WHERE image_id IS NOT NULL) GROUP BY 2
  UNION ALL SELECT 'unknown_claim', claim_id, count(*) FROM l WHERE claim_id IS NOT NULL AND claim_id NOT IN (SELECT claim_id FROM c WHERE claim_id IS NOT NULL) GROUP BY 2) GROUP BY 1""")  # fmt: skip
def manifest_errors(spark: SparkSession, base: str) -> DataFrame:
    """All errors of the manifest, its claims and their labels."""
    i = table(spark, base, "m7_image_manifest").select(norm_id("image.image_id").alias("image_id"))
    c = table(spark, base, "m7_claims").select(norm_id("claim_id").alias("claim_id"), norm_id("image_id").alias("image_id"))
    e = datasets.manifest_errors(i, c, table(spark, base, "annotation_records").select(norm_id("claim_id").alias("claim_id")))
    return e.groupBy("error").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))


@CORE.add("readiness", f"""SELECT "check", n_rows, n_failed, n_failed = 0 AND n_rows > 0 AS passed FROM (SELECT count(*) AS n_rows, count(*) FILTER ({_CLM} IS NULL) AS a, count(*) FILTER ({_ID.format("image_id")} IS NULL) AS b, count(*) FILTER (NOT coalesce({_SPLIT.format("split")} IS NOT NULL, false)) AS c, count(*) FILTER (coalesce(is_synthetic, true)) AS d FROM m7_claims)
  UNPIVOT (n_failed FOR "check" IN (a AS has_claim_id, b AS has_image_id, c AS has_split, d AS is_real))""")  # fmt: skip
def readiness(spark: SparkSession, base: str) -> DataFrame:
    """Checks that every claim must pass before the data are locked."""
    checks = [("has_claim_id", norm_id("claim_id").isNotNull()), ("has_image_id", norm_id("image_id").isNotNull()), ("has_split", norm_split("split").isNotNull()), ("is_real", ~F.col("is_synthetic"))]
    return datasets.readiness(table(spark, base, "m7_claims"), checks)


@CORE.add("event_transitions", """SELECT from_state, to_state, count(*) AS n FROM (SELECT coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type), 'new') AS from_state, event_type AS to_state FROM events)
  WHERE NOT (from_state = 'new' AND to_state = 'signup' OR from_state = 'signup' AND to_state IN ('view', 'click') OR from_state = 'view' AND to_state IN ('view', 'click', 'purchase') OR from_state = 'click' AND to_state IN ('view', 'purchase', 'error')) GROUP BY 1, 2""")  # fmt: skip
def event_transitions(spark: SparkSession, base: str) -> DataFrame:
    """Steps of a log of states that a table of transitions does not allow."""
    allowed = {"new": ["signup"], "signup": ["view", "click"], "view": ["view", "click", "purchase"], "click": ["view", "purchase", "error"]}
    return datasets.bad_transitions(table(spark, base, "events"), "user_id", "event_type", "ts", allowed, "new").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


@CORE.add("evaluable_splits", f"""SELECT split, CASE WHEN i >= 100 AND c >= 300 THEN 'evaluable' WHEN i < 100 THEN 'too_few_images' ELSE 'too_few_claims' END AS verdict FROM (SELECT {_SPLIT.format("split")} AS split, count(DISTINCT {_ID.format("image_id")}) AS i, count(DISTINCT {_CLM}) AS c FROM m7_claims GROUP BY 1) WHERE split IS NOT NULL""")
def evaluable_splits(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "m7_claims").groupBy(norm_split("split").alias("split")).agg(F.countDistinct(norm_id("image_id")).alias("i"), F.countDistinct(norm_id("claim_id")).alias("c")).where("split is not null")
    return g.select("split", datasets.evaluable(F.col("i"), F.col("c")).alias("verdict"))


@CORE.add("identity_groups", f"""WITH d AS (SELECT DISTINCT {_IMG} AS id, lower(trim(image.dataset_source)) AS h FROM m7_image_manifest WHERE {_IMG} IS NOT NULL), h AS (SELECT h, min(id) AS g FROM d WHERE h IS NOT NULL GROUP BY 1)
  SELECT id, least(id, coalesce(min(g), id)) AS "group" FROM d LEFT JOIN h USING (h) GROUP BY id""")  # fmt: skip
def identity_groups(spark: SparkSession, base: str) -> DataFrame:
    """Direct groups by one shared value, here the source: a key that very many rows share."""
    m = table(spark, base, "m7_image_manifest").select(norm_id("image.image_id").alias("id"), F.lower(F.trim("image.dataset_source")).alias("h"))
    return datasets.identity_groups(m, "id", "h")
