"""Queries that draw claims from the captions of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions import vocabulary as V
from verispan.functions.keys import norm_id
from verispan.operators import claim_text
from verispan.plans.claims import rounded
from verispan.plans.reference_queries import _ID
from verispan.plans.registry import CORE
from verispan.session import table


def _names(spark: SparkSession, base: str) -> list[str]:
    return claim_text.vocabulary_names(table(spark, base, "category_vocab"))


def _mentions(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "vlm_responses").where("response_id is not null").dropDuplicates(["response_id", "caption"])
    return claim_text.mentions(r, F.col("response_id"), norm_id("image_id"), F.col("caption"), _names(spark, base))


@CORE.add("caption_mentions")
def caption_mentions(spark: SparkSession, base: str) -> DataFrame:
    """Every mention of a category in the answers, accepted or with its reason."""
    return _mentions(spark, base).drop("sentence")


@CORE.add("mention_outcomes")
def mention_outcomes(spark: SparkSession, base: str) -> DataFrame:
    return claim_text.rejected(_mentions(spark, base))


@CORE.add("extracted_claims")
def extracted_claims(spark: SparkSession, base: str) -> DataFrame:
    return claim_text.extract_claims(_mentions(spark, base)).drop("spans")


@CORE.add("category_phrases", """WITH v AS (SELECT DISTINCT lower(trim(category_name)) AS c FROM category_vocab WHERE trim(category_name) <> ''), p AS (
  SELECT c, c AS phrase FROM v UNION ALL SELECT c, CASE WHEN regexp_matches(c, '(s|x|z|ch|sh)$') THEN c || 'es' WHEN regexp_matches(c, '[^aeiou]y$') THEN left(c, length(c) - 1) || 'ies' ELSE c || 's' END FROM v WHERE c NOT IN ('skis', 'scissors', 'sheep', 'broccoli'))
  SELECT phrase, c AS category FROM p""")  # fmt: skip
def category_phrases(spark: SparkSession, base: str) -> DataFrame:
    """Names and regular plurals of the vocabulary; the irregular ones are fixed values."""
    irregular = {**V.IRREGULAR_ALIASES, **V.SYNONYM_ALIASES}
    rows = [(p, c) for p, c in V.phrases(_names(spark, base)).items() if irregular.get(p) != c or p == c]
    return spark.createDataFrame(rows, "phrase string, category string")


_ALIASES = """SELECT c AS phrase, c AS category FROM (SELECT DISTINCT lower(trim(category_name)) AS c FROM category_vocab) WHERE regexp_full_match(c, '[a-z]+')"""


@CORE.add("caption_categories", f"""SELECT category, count(DISTINCT response_id) AS n_texts FROM (SELECT response_id, unnest(list_distinct(regexp_extract_all(lower(caption), '[a-z]+'))) AS phrase FROM vlm_responses WHERE response_id IS NOT NULL)
  JOIN ({_ALIASES}) USING (phrase) GROUP BY 1""")  # fmt: skip
def caption_categories(spark: SparkSession, base: str) -> DataFrame:
    """Answers that name a category in one word, in the JVM alone."""
    a = spark.createDataFrame([(n, n) for n in _names(spark, base) if n.isascii() and n.isalpha()], "phrase string, category string")
    return claim_text.word_categories(table(spark, base, "vlm_responses").where("response_id is not null"), F.col("response_id"), F.col("caption"), F.broadcast(a))  # the vocabulary, bounded by vocabulary_names


@CORE.add("caption_sentences", """SELECT response_id, CAST(max(len(list_filter(regexp_extract_all(caption, '[^.!?]+[.!?]*'), lambda s: regexp_matches(s, '\\S')))) AS INT) AS n_sentences FROM vlm_responses WHERE caption IS NOT NULL AND response_id IS NOT NULL GROUP BY 1""")
def caption_sentences(spark: SparkSession, base: str) -> DataFrame:
    """Sentences of every answer, in the JVM."""
    s = F.filter(F.regexp_extract_all("caption", F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda x: x.rlike(r"\S"))
    return table(spark, base, "vlm_responses").where("caption is not null and response_id is not null").groupBy("response_id").agg(F.max(F.size(s)).alias("n_sentences"))


@CORE.add("caption_hallucination")
def caption_hallucination(spark: SparkSession, base: str) -> DataFrame:
    """Objects named in answers against those the claims of the image name: shares of mentions and captions."""
    lines = [",".join([n, *(p for p, c in V.phrases([n]).items() if p != n)]) for n in _names(spark, base)]
    w = claim_text.object_words(table(spark, base, "vlm_responses"), norm_id("image_id"), F.col("caption"), lines)
    there = table(spark, base, "m7_claims").select(norm_id("image_id").alias("image_id"), F.lower(F.trim("object_category")).alias("node"))
    return rounded(claim_text.chair(claim_text.hallucinated_objects(w, claim_text.present_objects(there))))


@CORE.add("masked_tasks", f"""SELECT md5(c || '|B') AS task_id, c AS claim_id, 'B' AS annotator_tag FROM (SELECT DISTINCT {_ID.format("claim_id")} AS c FROM m7_claims) WHERE c IS NOT NULL""")
def masked_tasks(spark: SparkSession, base: str) -> DataFrame:
    """Tasks for one more annotator; contexts are shown by annotation_contexts."""
    c = table(spark, base, "m7_claims")
    t = claim_text.masked_tasks(c, norm_id("claim_id"), norm_id("image_id"), F.col("object_category"), F.col("text_span"), F.col("caption"), "B")
    return t.select("task_id", "claim_id", "annotator_tag")


@CORE.add("annotation_contexts")
def annotation_contexts(spark: SparkSession, base: str) -> DataFrame:
    """Lengths of the contexts that annotators get, at most fifteen words unless one sentence holds the form without matching its words."""
    c = table(spark, base, "m7_claims")
    t = claim_text.masked_tasks(c, norm_id("claim_id"), norm_id("image_id"), F.col("object_category"), F.col("text_span"), F.col("caption"), "B")
    return t.groupBy(F.size(F.split(F.trim("minimal_context"), r"\s+")).alias("n_words")).agg(F.count(F.lit(1)).alias("n_tasks"))
