"""Queries of the operators in this folder; each runs over its whole tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions.keys import EMPTY_FILE_HASHES, SPLIT_SPELLINGS, norm_hash, norm_id, norm_label, norm_number_key, norm_split, norm_tag
from verispan.llm import components, consensus, leakage, lookalike, mixing, overlap, pairs
from verispan.plans.audit_queries import _LAST
from verispan.plans.reference_queries import _BLANKS, _ID
from verispan.plans.registry import Registry
from verispan.session import table

LLM = Registry()


def _form_sql() -> str:
    """SQL of the canonical form, from the operator's table of single characters."""
    gone, old, new = "", "", ""
    for k in [*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200), *range(1, 32), 127]:
        c = chr(k)
        x = lookalike.canonical(c)
        if x == c or unicodedata.normalize("NFC", c) != c:
            continue
        if not x:
            gone += c
        elif len(x) == 1:
            old, new = old + c, new + x
    return "', '".join(x.replace("'", "''") for x in (old + gone, new))


_TABLE = _form_sql()


def _form(text: str) -> str:
    return f"nfc_normalize(translate({text}, '{_TABLE}'))"


def _words(text: str) -> str:
    return f"regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*')"


_TRIM = "trim({0}, " + _BLANKS + ")"
_SPLIT = "CASE lower(" + _TRIM + ") " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPLIT_SPELLINGS.items()) + " END"
_BARE = "regexp_replace(lower(" + _TRIM + "), '^(?:(?:sha|md|blake|xxh)[a-z0-9_-]*[:=/-]|0x)\\s*', '')"
_HASH = f"CASE WHEN regexp_full_match({_BARE}, '[0-9a-f]{{{{8,}}}}') AND length(replace({_BARE}, {_BARE}[1:1], '')) > 0 AND {_BARE} NOT IN ({', '.join(repr(h) for h in EMPTY_FILE_HASHES)}) THEN {_BARE} END"


def _runs(key: str, text: str, name: str) -> str:
    return f"SELECT DISTINCT {key} AS id, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 11)) AS k FROM (SELECT {key}, {_words(_form(text))} AS w FROM {name} WHERE {text} IS NOT NULL))"


@LLM.add("p6_found", f"""SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM ({_runs("doc_id", "text", "documents")}) d JOIN ({_runs("item_id", "item_text", "eval_items")}) i USING (run)""")
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    hits = leakage.leaked_windows(spark, table(spark, base, "documents"), table(spark, base, "eval_items"))
    return leakage.leaked_items(hits)


@LLM.add("p6_report")
def p6_report(spark: SparkSession, base: str) -> DataFrame:
    items = table(spark, base, "eval_items")
    return leakage.leak_report(leakage.leaked_windows(spark, table(spark, base, "documents"), items), items)


_LOOKS = f"SELECT doc_id, text, {_form('text')} AS form FROM documents WHERE text IS NOT NULL AND text <> ''"


@LLM.add("p8_found", f"WITH f AS ({_LOOKS}) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text")
def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalike.same_look_pairs(table(spark, base, "documents"))


@LLM.add("p8_classes", f"WITH f AS ({_LOOKS}) SELECT doc_id, min(doc_id) OVER w AS class_id, n AS n_variants FROM f JOIN (SELECT form, count(DISTINCT text) AS n FROM f GROUP BY 1 HAVING count(DISTINCT text) > 1) USING (form) WINDOW w AS (PARTITION BY form)")
def p8_classes(spark: SparkSession, base: str) -> DataFrame:
    return lookalike.same_look_classes(table(spark, base, "documents"))


@LLM.add("p8_forms", f"SELECT doc_id, md5(form) AS canonical_key, form <> text AS changed, CAST(length(form) AS INT) AS canonical_length FROM ({_LOOKS})")
def p8_forms(spark: SparkSession, base: str) -> DataFrame:
    f = lookalike.canonical_text(table(spark, base, "documents"), keep_text=True).where("text is not null and text != ''")
    return f.select("doc_id", F.md5("canonical_text").alias("canonical_key"), (F.col("canonical_text") != F.col("text")).alias("changed"), F.length("canonical_text").alias("canonical_length"))


def _manifest_keys():
    return norm_id("image.image_id"), [("hash", norm_hash("image.file_hash")), ("coco", norm_number_key("image.coco_id"))]


_KEYS = f"""SELECT DISTINCT coalesce({_ID.format("image.image_id")}, chr(1114111) || coalesce('hash:' || {_HASH.format("image.file_hash")}, 'coco:' || CASE WHEN image.coco_id > 0 THEN image.coco_id END)) AS n,
  unnest(['hash:' || {_HASH.format("image.file_hash")}, 'coco:' || CASE WHEN image.coco_id > 0 THEN image.coco_id END]) AS k FROM m7_image_manifest"""


@LLM.add("p2_found", f"""WITH RECURSIVE e AS (SELECT n, k FROM ({_KEYS}) WHERE n IS NOT NULL AND k IS NOT NULL), adj AS (SELECT DISTINCT a.n AS x, b.n AS y FROM e a JOIN e b USING (k)),
  reach(x, y) AS (SELECT x, y FROM adj UNION SELECT r.x, a.y FROM reach r JOIN adj a ON r.y = a.x)
  SELECT min(y) AS image_id_a, x AS image_id_b FROM reach WHERE NOT starts_with(x, chr(1114111)) GROUP BY x HAVING min(y) <> x""")  # fmt: skip
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    g = components.related_groups(table(spark, base, "m7_image_manifest"), *_manifest_keys())
    g = g.where(~F.col("node").startswith(components.NO_ID) & (F.col("node") != F.col("component")))
    return g.select(F.col("component").alias("image_id_a"), F.col("node").alias("image_id_b"))


def _image_splits(spark: SparkSession, base: str) -> tuple[DataFrame, list]:
    shares = components.split_shares(table(spark, base, "split_targets"))
    return components.assign_splits(table(spark, base, "m7_image_manifest"), *_manifest_keys(), shares), shares


@LLM.add("p2_splits")
def p2_splits(spark: SparkSession, base: str) -> DataFrame:
    return _image_splits(spark, base)[0].withColumnRenamed("record_id", "image_id")


@LLM.add("p2_report")
def p2_report(spark: SparkSession, base: str) -> DataFrame:
    return components.split_report(*_image_splits(spark, base))


STATUSES = ("supported", "hallucinated", "unknown")


def _consensus(spark: SparkSession, base: str):
    a, j = table(spark, base, "annotation_records"), table(spark, base, "adjudication_records")
    labels = consensus.latest_labels(a, norm_id("claim_id"), norm_tag("annotator_id"), norm_label("ground_truth_status"), F.col("labelled_at"))
    decided = consensus.latest_labels(j, norm_id("claim_id"), F.lit("adjudication"), norm_label("adjudicated_status"), F.col("adjudicated_at"))
    return consensus.consensus_messages(labels, STATUSES, decided.select("item", F.col("label").alias("status")))


@LLM.add("p5_found")
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    items = _consensus(spark, base)[0]
    return items.where("n_labels >= 2").select(F.col("item").alias("claim_id"), F.col("consensus").alias("consensus_status"))


@LLM.add("p5_labels", _LAST + """ SELECT item AS claim_id, CAST(sum(n) AS BIGINT) AS n_labels, round(max(n) / sum(n), 6) AS majority_share, max(n) FILTER (v) / sum(n) IS NOT NULL AS agreed FROM (SELECT item, label, count(*) AS n, true AS v FROM l GROUP BY 1, 2) GROUP BY 1""")
def p5_labels(spark: SparkSession, base: str) -> DataFrame:
    """What SQL can tell of the items: labels, share of the most frequent one, and that the consensus is at most as frequent."""
    i = _consensus(spark, base)[0]
    return i.select(F.col("item").alias("claim_id"), "n_labels", F.round("majority_share", 6).alias("majority_share"), (F.col("agreement") <= F.col("majority_share")).alias("agreed"))


@LLM.add("p5_agreement")
def p5_agreement(spark: SparkSession, base: str) -> DataFrame:
    return _consensus(spark, base)[0].withColumnRenamed("item", "claim_id")


@LLM.add("p5_annotators")
def p5_annotators(spark: SparkSession, base: str) -> DataFrame:
    return _consensus(spark, base)[1]


def _mix(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, base, "documents"), mixing.mix_targets(table(spark, base, "mix_targets")), shard_tokens=200_000)


@LLM.add("p7_mix")
def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[0]


@LLM.add("p7_audit", """WITH t AS (SELECT translate(lower(trim(source)), '-', '_') AS source, sum(target_share) AS w FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 GROUP BY 1),
  d AS (SELECT translate(lower(trim(source)), '-', '_') AS source, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1)
  SELECT t.source, round(w / sum(w) OVER (), 6) AS target_share, coalesce(round(CASE WHEN n > 0 THEN w END / sum(w) FILTER (n > 0) OVER (), 6), 0) AS reachable_share, coalesce(n, 0) AS n_docs, true AS share_reached, true AS cap_kept, true AS copies_once
  FROM t LEFT JOIN d USING (source)""")  # fmt: skip
def p7_audit(spark: SparkSession, base: str) -> DataFrame:
    """Per source: targets, usable records, and whether the mix keeps what it promises: the share to one in a hundred, the cap, every copy of a record once."""
    mixed, report = _mix(spark, base)
    caps = spark.createDataFrame([(s, r) for s, _, r in mixing.mix_targets(table(spark, base, "mix_targets"))], "source string, cap long")
    once = mixed.groupBy("source", "doc_id", "copy").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("most"))
    d = report.join(caps, "source").join(once, "source", "left")
    return d.select("source", F.round("target_share", 6).alias("target_share"), F.round("reachable_share", 6).alias("reachable_share"), "n_docs", (F.abs(F.col("actual_share") - F.col("reachable_share")) <= 0.01).alias("share_reached"),
                    (F.col("most_uses") <= F.col("cap")).alias("cap_kept"), (F.coalesce("most", F.lit(1)) == 1).alias("copies_once"))


@LLM.add("p7_shares")
def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[1]


def _claim_overlaps(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    claims = table(spark, base, "m7_claims")
    return overlap.cross_split_links(claims, norm_id("image_id"), norm_split("split"), norm_hash("image_hash"), F.col("caption")), claims


_CLAIM_ROWS = f"""c AS (SELECT DISTINCT {_ID.format("image_id")} AS r, {_SPLIT.format("split")} = 'train' AS t, {_HASH.format("image_hash")} AS h, caption AS x FROM m7_claims WHERE {_ID.format("image_id")} IS NOT NULL AND {_SPLIT.format("split")} IS NOT NULL),
  w AS MATERIALIZED (SELECT x, list_distinct({_words("x")}) AS w FROM (SELECT DISTINCT x FROM c WHERE x IS NOT NULL)), e AS (SELECT * FROM w WHERE x IN (SELECT x FROM c WHERE NOT t)), b AS (SELECT * FROM w WHERE x IN (SELECT x FROM c WHERE t)),
  near AS (SELECT e.x AS ex, b.x AS bx FROM e JOIN b ON len(e.w) > 0 AND len(b.w) >= 0.75 * len(e.w) AND len(e.w) >= 0.75 * len(b.w) AND len(list_intersect(e.w, b.w)) * 1.75 >= 0.75 * (len(e.w) + len(b.w)) - 1e-9)"""


@LLM.add("p4_found", f"""WITH {_CLAIM_ROWS} SELECT DISTINCT least(a, z) AS image_id_a, greatest(a, z) AS image_id_b FROM (
  SELECT i.r AS a, j.r AS z FROM c i JOIN c j ON i.r = j.r WHERE NOT i.t AND j.t UNION SELECT i.r, j.r FROM c i JOIN c j ON i.h = j.h WHERE NOT i.t AND j.t
  UNION SELECT i.r, j.r FROM near JOIN c i ON i.x = ex AND NOT i.t JOIN c j ON j.x = bx AND j.t)""")  # fmt: skip
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return overlap.overlap_pairs(_claim_overlaps(spark, base)[0])


@LLM.add("p4_report", f"""WITH {_CLAIM_ROWS}, h AS (SELECT r, 'id' AS why, NULL AS k FROM c WHERE NOT t AND r IN (SELECT r FROM c WHERE t) UNION SELECT r, 'hash', NULL FROM c WHERE NOT t AND h IN (SELECT h FROM c WHERE t)
  UNION SELECT c.r, 'text', max(len(list_intersect(e.w, b.w)) / len(e.w)) FROM near JOIN e ON e.x = ex JOIN b ON b.x = bx JOIN c ON c.x = ex AND NOT c.t GROUP BY 1, 2), g AS (SELECT r, max(why = 'id') AS a, max(why = 'hash') AS b, max(why = 'text') AS d, max(k) AS k FROM h GROUP BY 1),
  s AS (SELECT DISTINCT {_ID.format("image_id")} AS r, {_SPLIT.format("split")} AS split, coalesce({_ID.format("metadata.dataset_source")}, 'none') AS dataset_source FROM m7_claims WHERE {_ID.format("image_id")} IS NOT NULL AND {_SPLIT.format("split")} <> 'train')
  SELECT split, dataset_source, count(*) AS n_records, count(g.r) AS n_overlapping, count(*) FILTER (a) AS n_by_id, count(*) FILTER (b) AS n_by_hash, count(*) FILTER (d) AS n_by_text, round(avg(k), 6) AS mean_containment FROM s LEFT JOIN g USING (r) GROUP BY 1, 2""")  # fmt: skip
def p4_report(spark: SparkSession, base: str) -> DataFrame:
    claims = table(spark, base, "m7_claims")
    r = overlap.overlap_report(claims, norm_id("image_id"), norm_split("split"), norm_hash("image_hash"), F.col("caption"), norm_id("metadata.dataset_source"))
    return r.withColumn("mean_containment", F.round("mean_containment", 6))


def _broken(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "vlm_responses")
    return pairs.broken_pairs(r, F.col("response_id"), F.col("prompt"), F.col("caption"), F.col("gen_config.max_new_tokens"))


@LLM.add("p1_found")
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return _broken(spark, base)


@LLM.add("p1_report")
def p1_report(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "vlm_responses").select("response_id", F.coalesce("model_name", F.lit("none")).alias("model_name")).where("response_id is not null").groupBy("response_id").agg(F.min("model_name").alias("model_name"))
    d = r.join(_broken(spark, base), "response_id", "left")
    return d.groupBy("model_name", F.coalesce("defect_type", F.lit("sound")).alias("defect_type")).agg(F.count(F.lit(1)).alias("n_responses"))
