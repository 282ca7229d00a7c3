"""Claims from captions: mentions with their rules, claims per response, object words, hallucination shares, contexts for annotators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.functions import vocabulary as V

MENTIONS = "response_id string, image_id string, start int, end int, surface string, sentence_no int, sentence string, category string, reason string"


def vocabulary_names(vocab: DataFrame, column: str = "category_name", most: int = 100_000) -> list[str]:
    """The category names; a vocabulary of more than ``most`` rows is refused, since it is shipped to every task."""
    rows = vocab.select(F.lower(F.trim(column)).alias("n")).where("n is not null and n != ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} categories")
    return sorted(r.n for r in rows)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)


def mentions(texts: DataFrame, response: Column, image: Column, text: Column, names: Sequence[str]) -> DataFrame:
    """One row per mention of a category, columns as in MENTIONS; reason is null where the mention claims the object is there.

    Longer phrases win over those inside them. Null and empty texts give no row,
    repeated rows repeat theirs. Texts are read whole.
    """
    table = V.phrases(names)
    cols, kinds = [c.split()[0] for c in MENTIONS.split(", ")], [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = V.MentionRules(table)
        for b in batches:
            yield _table([(r, i, *m) for r, i, t in zip(*(c.to_pylist() for c in b.columns)) for m in rules(t)], cols, kinds)

    d = texts.select(response.cast("string").alias("response_id"), image.cast("string").alias("image_id"), text.alias("text")).where("text is not null and text != ''")
    return d.mapInArrow(run, MENTIONS)


def extract_claims(found: DataFrame) -> DataFrame:
    """One claim per response and category of the accepted mentions: claim_id, ids, category, first surface form, spans, number of spans."""
    own = F.struct("start", "end", "surface")
    g = found.where("reason is null").groupBy("response_id", "image_id", "category").agg(F.array_sort(F.collect_set(own)).alias("spans"))  # of one text
    return g.select(F.concat_ws("_", F.lit("claim"), "response_id", "category").alias("claim_id"), "image_id", "response_id", F.col("category").alias("object_category"), F.col("spans")[0]["surface"].alias("surface_form"), "spans", F.size("spans").alias("n_spans"))


def rejected(found: DataFrame) -> DataFrame:
    """Mentions per reason."""
    return found.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("response_id").alias("n_responses"))


def object_words(texts: DataFrame, image: Column, text: Column, lines: Sequence[str]) -> DataFrame:
    """image_id, node, n_mentions, first position and the surface words: one row per image and object word of its captions."""
    shipped = list(lines)
    cols, kinds = ["image_id", "surface", "node", "start", "end"], [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = V.ObjectWords(shipped)
        for b in batches:
            yield _table([(i, *m) for i, t in zip(*(c.to_pylist() for c in b.columns)) for m in words.mentions(t)], cols, kinds)

    d = texts.select(image.cast("string").alias("image_id"), text.alias("text")).where("image_id is not null and text is not null")
    m = d.mapInArrow(run, "image_id string, surface string, node string, start int, end int")
    return m.groupBy("image_id", "node").agg(F.count(F.lit(1)).alias("n_mentions"), F.min("start").alias("first_char"), F.array_sort(F.collect_set("surface")).alias("surfaces"))


def present_objects(*sources: DataFrame) -> DataFrame:
    """(image_id, node): the union of what several sources say is there."""
    out = sources[0].select("image_id", "node")
    for s in sources[1:]:
        out = out.unionByName(s.select("image_id", "node"))
    return out.where("image_id is not null and node is not null").distinct()


def hallucinated_objects(words: DataFrame, present: DataFrame) -> DataFrame:
    """words with ``hallucinated``: the object word is not among those present in its image."""
    return words.join(present.select("image_id", "node", F.lit(False).alias("_there")), ["image_id", "node"], "left").withColumn("hallucinated", F.coalesce("_there", F.lit(True))).drop("_there")


def chair(judged: DataFrame) -> DataFrame:
    """Share of mentions that are hallucinated, and of captions with any; null without mentions."""
    per = judged.groupBy("image_id").agg(F.sum("n_mentions").alias("_m"), F.sum(F.when(F.col("hallucinated"), F.col("n_mentions")).otherwise(0)).alias("_h"))
    return per.agg(F.count(F.lit(1)).alias("n_captions"), F.coalesce(F.sum("_m"), F.lit(0)).alias("n_mentions"), F.try_divide(F.sum("_h"), F.sum("_m")).alias("chair_i"), F.avg((F.col("_h") > 0).cast("double")).alias("chair_s"))


def word_categories(texts: DataFrame, key: Column, text: Column, aliases: DataFrame) -> DataFrame:
    """(category, n_texts): texts whose words name a category by a one-word alias. aliases (phrase, category) is a short table."""
    words = texts.select(key.alias("_key"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))).alias("phrase"))
    return words.join(aliases, "phrase").select("category", "_key").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("n_texts"))


#: What an annotator must not see.
FORBIDDEN = frozenset((
    "detector_score", "detector_available", "detector_model", "detector_revision", "detector_configuration", "clip_score", "similarity_available", "clip_model", "clip_revision",
    "clip_prompt_template", "preprocessing_configuration", "posterior", "prediction", "uncertainty", "ground_truth_status", "label", "split", "adjudicated_status", "vlm_generation_source",
    "evidence", "lower_bound", "upper_bound",
))
#: The fields of a masked task.
TASK_FIELDS = ("task_id", "claim_id", "image_id", "object_category", "surface_form", "minimal_context", "annotator_tag")


def masked_tasks(claims: DataFrame, claim: Column, image: Column, category: Column, surface: Column, caption: Column, tag: str) -> DataFrame:
    """One task per claim with the allowed fields only: ids, category, surface form and a short context. Claims without id give none."""

    @F.pandas_udf("string")
    def context(c, s):
        import pandas as pd

        return pd.Series([V.minimal_context(a, b) for a, b in zip(c, s)], dtype=object)

    d = claims.select(claim.alias("claim_id"), image.alias("image_id"), category.alias("object_category"), surface.alias("surface_form"), caption.alias("_caption")).where("claim_id is not null").dropDuplicates(["claim_id"])
    d = d.select(F.md5(F.concat_ws("|", "claim_id", F.lit(tag))).alias("task_id"), "claim_id", "image_id", "object_category", "surface_form", context(F.col("_caption"), F.coalesce("surface_form", "object_category")).alias("minimal_context"), F.lit(tag).alias("annotator_tag"))
    assert_masked(d)
    return d


def assert_masked(tasks: DataFrame) -> None:
    """Refuse a table of tasks that has a forbidden field, also inside a struct."""

    def names(t) -> set[str]:
        fields = getattr(t, "fields", [])
        inner = getattr(t, "elementType", None)
        return {f.name.lower() for f in fields}.union(*(names(f.dataType) for f in fields), names(inner) if inner is not None else set())

    bad = names(tasks.schema) & FORBIDDEN
    if bad:
        raise ValueError(f"tasks must not hold {sorted(bad)}")
