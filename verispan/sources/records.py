"""Readers of manifests, evidence, labels, benchmarks and study outputs, and the writers that go with them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions import scalar as S
from verispan.functions.keys import norm_id, norm_label
from verispan.operators.datasets import last_wins, unique_or_fail
from verispan.sources.files import coco_id_of, read_jsonl

IMAGE = "struct<image_id: string, dataset_source: string, file_name: string, file_hash: string, width: int, height: int, coco_id: bigint>"
MANIFEST = f"manifest_id string, schema_version string, description string, entries array<struct<image: {IMAGE}, split: string>>"
EVIDENCE = "claim_id string, image_id string, object_category string, caption string, image_hash string, split string, detector_score double, detector_available boolean, clip_score double, similarity_available boolean, vlm_generation_source string, is_synthetic boolean"
LABEL = "claim_id string, image_id string, annotator_id string, ground_truth_status string, rationale string, timestamp string"
DECISION = "claim_id string, image_id string, adjudicator_id string, adjudicated_status string, notes string, timestamp string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of a manifest document: manifest_id, image, split. A malformed document is an error."""
    d = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return d.select("manifest_id", "schema_version", F.explode("entries").alias("e")).select("manifest_id", "schema_version", "e.image", "e.split")


def write_manifest(entries: DataFrame, path: str, manifest_id: str, description: str = "") -> None:
    """Entries (image, split) as one manifest document. A manifest is one file by its format, so its entries are gathered: it is for lists of images, not for claims."""
    one = entries.agg(F.sort_array(F.collect_list(F.struct("image", "split"))).alias("entries"))
    one.select(F.lit(manifest_id).alias("manifest_id"), F.lit("1").alias("schema_version"), F.lit(description).alias("description"), "entries").coalesce(1).write.mode("overwrite").json(path)


def read_evidence(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Evidence rows; strict makes a row that breaks the contract an error naming the claim."""
    d = read_jsonl(spark, path, EVIDENCE)
    if not strict:
        return d
    c = F.col
    # the check rides on the rows themselves: a broken one raises when it is read
    rules = F.when(c("claim_id").isNull() | (F.trim("claim_id") == ""), "empty_key").when(c("detector_score").isNotNull() != F.coalesce("detector_available", F.lit(False)), "detector_availability").when(
        c("clip_score").isNotNull() != F.coalesce("similarity_available", F.lit(False)), "similarity_availability").when(F.isnan("detector_score") | ~c("detector_score").between(0, 1), "detector_range").when(
        F.isnan("clip_score") | ~c("clip_score").between(-1, 1), "similarity_range")
    ok = F.when(rules.isNull(), True).otherwise(F.raise_error(F.concat(rules, F.lit(" in claim "), F.coalesce("claim_id", F.lit("null")))).cast("boolean"))
    return d.where(ok)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of one annotator; a label that is none of the three, or a second one for a claim, is an error."""
    d = read_jsonl(spark, path, LABEL).withColumn("status", norm_label("ground_truth_status"))
    ok = F.when(F.col("status").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no status: "), F.coalesce("ground_truth_status", F.lit("null")))).cast("boolean"))
    return unique_or_fail(d.where(ok), ["image_id", "claim_id"])


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Adjudications: the last line of a claim counts."""
    d = read_jsonl(spark, path, DECISION).withColumn("_line", F.monotonically_increasing_id())
    return last_wins(d, ["image_id", "claim_id"], F.col("_line")).drop("_line")


def ingest_evidence(evidence: DataFrame, manifest: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Evidence as claims whose split is their image's; an image that the manifest lacks is an error unless allowed, and then the claim keeps its own split."""
    from verispan.operators.datasets import with_parent_split

    m = manifest.select(norm_id("image.image_id").alias("_image"), F.col("split").alias("_split"))
    e = evidence.withColumn("image_id", norm_id("image_id"))
    return with_parent_split(e, "image_id", "split", m, "_image", "_split", strict=not allow_missing).drop("split").withColumnRenamed("split_final", "split")


def map_yes_no(rows: DataFrame) -> DataFrame:
    """Questions of presence as claims: question (string), answer, image -> claim_id, image_id, object_category, status, supported_task. Questions of attributes, numbers or relations are flagged, not dropped."""
    q = F.lower(F.trim("question"))
    named = F.regexp_extract(q, r"^(?:is|are) there (?:(?:an?|the|any)\s+)?(.+?)(?: (?:in|on) (?:the|this) (?:image|picture|photo))?\s*\?*$", 1)
    label = F.lower(F.trim("answer"))
    status = F.when(label == "yes", "supported").when(label == "no", "hallucinated").otherwise("unknown")
    ok = named != ""
    return rows.select(F.md5(F.concat_ws("|", "image", "question")).alias("claim_id"), coco_id_of(F.col("image")).alias("image_id"), F.when(ok, named).alias("object_category"), status.alias("status"), F.coalesce(ok, F.lit(False)).alias("supported_task"))


# Kinds of benchmark questions that ask whether an object is there, and those that ask something else.
PRESENCE_KINDS = ("existence", "discriminative-hallucination", "presence")
OTHER_KINDS = ("attribute", "discriminative-attribute", "relation", "discriminative-relation", "state", "number", "action")


def map_tasks(rows: DataFrame) -> DataFrame:
    """Benchmark rows (id, kind, image, object, truth) as claims: claim_id, image_id, object_category, status, mapped (supported, unsupported_kind, unknown_kind)."""
    kind, truth = F.lower(F.trim("kind")), F.lower(F.trim(F.col("truth").cast("string")))
    status = F.when(truth.isin("yes", "true", "1"), "supported").when(truth.isin("no", "false", "0"), "hallucinated").otherwise("unknown")
    how = F.when(kind.isin(*PRESENCE_KINDS), "supported").when(kind.isin(*OTHER_KINDS), "unsupported_kind").otherwise("unknown_kind")
    return rows.select(F.concat_ws("_", F.lit("task"), F.col("id").cast("string")).alias("claim_id"), coco_id_of(F.col("image")).alias("image_id"), F.lower(F.trim("object")).alias("object_category"), F.when(how == "supported", status).otherwise("unknown").alias("status"), how.alias("mapped"))


def generative_entries(rows: DataFrame) -> DataFrame:
    """Entries (id, type, truth, hallu) of the generative kind: id, truth, and the hallucinations that are not true as well; one row per id."""
    d = rows.where("type = 'generative'").groupBy("id").agg(F.first("truth").alias("truth"), F.first("hallu").alias("hallu"))
    return d.select("id", "truth", F.array_except("hallu", "truth").alias("hallu"))


def condition_logits(rows: DataFrame, feature: str, evidence: str = "evidence") -> DataFrame:
    """rows with ``logits``, the feature of each condition of a map of structs as a logit; null scores are left out."""
    some = F.map_filter(evidence, lambda k, v: v[feature].isNotNull() & ~F.isnan(v[feature]))
    return rows.withColumn("logits", F.transform_values(some, lambda k, v: S.logit(v[feature])))


def swap_rows(rows: DataFrame) -> DataFrame:
    """(image_id, category, detector, score) of nested claims (category, scores map)."""
    c = rows.select("image_id", F.explode("claims").alias("c"))
    return c.select("image_id", F.col("c.category").alias("category"), F.explode("c.scores").alias("detector", "score")).where("score is not null and not isnan(score)")


def overlapping(spans: Column, logprobs: Column, start: Column, end: Column) -> Column:
    """struct<mean, first, least> of the log-probabilities of tokens (spans: array of struct a, b) that overlap [start, end); null fields without any."""
    own = F.filter(F.arrays_zip(spans.alias("s"), logprobs.alias("p")), lambda x: (x["s"]["b"] > start) & (x["s"]["a"] < end))
    v = F.transform(own, lambda x: x["p"])
    return F.struct(F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v).cast("double")).alias("mean"), F.get(v, F.lit(0)).alias("first"), F.array_min(v).alias("least"))


def box_to_pixels(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box in shares of the padded square (centre, size) as whole pixels inside the picture."""
    side = F.greatest(width, height)
    clip = lambda x, top: F.least(F.greatest(x, F.lit(0)), top).cast("int")
    return F.struct(clip(F.floor((cx - w / 2) * side), width).alias("x0"), clip(F.floor((cy - h / 2) * side), height).alias("y0"), clip(F.ceil((cx + w / 2) * side), width).alias("x1"), clip(F.ceil((cy + h / 2) * side), height).alias("y1"))


def phrase_positions(tokens: Column, breaks: Column) -> Column:
    """Positions of tokens grouped by phrase: a token among ``breaks`` ends a phrase; empty phrases are left out."""
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("open"))
    step = lambda a, x: F.when(F.array_contains(breaks, x["t"]), F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), F.array().cast("array<int>").alias("open"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(x["i"])).alias("open")))
    indexed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.cast("int").alias("i")))
    return F.aggregate(indexed, start, step, lambda a: F.filter(F.concat(a["done"], F.array(a["open"])), lambda p: F.size(p) > 0))


def synthetic_claims(spark: SparkSession, n_images: int, per_image: int = 3, seed: str = "smoke") -> DataFrame:
    """A deterministic data set for smoke runs: claims with scores and labels from hashes, flagged synthetic."""
    d = spark.range(n_images).select(F.concat(F.lit("syn_"), F.col("id").cast("string")).alias("image_id"), F.explode(F.sequence(F.lit(1), F.lit(per_image))).alias("ordinal"))
    u = lambda k: S.uniform(F.col("image_id"), F.col("ordinal"), F.lit(f"{seed}-{k}"))
    return d.select("image_id", "ordinal", F.concat_ws("_", "image_id", "ordinal").alias("claim_id"), F.round(u("det"), 6).alias("det"), F.round(2 * u("sim") - 1, 6).alias("sim"), (u("y") < 0.3).cast("int").alias("y"), F.lit(True).alias("is_synthetic"))


def write_once(df: DataFrame, path: str) -> None:
    """Write parquet unless the folder is there: a finished stage is not run again."""
    df.write.mode("ignore").parquet(path)


def write_by(df: DataFrame, path: str, column: str) -> None:
    """JSON lines in one folder per value of a column, as for annotators."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A short table as Markdown; more than ``most`` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table for a report")
    show = lambda v: "N/A" if v is None or v != v else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def write_tables(tables: dict[str, DataFrame], folder: str, most: int = 1000) -> list[str]:
    """Each summary table as CSV, JSON and Markdown; the names of the files written."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    names = []
    for name, d in tables.items():
        rows = [r.asDict(recursive=True) for r in d.limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        quote = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"' if any(c in str(v) for c in ',"\n') else str(v)
        (out / f"{name}.csv").write_text("\n".join([",".join(d.columns), *(",".join(quote(r[c]) for c in d.columns) for r in rows)]) + "\n")
        (out / f"{name}.json").write_text(json.dumps(rows, default=str, indent=1))
        (out / f"{name}.md").write_text(markdown(d, most))
        names += [f"{name}.{e}" for e in ("csv", "json", "md")]
    return names


def report(title: str, sections: Sequence[tuple[str, DataFrame | str]]) -> str:
    """A Markdown report of texts and short tables; a report without labelled rows says so at its head when told by a section text."""
    return "\n".join([f"# {title}", ""] + [x for name, body in sections for x in (f"## {name}", "", body if isinstance(body, str) else markdown(body), "")])
