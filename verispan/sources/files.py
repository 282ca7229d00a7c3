"""Readers and writers of annotation files; all lazy, all with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COCO = (
    "images array<struct<id: bigint, file_name: string, width: int, height: int>>, categories array<struct<id: int, name: string, supercategory: string>>, annotations array<struct<image_id: bigint, category_id: int, bbox: array<double>>>"
)
YES_NO = "question_id bigint, image string, text string, label string, category string, variant string"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; strict fails on a malformed line, else such lines (a half-written last one) are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def coco_presence(spark: SparkSession, path: str) -> DataFrame:
    """image_id, width, height, category names present and boxes per image; an image without annotations has empty arrays. Absent means not annotated, no more."""
    d = spark.read.schema(COCO).option("multiLine", True).option("mode", "FAILFAST").json(path)
    im = d.select(F.explode("images").alias("i")).select("i.*").dropDuplicates(["id"])
    cat = d.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("name")).dropDuplicates(["category_id"])
    a = d.select(F.explode("annotations").alias("a")).select("a.*").join(cat, "category_id")
    g = a.groupBy("image_id").agg(F.array_sort(F.collect_set("name")).alias("present"), F.count(F.lit(1)).alias("n_boxes"))
    j = im.join(g, im.id == g.image_id, "left")
    return j.select(F.concat(F.lit("coco_"), F.col("id").cast("string")).alias("image_id"), "width", "height", F.coalesce("present", F.array().cast("array<string>")).alias("present"), F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))


def coco_id_of(ref: Column) -> Column:
    """coco_<number> from the digits at the end of a file name, without leading zeros; null without digits."""
    n = F.regexp_extract(ref, r"(\d+)(?:\.[A-Za-z0-9]+)?$", 1)
    return F.when(n != "", F.concat(F.lit("coco_"), n.cast("bigint").cast("string")))


def read_yes_no(spark: SparkSession, path: str) -> DataFrame:
    """Yes/no questions: claim id, image, object, status. A row without image, text or label is an error."""
    d = read_jsonl(spark, path, YES_NO)
    need = lambda c: F.when(F.col(c).isNull() | (F.trim(c) == ""), F.raise_error(F.lit(f"a question lacks {c}")).cast("string")).otherwise(F.col(c))
    label = F.lower(F.trim(need("label")))
    status = F.when(label == "yes", "supported").when(label == "no", "hallucinated").otherwise("unknown")
    named = F.lower(F.regexp_extract(need("text"), r"(?i)^(?:is|are) there (?:(?:an?|the|any)\s+)?(.+?) (?:in|on) (?:the|this) (?:image|picture|photo)\b", 1))
    kind = F.coalesce("variant", *(F.when(F.input_file_name().contains(v), F.lit(v)) for v in ("adversarial", "popular", "random")))
    return d.select("question_id", coco_id_of(need("image")).alias("image_id"), F.coalesce("category", F.when(named != "", named)).alias("object_category"), status.alias("status"), kind.alias("variant"))


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose keys are not in the folder yet: running a stage again adds nothing."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        df = df.join(spark.read.schema(df.schema).json(path).select(*keys).distinct(), list(keys), "left_anti").select(*df.columns)
    df.write.mode("append").json(path)
