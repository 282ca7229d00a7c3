"""Contracts and leakage audits. Each returns the rows that break a rule, or counts of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_violations(df: DataFrame, key: Column, det: Column, det_on: Column, sim: Column, sim_on: Column) -> DataFrame:
    """(key, violation): empty key, score without availability or the reverse, out of range, not finite, a zero that stands for a missing score."""
    bad = F.array_compact(
        F.array(
            F.when(key.isNull(), F.lit("empty_key")),
            F.when(det.isNotNull() != F.coalesce(det_on, F.lit(False)), F.lit("detector_availability")),
            F.when(sim.isNotNull() != F.coalesce(sim_on, F.lit(False)), F.lit("similarity_availability")),
            F.when(F.isnan(det) | (det < 0) | (det > 1), F.lit("detector_range")),
            F.when(F.isnan(sim) | (sim < -1) | (sim > 1), F.lit("similarity_range")),
            F.when((det == 0) & ~F.coalesce(det_on, F.lit(False)), F.lit("zero_substitution")),
        )
    )
    return df.select(key.alias("record_key"), F.explode(bad).alias("violation"))


def in_several(df: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    """Keys that have more than one distinct value: name, n_values, first and last value. Null keys and values do not count."""
    d = df.select(key.alias(name), value.alias("_v")).where(F.col(name).isNotNull() & F.col("_v").isNotNull()).distinct()
    return d.groupBy(name).agg(F.count(F.lit(1)).alias("n_values"), F.min("_v").alias("first_value"), F.max("_v").alias("last_value")).where("n_values > 1")


def disagreeing(child: DataFrame, key: Column, value: Column, parent: DataFrame, parent_key: Column, parent_value: Column) -> DataFrame:
    """(child_value, parent_value, n): rows whose value is not among those of their parent key's, with null for an unknown parent. parent_value is the first of the parent's values. The parent side is one row per key."""
    p = parent.select(parent_key.alias("_k"), parent_value.alias("_p")).where("_k is not null").groupBy("_k").agg(F.min("_p").alias("parent_value"), F.collect_set("_p").alias("_all"))  # the distinct values of one key
    c = child.select(key.alias("_k"), value.alias("child_value")).where("_k is not null").groupBy("_k", "child_value").agg(F.count(F.lit(1)).alias("_n"))
    j = c.join(p, "_k", "left").where(F.when(F.col("child_value").isNull(), F.col("parent_value").isNotNull()).otherwise(~F.coalesce(F.array_contains("_all", F.col("child_value")), F.lit(False))))
    return j.groupBy("child_value", "parent_value").agg(F.sum("_n").alias("n"))


def shared_keys(df: DataFrame, side: Column, key: Column) -> DataFrame:
    """(side_a, side_b, n_shared): keys that two sides have in common, for all pairs of sides; sides are few, keys are grouped once."""
    d = df.select(side.alias("_s"), key.alias("_k")).where("_s is not null and _k is not null").groupBy("_k").agg(F.array_sort(F.collect_set("_s")).alias("_a")).where("size(_a) > 1")
    a = d.select(F.posexplode("_a").alias("_i", "side_a"), "_a")
    b = a.select("side_a", F.explode(F.slice("_a", F.col("_i") + 2, F.size("_a"))).alias("side_b"))
    return b.groupBy("side_a", "side_b").agg(F.count(F.lit(1)).alias("n_shared"))


def duplicate_keys(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Number of keys that occur more than once, and of the rows beyond the first."""
    g = df.select(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra_rows"))


def adjudicated(labels: DataFrame, a: str, b: str, decisions: DataFrame) -> DataFrame:
    """Claims with the labels of two annotators: equal labels stand, else the decision, else null. No consensus is made up."""
    x = labels.groupBy("item").agg(F.max(F.when(F.col("annotator") == a, F.col("label"))).alias("label_a"), F.max(F.when(F.col("annotator") == b, F.col("label"))).alias("label_b")).where("label_a is not null and label_b is not null")
    d = decisions.select("item", F.col("label").alias("decision"))
    return x.join(d, "item", "left").select("item", "label_a", "label_b", F.when(F.col("label_a") == F.col("label_b"), F.col("label_a")).otherwise(F.col("decision")).alias("final_status"))


def latest(df: DataFrame, keys: dict[str, Column], value: Column, time: Column) -> DataFrame:
    """The latest non-null value per key; equal times are settled by the larger value."""
    d = df.select(*(c.alias(n) for n, c in keys.items()), value.alias("label"), time.alias("_t")).where("label is not null")
    for n in keys:
        d = d.where(F.col(n).isNotNull())
    return d.groupBy(*keys).agg(F.max_by("label", F.struct("_t", "label")).alias("label"))
