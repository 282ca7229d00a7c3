"""Orphan references: keys that point to rows missing, deleted or late.

Parent and child keys are tagged and united in long form and grouped once per
(parent table, key). The grouping only keeps sums, minima and flags, so a key
that holds a third of all rows is combined on the map side and never gathered.
The groups that lack a live, early parent - few - are joined back to the child
keys; a hot orphan key is split there by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """child.ref should hold a key of parent. Columns are expressions on the frames.

    child_key may be null (such rows count in the report only); parent_deleted
    is a boolean; the two times decide lateness.
    """

    child_table: str
    parent_table: str
    child: DataFrame
    child_key: Column
    child_ref: Column
    child_time: Column
    parent: DataFrame
    parent_key: Column
    parent_time: Column
    parent_deleted: Column | None = None


def _children(refs: Sequence[Reference]) -> DataFrame:
    out = None
    for r in refs:
        x = r.child.select(
            F.lit(r.child_table).alias("_child_table"), F.lit(r.parent_table).alias("_parent_table"), r.child_key.alias("_child_key"), r.child_ref.alias("_key"), r.child_time.alias("_child_time")
        )
        out = x if out is None else out.unionByName(x)
    return out


def _parents(refs: Sequence[Reference]) -> DataFrame:
    out = None
    seen = set()
    for r in refs:
        if r.parent_table in seen:
            continue
        seen.add(r.parent_table)
        x = r.parent.select(
            F.lit(r.parent_table).alias("_parent_table"), r.parent_key.alias("_key"), r.parent_time.alias("_parent_time"), (r.parent_deleted if r.parent_deleted is not None else F.lit(False)).alias("_deleted")
        ).where(F.col("_key").isNotNull())
        out = x if out is None else out.unionByName(x)
    return out


def _suspects(links: DataFrame, refs: Sequence[Reference]) -> DataFrame:
    """Groups that may hold an orphan: no parent, all parents deleted, or a child before the parent."""
    child = links.select("_parent_table", "_key", F.col("_first_seen").alias("_child_time"), F.lit(None).cast("timestamp").alias("_parent_time"), F.lit(None).cast("boolean").alias("_deleted"), F.lit(0).alias("_is_parent"))
    parent = _parents(refs).select("_parent_table", "_key", F.lit(None).cast("timestamp").alias("_child_time"), "_parent_time", F.coalesce("_deleted", F.lit(False)).alias("_deleted"), F.lit(1).alias("_is_parent"))
    g = child.unionByName(parent).groupBy("_parent_table", "_key").agg(
        F.max("_is_parent").alias("_has_parent"),
        F.min(F.when(F.col("_is_parent") == 1, F.col("_deleted"))).alias("_all_deleted"),
        F.min("_parent_time").alias("_parent_time"),
        F.min("_child_time").alias("_child_time"),
        F.max(1 - F.col("_is_parent")).alias("_has_child"),
    )
    late = F.col("_parent_time") > F.col("_child_time")
    return g.where((F.col("_has_child") == 1) & ((F.col("_has_parent") == 0) | F.col("_all_deleted") | F.coalesce(late, F.lit(False)))).select("_parent_table", "_key", "_has_parent", "_all_deleted", "_parent_time")


def _kind() -> Column:
    return (
        F.when(F.col("_has_parent") == 0, F.lit("missing"))
        .when(F.col("_all_deleted"), F.lit("deleted"))
        .when(F.col("_parent_time") > F.col("_first_seen"), F.lit("late"))
    )


def orphan_references(refs: Sequence[Reference]) -> DataFrame:
    """One row per distinct child key whose reference does not hold.

    Columns: child_table, child_key, orphan_kind (missing, deleted, late). Rows
    with a null key or a null reference are left out. A child's time is the
    earliest over all its rows; of several references the worst kind counts, in
    the order given. Repeated rows count once; empty tables give no rows from
    them (an empty parent makes every reference missing). Null times are never late.
    """
    rows = _children(refs).where(F.col("_child_key").isNotNull())
    # first over a key's references, then the key's own earliest time: both combine on the map side
    per_ref = rows.groupBy("_child_table", "_parent_table", "_child_key", "_key").agg(F.min("_child_time").alias("_t"))
    keyed = (
        per_ref.groupBy("_child_table", "_parent_table", "_child_key")
        .agg(F.min("_t").alias("_first_seen"), F.collect_set("_key").alias("_keys"))  # the distinct references of ONE child key
        .select("_child_table", "_parent_table", "_child_key", "_first_seen", F.explode("_keys").alias("_key"))
    )
    bad = _suspects(keyed, refs)
    hits = keyed.join(bad, ["_parent_table", "_key"]).withColumn("_kind", _kind()).where(F.col("_kind").isNotNull())
    rank = F.when(F.col("_kind") == "missing", 0).when(F.col("_kind") == "deleted", 1).otherwise(2)
    return (
        hits.groupBy("_child_table", "_child_key")
        .agg(F.min_by("_kind", rank).alias("orphan_kind"))
        .select(F.col("_child_table").alias("child_table"), F.col("_child_key").alias("child_key"), "orphan_kind")
    )


def orphan_report(refs: Sequence[Reference]) -> DataFrame:
    """Rows and failing references per child table and month of the child row.

    Columns: child_table, period, n_rows, n_null_ref, n_missing, n_deleted,
    n_late. Every row counts by its own time, repeated rows included; a row
    with a null time falls in the period ``none``. Lateness is judged per row.

    Child rows are counted per (key, period) on the map side before they meet the
    parents in one grouping by key, which keeps the counts of the few periods of
    a key: an orphan key with a third of all rows is a handful of counts there.
    Rows are looked at again only for the keys whose parent came after a child.
    """
    period = F.coalesce(F.date_format("_child_time", "yyyy-MM"), F.lit("none"))
    rows = _children(refs).select("_child_table", "_parent_table", "_key", period.alias("_period"), "_child_time")
    counted = rows.groupBy("_child_table", "_parent_table", "_key", "_period").agg(F.count(F.lit(1)).alias("_n"), F.min("_child_time").alias("_first"))
    table_period = (F.col("_child_table").alias("child_table"), F.col("_period").alias("period"))
    totals = counted.groupBy(*table_period).agg(F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), F.lit(0)).alias("n_null_ref"))
    child = counted.where(F.col("_key").isNotNull()).select("_parent_table", "_key", F.struct("_child_table", "_period", "_n").alias("_c"), "_first", F.lit(None).cast("timestamp").alias("_parent_time"), F.lit(None).cast("boolean").alias("_deleted"))
    parent = _parents(refs).groupBy("_parent_table", "_key").agg(F.min("_parent_time").alias("_parent_time"), F.bool_and(F.coalesce("_deleted", F.lit(False))).alias("_deleted"))
    parent = parent.select("_parent_table", "_key", F.lit(None).cast(child.schema["_c"].dataType).alias("_c"), F.lit(None).cast("timestamp").alias("_first"), "_parent_time", "_deleted")
    keyed = child.unionByName(parent).groupBy("_parent_table", "_key").agg(F.collect_list("_c").alias("_cs"), F.min("_first").alias("_first"), F.min("_parent_time").alias("_parent_time"), F.max("_deleted").alias("_deleted"))  # a count per period and child table of one key
    kind = F.when(F.col("_deleted").isNull(), "missing").when(F.col("_deleted"), "deleted").when(F.col("_parent_time") > F.col("_first"), "late")
    bad = keyed.where(F.size("_cs") > 0).withColumn("_kind", kind).where(F.col("_kind").isNotNull())
    gone = bad.where("_kind != 'late'").select("_kind", F.inline("_cs")).select("_child_table", "_period", "_kind", "_n")
    after = bad.where("_kind = 'late'").select("_parent_table", "_key", "_parent_time")
    late = rows.join(after, ["_parent_table", "_key"]).where(F.col("_parent_time") > F.col("_child_time")).groupBy("_child_table", "_period").agg(F.lit("late").alias("_kind"), F.count(F.lit(1)).alias("_n"))
    kinds = ("missing", "deleted", "late")
    counts = gone.unionByName(late).groupBy(*table_period).agg(*(F.sum(F.when(F.col("_kind") == k, F.col("_n"))).alias(f"n_{k}") for k in kinds))
    return totals.join(counts, ["child_table", "period"], "left").select(
        "child_table", "period", "n_rows", "n_null_ref", *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds)
    )
