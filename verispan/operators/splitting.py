"""Seeded splits, cohorts and shards with exact counts. Orders come from md5 of seed and id, so every engine repeats them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.operators.ordered import running


def seeded(seed: str, *parts: Column | str) -> Column:
    """The key of a seeded order: md5 of the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def ranked(ids: DataFrame, column: str, key: Column | None = None) -> DataFrame:
    """Distinct non-null ids with ``rank`` from 1 and ``total``, by the key or by the id itself; ranked over ranges, not in one task."""
    d = ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_key", key if key is not None else F.col(column))
    r = running(d, [F.col("_key"), F.col(column)], {"rank": F.lit(1)})
    return r.select(column, F.col("rank").cast("long").alias("rank"), F.col("rank_total").cast("long").alias("total"))


def _pick(rank: Column, bounds: Sequence[tuple[str, Column]]) -> Column:
    out = F.lit(bounds[-1][0])
    for name, upto in reversed(bounds[:-1]):
        out = F.when(rank <= upto, name).otherwise(out)
    return out


def sliced(ids: DataFrame, column: str, shares: Sequence[tuple[str, float]], seed: str | None = None) -> DataFrame:
    """(id, split): contiguous slices of the sorted ids, or of a seeded order; cut-offs are rounded running shares, the last split takes the rest."""
    r = ranked(ids, column, None if seed is None else seeded(seed, column))
    total, upto, bounds = sum(s for _, s in shares), 0.0, []
    for name, share in shares:
        upto += share / total
        bounds.append((name, F.round(F.col("total") * upto)))
    return r.select(column, _pick(F.col("rank"), bounds).alias("split"))


def counted(ids: DataFrame, column: str, counts: Sequence[tuple[str, int]], seed: str) -> DataFrame:
    """(id, split) with exactly the given numbers, in a seeded order; ids beyond their sum are left out, too few ids are an error."""
    r = ranked(ids, column, seeded(seed, column))
    most, upto, bounds = sum(n for _, n in counts), 0, []
    for name, n in counts:
        upto += n
        bounds.append((name, F.lit(upto)))
    enough = F.when(F.col("total") >= most, F.col("rank")).otherwise(F.raise_error(F.lit(f"fewer than {most} ids")).cast("long"))
    return r.where(enough <= most).select(column, _pick(F.col("rank"), bounds).alias("split"))


def grouped(rows: DataFrame, column: str, group: Column, shares: Sequence[tuple[str, float]], seed: str, reserved: DataFrame | None = None, forced: DataFrame | None = None, held: str = "test") -> DataFrame:
    """(id, group, split): whole groups in a seeded order; a group with a reserved id (column ``column``) goes to ``held``, one with a forced id (column, split) to its first forced split."""
    d = rows.select(column, group.alias("_group")).where(F.col(column).isNotNull() & F.col("_group").isNotNull()).distinct()
    special = None
    if reserved is not None:
        special = reserved.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_to", F.lit(held))
    if forced is not None:
        f = forced.select(column, F.col("split").alias("_to")).where("_to is not null")
        special = f if special is None else special.unionByName(f)
    free = d.select("_group").distinct()
    if special is not None:
        # a reserved id outweighs a forced one
        weight = F.struct(F.when(F.col("_to") == held, 0).otherwise(1).alias("o"), "_to")
        at = d.join(special, column).groupBy("_group").agg(F.min(weight)["_to"].alias("_to"))
        free = free.join(at, "_group", "left_anti")
    split = sliced(free, "_group", shares, seed).withColumnRenamed("split", "_own")
    out = d.join(split, "_group", "left")
    if special is not None:
        out = out.join(at, "_group", "left").withColumn("_own", F.coalesce("_to", "_own"))
    return out.select(column, F.col("_group").alias("group"), F.col("_own").alias("split"))


def cohort(ids: DataFrame, column: str, n: int, seed: str) -> DataFrame:
    """n ids of a seeded order (a sample by rank); all where there are fewer."""
    return ranked(ids, column, seeded(seed, column)).where(F.col("rank") <= n).select(column, "rank")


def preregistered(ids: DataFrame, column: str, sizes: Sequence[tuple[str, int]], pilot: int, pilot_cal: int, seed: str, train: str = "train") -> DataFrame:
    """(id, split, pilot): exact sizes, and the first ids of the train split as the pilot, in part for calibration (cal, eval, null)."""
    r = ranked(ids, column, seeded(seed, column))
    upto, bounds, start = 0, [], 0
    for name, n in sizes:
        if name == train:
            start = upto
        upto += n
        bounds.append((name, F.lit(upto)))
    at = F.col("rank") - start
    d = r.where(F.col("rank") <= upto).select(column, _pick(F.col("rank"), bounds).alias("split"), at.alias("_at"))
    return d.select(column, "split", F.when((F.col("split") == train) & (F.col("_at") <= pilot_cal), "cal").when((F.col("split") == train) & (F.col("_at") <= pilot), "eval").alias("pilot"))


def shards(ids: DataFrame, column: str, n: int) -> DataFrame:
    """(id, shard): every n-th id of the sorted ids."""
    return ranked(ids, column).select(column, F.pmod(F.col("rank") - 1, F.lit(n)).cast("int").alias("shard"))


def pick_one(items: Column, seed: str, key: Column) -> Column:
    """One element of an array, the same for the same seed and key; null for an empty array."""
    h = F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("long")
    return F.when(F.size(items) > 0, F.element_at(F.array_sort(items), (F.pmod(h, F.size(items)) + 1).cast("int")))


def condition_grid(ids: DataFrame, column: str, families: Sequence[str], severities: Sequence[str]) -> DataFrame:
    """Every id under every family and severity: a row each, spread without a join."""
    grid = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(s).alias("severity")) for f in families for s in severities)))
    return ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_g", grid).select(column, "_g.family", "_g.severity")


def binomial_half_width(n: Column, p: Column, z: float = 1.959963984540054) -> Column:
    """Half the width of the normal interval of a share; null without rows."""
    return F.when(n > 0, z * F.sqrt(p * (1 - p) / n))


def common_ids(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Ids that two sets share: none where they are apart."""
    return a.select(column).where(F.col(column).isNotNull()).intersect(b.select(column))


def split_alias(split: Column) -> Column:
    """train, validation, calibration or test by any spelling; train for anything else."""
    from verispan.functions.keys import norm_split

    return F.coalesce(norm_split(split), F.lit("train"))
