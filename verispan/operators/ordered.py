"""Running sums over a whole table's order, without a task that sees all of it.

The table is range-partitioned by the order, each part is summed on its own and
the totals of the parts before it are added; only one row per part is ordered
globally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verispan.session import cut


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """df with running sums (inclusive) of the given expressions in the given order, per keys where given.

    The order must be total for a defined result. Null values count as 0.
    Each name also gets ``<name>_total``, the sum over all rows (of the key).
    """
    d = df.select("*", *(F.coalesce(e.cast("double"), F.lit(0.0)).alias(f"_v_{n}") for n, e in sums.items()))
    keys = list(keys)
    parts = cut(d.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy("_part", *keys).agg(*(F.sum(f"_v_{n}").alias(n) for n in sums))
    # a row per part and key that has rows there, from here on: a key with very many rows lies in many parts, each its own task
    group = keys or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group)
    offsets = totals.select(F.col("_part").alias("_of_part"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"_o_{n}") for n in sums), *(F.sum(n).over(everything).alias(f"{n}_total") for n in sums))
    same = F.col("_part") == F.col("_of_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    j = parts.join(offsets if keys else F.broadcast(offsets), same)
    return j.select(*df.columns, *((F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in sums), *(f"{n}_total" for n in sums))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where neither is null; null where one of them is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def join_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys where null equals null; without keys b is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    r = b.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)), *(c for c in b.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return a.join(r, same, "left").drop(*(f"_r{i}" for i in range(len(keys))))


def quantiles(df: DataFrame, value: Column, levels: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, n and one column per level: exact quantiles with linear interpolation, one row per key.

    Counted per distinct value and ranked over ranges of (key, value), so no task
    and no buffer holds all values of a key. Null and NaN values are left out.
    """
    g = df.select(*keys, value.cast("double").alias("_x")).where("_x is not null and not isnan(_x)").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_k"))
    r = running(g, [F.col("_x")], {"_upto": F.col("_k")}, keys)
    n = F.col("_upto_total")
    aggs = []
    for name, q in levels.items():
        at = F.lit(float(q)) * (n - 1)
        # the value of rank t (from 0) is the first whose running count exceeds t
        aggs += [F.min(F.when(F.col("_upto") > F.floor(at), F.col("_x"))).alias(f"_lo_{name}"), F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_x"))).alias(f"_hi_{name}"), F.max(at - F.floor(at)).alias(f"_w_{name}")]
    d = r.groupBy(*keys).agg(F.max(n).cast("long").alias("n"), *aggs)
    return d.select(*keys, "n", *((F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * F.col(f"_w_{m}")).alias(m) for m in levels))


def auroc(df: DataFrame, label: Column, score: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUROC with average ranks for ties; label true is the positive class; null where one class is missing.

    Equal scores are summed up first, so the order runs over distinct scores. Null
    labels and scores are left out.
    """
    g = df.select(*keys, label.cast("boolean").alias("_y"), score.cast("double").alias("_s")).where("_y is not null and _s is not null and not isnan(_s)")
    g = g.groupBy(*keys, "_s").agg(F.count_if("_y").alias("_p"), F.count_if(~F.col("_y")).alias("_n"))
    r = running(g, [F.col("_s")], {"p": F.col("_p"), "n": F.col("_n")}, keys)
    # each positive beats the negatives below it and half of those it ties with
    won = F.sum(F.col("_p") * (F.col("n") - F.col("_n") / 2))
    return r.groupBy(*keys).agg(won.alias("_w"), F.sum("_p").cast("double").alias("_np"), F.sum("_n").cast("double").alias("_nn")).select(
        *keys, F.when((F.col("_np") > 0) & (F.col("_nn") > 0), F.col("_w") / (F.col("_np") * F.col("_nn"))).alias("auroc"), F.col("_np").cast("long").alias("n_pos"), F.col("_nn").cast("long").alias("n_neg")
    )


def average_precision(df: DataFrame, label: Column, score: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the gain in recall over falling distinct scores."""
    g = df.select(*keys, label.cast("boolean").alias("_y"), score.cast("double").alias("_s")).where("_y is not null and _s is not null")
    g = g.groupBy(*keys, "_s").agg(F.count_if("_y").alias("_p"), F.count(F.lit(1)).alias("_k"))
    r = running(g, [F.col("_s").desc()], {"tp": F.col("_p"), "all": F.col("_k")}, keys)
    return r.groupBy(*keys).agg(F.sum(F.when(F.col("tp_total") > 0, F.col("_p") / F.col("tp_total") * F.col("tp") / F.col("all"))).alias("average_precision"))


def risk_coverage(df: DataFrame, uncertainty: Column, error: Column, tie: Column, keys: Sequence[str] = ()) -> DataFrame:
    """The discrete risk-coverage curve: one row per claim in order of (uncertainty, tie): coverage, risk, and the errors so far."""
    d = df.select(*keys, uncertainty.cast("double").alias("uncertainty"), error.cast("int").alias("error"), tie.alias("tie")).where("uncertainty is not null and error is not null")
    r = running(d, [F.col("uncertainty"), F.col("tie")], {"errors": F.col("error"), "k": F.lit(1)}, keys)
    return r.select(*keys, "tie", "uncertainty", F.col("k").cast("long").alias("k"), (F.col("k") / F.col("k_total")).alias("coverage"), F.col("errors").cast("long").alias("errors"), (F.col("errors") / F.col("k")).alias("risk"), F.col("k_total").cast("long").alias("n"), F.col("errors_total").cast("long").alias("n_errors"))


def risk_coverage_summary(curve: DataFrame, keys: Sequence[str] = (), risk_targets: Sequence[float] = (0.05, 0.1), coverage_targets: Sequence[float] = (0.8, 0.9)) -> DataFrame:
    """AURC (mean of the risks), that of the best order, the excess, the largest coverage at a risk and the risk at a coverage."""
    # the best order puts all errors last: its risk at k is max(0, k - (n - e)) / k
    best = F.greatest(F.lit(0), F.col("k") - (F.col("n") - F.col("n_errors"))) / F.col("k")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("risk").alias("aurc"), F.avg(best).alias("oracle_aurc")]
    aggs += [F.coalesce(F.max(F.when(F.col("risk") <= t, F.col("coverage"))), F.lit(0.0)).alias(f"coverage_at_risk_{round(t * 100)}") for t in risk_targets]
    aggs += [F.min_by("risk", F.when(F.col("coverage") >= t, F.col("k"))).alias(f"risk_at_coverage_{round(t * 100)}") for t in coverage_targets]
    return curve.groupBy(*keys).agg(*aggs).withColumn("excess_aurc", F.col("aurc") - F.col("oracle_aurc"))


def order_statistic(df: DataFrame, score: Column, level: float, keys: Sequence[str] = ()) -> DataFrame:
    """The ceil((n + 1) * level - 1e-9)-th smallest score of each key; +inf where there are too few. Equal scores are summed first."""
    g = df.select(*keys, score.cast("double").alias("_s")).where("_s is not null").groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_k"))
    r = running(g, [F.col("_s")], {"upto": F.col("_k")}, keys)
    k = F.greatest(F.ceil((F.col("upto_total") + 1) * level - 1e-9), F.lit(1))
    return r.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("_s"))), F.lit(float("inf"))).alias("threshold"), F.max("upto_total").cast("long").alias("n"))


def dominance(clean: DataFrame, shifted: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Largest excess of the shifted survivor function over the clean one, over all thresholds (one-sided Kolmogorov-Smirnov)."""
    w = F.col(weight) if weight else F.lit(1.0)
    u = clean.select(F.col(value).cast("double").alias("x"), w.alias("a"), F.lit(0.0).alias("b")).unionByName(shifted.select(F.col(value).cast("double").alias("x"), F.lit(0.0).alias("a"), w.alias("b")))
    g = u.where("x is not null").groupBy("x").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    r = running(g, [F.col("x").desc()], {"a": F.col("_a"), "b": F.col("_b")})
    return r.agg(F.greatest(F.max(F.col("b") / F.col("b_total") - F.col("a") / F.col("a_total")), F.lit(0.0)).alias("d_plus"))


def holm(pvalues: DataFrame, name: str = "name", p: str = "p") -> DataFrame:
    """Holm-adjusted p-values of a list of hypotheses (a short table): running maximum of min(1, (m - r) p)."""
    w = Window.partitionBy(F.lit(0)).orderBy(p, name)
    d = pvalues.withColumn("_r", F.row_number().over(w) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r")) * F.col(p))
    return d.withColumn("p_holm", F.max(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_m")
