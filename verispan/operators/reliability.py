"""Does uncertainty tell errors: detection, tracking of corruption, stability, paired comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.functions import scalar as S
from verispan.operators.conformal import average_rank
from verispan.operators.ordered import auroc, average_precision, correlation, join_keys, quantiles


def uncertainty_columns(lower: Column, upper: Column, tau: float = 0.5) -> list[Column]:
    """low, high, width, crossing_strict, crossing_inclusive, margin (distance of the interval to the threshold, 0 inside), decision."""
    lo, hi = S.clip(lower, 0.0, 1.0), S.clip(upper, 0.0, 1.0)
    margin = F.greatest(lo - tau, tau - hi, F.lit(0.0))
    return [lo.alias("low"), hi.alias("high"), (hi - lo).alias("width"), ((lo < tau) & (hi > tau)).alias("crossing_strict"), ((lo <= tau) & (hi >= tau)).alias("crossing_inclusive"), margin.alias("margin"), S.robust_decision(lo, hi, tau).alias("decision")]


def error_detection(df: DataFrame, error: Column, uncertainty: Column, least: int = 10) -> DataFrame:
    """One row: n, errors, mean and median uncertainty of errors and of right ones, AUROC and average precision, status (evaluated, too_few, one_class)."""
    d = df.select(error.cast("int").alias("_e"), uncertainty.cast("double").alias("_u")).where("_e is not null and _u is not null")
    g = d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_e"), F.lit(0)).alias("n_errors"), F.avg(F.when(F.col("_e") == 1, F.col("_u"))).alias("mean_error"), F.avg(F.when(F.col("_e") == 0, F.col("_u"))).alias("mean_right"))
    q = lambda k, name: quantiles(d.where(F.col("_e") == k), F.col("_u"), {name: 0.5}).select(name)
    j = g
    # one row each
    for x in (q(1, "median_error"), q(0, "median_right"), auroc(d, F.col("_e"), F.col("_u")).select("auroc"), average_precision(d, F.col("_e"), F.col("_u"))):
        j = j.crossJoin(F.broadcast(x))
    status = F.when(F.col("n") < least, "too_few").when((F.col("n_errors") == 0) | (F.col("n_errors") == F.col("n")), "one_class").otherwise("evaluated")
    return j.withColumn("status", status)


def width_by_label(df: DataFrame, label: Column, width: Column) -> DataFrame:
    """label (null as unknown), n, mean and median width."""
    d = df.select(F.coalesce(label.cast("string"), F.lit("unknown")).alias("label"), width.alias("_w"))
    g = d.groupBy("label").agg(F.count("_w").alias("n"), F.avg("_w").alias("mean_width"))
    return join_keys(g, quantiles(d, F.col("_w"), {"median_width": 0.5}, ["label"]).drop("n"), ["label"])


def width_tracking(rows: DataFrame, key: Sequence[str], severity: str, width: str, order: Sequence[str]) -> DataFrame:
    """severity, n, mean change against the first severity, share of claims that widened, for claims seen under it.

    One grouping by claim puts the widths of its severities side by side: no join.
    """
    g = rows.groupBy(*key).agg(*(F.max(F.when(F.col(severity) == s, F.col(width))).alias(f"_w{i}") for i, s in enumerate(order)))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), (F.col(f"_w{i}") - F.col("_w0")).alias("change")) for i, s in enumerate(order) if i)))
    d = g.select(each.alias("_r")).select("_r.*").where("change is not null")
    return d.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.avg("change").alias("mean_change"), F.avg((F.col("change") > 0).cast("double")).alias("share_wider"))


def rank_tracking(rows: DataFrame, key: Sequence[str], severity: str, width: str, order: Sequence[str]) -> DataFrame:
    """n_claims and the mean over claims of the rank correlation between severity and width; claims with one width throughout are left out."""
    level = F.element_at(F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(float(i + 1)))]), F.col(severity))
    g = rows.groupBy(*key).agg(F.collect_list(F.struct(level.alias("s"), F.col(width).alias("w"))).alias("_a"))  # a row per severity
    rank = lambda f: F.transform("_a", lambda x: F.aggregate("_a", F.lit(0.0), lambda a, y: a + F.when(y[f] < x[f], 1.0).when(y[f] == x[f], 0.5).otherwise(0.0)))
    e = g.where("size(_a) > 1").select(*key, F.inline(F.arrays_zip(rank("s").alias("rs"), rank("w").alias("rw"))))
    c = e.groupBy(*key).agg(correlation(F.col("rs"), F.col("rw")).alias("r")).where("r is not null and not isnan(r)")
    return c.agg(F.count(F.lit(1)).alias("n_claims"), F.avg("r").alias("mean_rank_correlation"))


def edge_audit(edges: DataFrame, least: int = 5) -> DataFrame:
    """edges (similarity, y_u, y_v): number, share that agree, rank correlation between similarity and agreement, status."""
    d = edges.where("y_u is not null and y_v is not null and similarity is not null").select("similarity", (F.col("y_u") == F.col("y_v")).cast("double").alias("agrees"))
    r = d.join(average_rank(d, "similarity", "_rs"), "similarity").join(average_rank(d, "agrees", "_ra"), "agrees")
    g = r.agg(F.count(F.lit(1)).alias("n_edges"), F.avg("agrees").alias("agreement"), correlation(F.col("_rs"), F.col("_ra")).alias("rank_correlation"))
    return g.withColumn("status", F.when(F.col("n_edges") < least, "too_few").otherwise("evaluated"))


def weighted_replicates(clusters: DataFrame, cluster: str, reps: int, sums: dict[str, Column], seed: str) -> DataFrame:
    """rep and weighted sums, with replicate 0 being the data themselves."""
    from verispan.operators.resampling import replicates

    own = clusters.agg(*(F.sum(e.cast("double")).alias(n) for n, e in sums.items())).select(F.lit(0).alias("rep"), *sums)
    return own.unionByName(replicates(clusters, cluster, reps, sums, seed).withColumn("rep", F.col("rep") + 1))


def interval_of(reps: DataFrame, value: Column, name: str, level: float = 0.95, least: int = 10) -> DataFrame:
    """The value of replicate 0 and the percentile interval of the others; null ends under ``least`` of them."""
    a = (1 - level) / 2
    d = reps.select("rep", value.alias("_v"))
    q = lambda p: F.when(F.count(F.when(F.col("rep") > 0, F.col("_v"))) >= least, F.percentile(F.when(F.col("rep") > 0, F.col("_v")), F.lit(p)))
    return d.agg(F.max(F.when(F.col("rep") == 0, F.col("_v"))).alias(name), q(a).alias("lower"), q(1 - a).alias("upper"), F.count_if((F.col("rep") > 0) & F.col("_v").isNotNull()).alias("n_replicates"))  # a row per replicate


def crossing_stability(df: DataFrame, image: str, error: Column, lower: Column, upper: Column, reps: int, tau: float = 0.5, seed: str = "crossing") -> DataFrame:
    """Error rate of claims whose interval holds the threshold less that of the others, with its interval over resampled images."""
    c = ((lower < tau) & (upper > tau)).cast("int")
    g = df.select(F.col(image), error.cast("int").alias("_e"), c.alias("_c")).where("_e is not null").groupBy(image).agg(F.sum("_c").alias("nc"), F.sum(1 - F.col("_c")).alias("no"), F.sum(F.col("_c") * F.col("_e")).alias("ec"), F.sum((1 - F.col("_c")) * F.col("_e")).alias("eo"))
    r = weighted_replicates(g, image, reps, {n: F.col(n) for n in ("nc", "no", "ec", "eo")}, seed)
    return interval_of(r, F.try_divide("ec", "nc") - F.try_divide("eo", "no"), "risk_difference")


def paired_difference(df: DataFrame, image: str, a: Column, b: Column, reps: int, seed: str = "paired") -> DataFrame:
    """Mean of a less mean of b over the same claims, both from each replicate's images: a paired interval."""
    g = df.select(F.col(image), a.cast("double").alias("_a"), b.cast("double").alias("_b")).where("_a is not null and _b is not null").groupBy(image).agg(F.count(F.lit(1)).alias("n"), F.sum("_a").alias("sa"), F.sum("_b").alias("sb"))
    r = weighted_replicates(g, image, reps, {n: F.col(n) for n in ("n", "sa", "sb")}, seed)
    return interval_of(r, F.try_divide(F.col("sa") - F.col("sb"), F.col("n")), "difference")


def roc_points(df: DataFrame, label: Column, score: Column, bins: int = 100) -> DataFrame:
    """bin, true and false positives at thresholds i / bins: counts of all rows at or over each."""
    d = df.select(label.cast("boolean").alias("_y"), F.least(F.greatest(F.floor(score * bins), F.lit(0)), F.lit(bins)).cast("int").alias("bin")).where("_y is not null and bin is not null")
    g = d.groupBy("bin").agg(F.count_if("_y").alias("p"), F.count_if(~F.col("_y")).alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # at most bins + 1 rows
    return g.select("bin", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"))


def histogram(df: DataFrame, value: Column, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    b = F.least(F.greatest(F.floor((value - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(value.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
