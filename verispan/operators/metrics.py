"""Conditional aggregations: classification, calibration, agreement, intervals, graph coverage.

Undefined ratios are null. All run in one map-combined aggregation unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.operators.ordered import correlation, join_keys, quantiles


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def classification(df: DataFrame, truth: Column, pred: Column, keys: Sequence[str] = (), undefined: float | None = None) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1; rows without truth or prediction are left out. undefined replaces null ratios."""
    d = df.select(*keys, truth.cast("boolean").alias("_y"), pred.cast("boolean").alias("_p")).where("_y is not null and _p is not null")
    y, p = F.col("_y"), F.col("_p")
    g = d.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    fill = (lambda c: F.coalesce(c, F.lit(undefined))) if undefined is not None else (lambda c: c)
    return g.select(*keys, "tp", "fp", "tn", "fn", fill(ratio(tp + tn, tp + fp + tn + fn)).alias("accuracy"), fill(ratio(tp, tp + fp)).alias("precision"), fill(ratio(tp, tp + fn)).alias("recall"), fill(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def brier_logloss(df: DataFrame, truth: Column, prob: Column, keys: Sequence[str] = (), eps: float = 1e-12) -> DataFrame:
    d = df.select(*keys, truth.cast("double").alias("_y"), prob.cast("double").alias("_p")).where("_y is not null and _p is not null")
    p = F.least(F.greatest(F.col("_p"), F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col("_y") * F.log(p) + (1 - F.col("_y")) * F.log(1 - p))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_p") - F.col("_y")) ** 2).alias("brier"), F.avg(loss).alias("log_loss"))


def reliability_bins(df: DataFrame, truth: Column, prob: Column, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Half-open bins of equal width, the last one closed: count, mean probability, share of positives."""
    d = df.select(*keys, truth.cast("double").alias("_y"), prob.cast("double").alias("_p")).where("_y is not null and _p is not null")
    b = F.least(F.greatest(F.floor(F.col("_p") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return d.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("mean_prob"), F.avg("_y").alias("share_pos"))


def ece(df: DataFrame, truth: Column, prob: Column, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    g = reliability_bins(df, truth, prob, bins, keys)
    return g.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("share_pos"))) / F.sum("n")).alias("ece"))


def ece_closed(df: DataFrame, truth: Column, prob: Column, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Bins closed at both ends: a probability on an inner edge counts in both bins."""
    d = df.select(*keys, truth.cast("double").alias("_y"), prob.cast("double").alias("_p")).where("_y is not null and _p is not null")
    x = F.col("_p") * bins
    low = F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(bins - 1)).cast("int")
    both = F.when((x == F.floor(x)) & (x > 0) & (x < bins), F.array(low - 1, low)).otherwise(F.array(low))
    g = d.withColumn("bin", F.explode(both)).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("mean_prob"), F.avg("_y").alias("share_pos"))
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    j = g.join(n, list(keys)) if keys else g.crossJoin(F.broadcast(n))  # one row
    return j.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("share_pos"))) / F.max("_all")).alias("ece_closed"))


def pr_curve(df: DataFrame, truth: Column, prob: Column, steps: int = 50) -> DataFrame:
    """Precision and recall at ``steps`` thresholds from 0 to 1: one pass over bins of the thresholds, then sums from above."""
    d = df.select(truth.cast("boolean").alias("_y"), prob.cast("double").alias("_p")).where("_y is not null and _p is not null")
    # the highest threshold index that the probability reaches
    k = F.least(F.floor(F.col("_p") * (steps - 1) + 1e-12), F.lit(steps - 1)).cast("int")
    g = d.groupBy(k.alias("k")).agg(F.count_if("_y").alias("p"), F.count(F.lit(1)).alias("a"))
    t = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("i"))
    s = t.join(F.broadcast(g), F.col("k") >= F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("a"), F.lit(0)).alias("predicted"))  # at most steps x steps rows
    pos = g.agg(F.sum("p").alias("_pos"))
    return s.crossJoin(F.broadcast(pos)).select("i", (F.col("i") / (steps - 1)).alias("threshold"), "tp", "predicted", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("_pos")).alias("recall"))


def cohens_kappa(df: DataFrame, a: Column, b: Column, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Observed and expected agreement and kappa; null kappa without rows or where the expected agreement is 1."""
    d = df.select(*keys, a.alias("_a"), b.alias("_b")).where(F.col("_a").isin(*classes) & F.col("_b").isin(*classes))
    n = F.count(F.lit(1))
    po = F.avg((F.col("_a") == F.col("_b")).cast("double"))
    pe = sum((F.avg((F.col("_a") == c).cast("double")) * F.avg((F.col("_b") == c).cast("double")) for c in classes), F.lit(0.0))
    g = d.groupBy(*keys).agg(n.alias("n"), po.alias("po"), pe.alias("pe"))
    return g.withColumn("kappa", F.when((F.col("n") > 0) & (F.abs(1 - F.col("pe")) > 1e-9), (F.col("po") - F.col("pe")) / (1 - F.col("pe"))))


def interval_statistics(df: DataFrame, lower: Column, upper: Column, truth: Column, tau: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Width moments and percentiles, crossing shares strict and inclusive, mean width by class, correlation with the midpoint's error."""
    d = df.select(*keys, lower.alias("_l"), upper.alias("_u"), truth.cast("double").alias("_y"))
    w, l, u, y = F.col("_u") - F.col("_l"), F.col("_l"), F.col("_u"), F.col("_y")
    err = F.abs((l + u) / 2 - y)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(w).alias("mean_width"), F.stddev_pop(w).alias("std_width"), F.min(w).alias("min_width"), F.max(w).alias("max_width"),
        F.avg(((l < tau) & (u > tau)).cast("double")).alias("crossing_strict"), F.avg(((l <= tau) & (u >= tau)).cast("double")).alias("crossing_inclusive"),
        F.avg(F.when(y == 1, w)).alias("mean_width_hallucinated"), F.avg(F.when(y == 0, w)).alias("mean_width_supported"), correlation(w, err).alias("width_error_pearson"),
    )
    return join_keys(g, quantiles(d, w, {f"p{round(q * 100)}_width": q for q in (0.25, 0.5, 0.75, 0.9)}, keys).drop("n"), keys)


def pair_dependence(df: DataFrame, a: Column, b: Column, keys: Sequence[str] = ()) -> DataFrame:
    """2 x 2 table of two binary states: agreement, phi, Haldane odds ratio, mutual information in bits."""
    d = df.select(*keys, a.cast("boolean").alias("_a"), b.cast("boolean").alias("_b")).where("_a is not null and _b is not null")
    x, y = F.col("_a"), F.col("_b")
    g = d.groupBy(*keys).agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    r1, r0, c1, c0 = n11 + n10, n01 + n00, n11 + n01, n10 + n00
    part = lambda k, r, c: F.when(k > 0, k / n * F.log2(k * n / (r * c))).otherwise(0.0)
    return g.select(
        *keys, "n11", "n10", "n01", "n00", ratio(n11 + n00, n).alias("agreement"), ratio(n11 * n00 - n10 * n01, F.sqrt(r1 * r0 * c1 * c0)).alias("phi"),
        ((n11 + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5))).alias("odds_ratio"), (part(n11, r1, c1) + part(n10, r1, c0) + part(n01, r0, c1) + part(n00, r0, c0)).alias("mutual_information"),
    )


def graph_coverage(df: DataFrame, image: Column) -> DataFrame:
    """Images by number of claims (1, 2, 3, 4 or more), spanning edges, and the median number of claims."""
    g = df.select(image.alias("_i")).where("_i is not null").groupBy("_i").agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k")
    return g.agg(F.count(F.lit(1)).alias("n_images"), F.sum(k).alias("n_claims"), F.count_if(k == 1).alias("g1"), F.count_if(k == 2).alias("g2"), F.count_if(k == 3).alias("g3"), F.count_if(k >= 4).alias("g4_plus"), F.sum(k - 1).alias("spanning_edges"), F.percentile(k, F.lit(0.5)).alias("median_claims"))


def within_group_correlation(df: DataFrame, group: Column, y: Column) -> DataFrame:
    """Pearson correlation over all ordered pairs of different rows of a group, from the groups' sums: no pairs are made."""
    g = df.select(group.alias("_g"), y.cast("double").alias("_y")).where("_y is not null and _g is not null").groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") ** 2).alias("q"))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    t = g.agg(F.sum(n * (n - 1)).alias("pairs"), F.sum((n - 1) * s).alias("sx"), F.sum((n - 1) * q).alias("sxx"), F.sum(s * s - q).alias("sxy"))
    m = F.col("sx") / F.col("pairs")
    var = F.col("sxx") / F.col("pairs") - m * m
    return t.select(F.col("pairs").cast("long").alias("n_pairs"), F.when(var > 1e-15, (F.col("sxy") / F.col("pairs") - m * m) / var).alias("correlation"))


def selective(df: DataFrame, lower: Column, upper: Column, truth: Column, tau: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Abstain where the interval holds the threshold; coverage, risk and f1 of the rest."""
    d = df.select(*keys, lower.alias("_l"), upper.alias("_u"), truth.cast("boolean").alias("_y")).where("_y is not null")
    on, p, y = (F.col("_u") < tau) | (F.col("_l") > tau), F.col("_l") > tau, F.col("_y")
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(on).alias("n_kept"), F.count_if(on & (p == y)).alias("n_right"), F.count_if(on & p & y).alias("tp"), F.count_if(on & p & ~y).alias("fp"), F.count_if(on & ~p & y).alias("fn"))
    return g.select(*keys, "n", "n_kept", ratio(F.col("n_kept"), F.col("n")).alias("coverage"), ratio(F.col("n_kept") - F.col("n_right"), F.col("n_kept")).alias("selective_risk"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("selective_f1"))
