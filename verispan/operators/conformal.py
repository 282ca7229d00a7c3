"""Quantile-calibrated radii and budgets, bins by quantile, rank correlation, label likelihood of chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.operators.ordered import correlation, join_keys, quantiles, running


def epsilon_by_category(df: DataFrame, residual: Column, category: str, level: float, least_n: int = 5) -> DataFrame:
    """The residuals' quantile (linear interpolation) per category, the global one where a category has fewer than least_n."""
    d = df.select(F.col(category), residual.alias("_r"))
    glob = quantiles(d, F.col("_r"), {"_g": level}).select("_g")
    g = d.groupBy(category).agg(F.count("_r").alias("n"))
    j = join_keys(g, quantiles(d, F.col("_r"), {"_q": level}, [category]).drop("n"), [category])
    return j.crossJoin(F.broadcast(glob)).select(category, "n", F.when(F.col("n") >= least_n, F.col("_q")).otherwise(F.col("_g")).alias("epsilon"))  # one row


def budget(df: DataFrame, residual: Column, group: str, level: float, least: float) -> DataFrame:
    """Quantile of the residuals' sum per group, at least ``least``."""
    g = df.groupBy(group).agg(F.sum(residual).alias("_s"))
    q = quantiles(g, F.col("_s"), {"_q": level, "_max": 1.0})
    return g.agg(F.count(F.lit(1)).alias("n_images")).crossJoin(F.broadcast(q)).select("n_images", F.greatest("_q", F.lit(least)).alias("budget"), F.col("_max").alias("largest"))  # one row


def inclusion(df: DataFrame, delta: Column, eps: Column, group: str, total: float, slack: float = 1e-7) -> DataFrame:
    """Share of groups whose deviations keep inside the box, the budget and both."""
    g = df.groupBy(group).agg(F.bool_and(delta <= eps + slack).alias("_box"), (F.sum(delta) <= total + slack).alias("_sum"))
    share = lambda c: F.avg(c.cast("double"))
    return g.agg(F.count(F.lit(1)).alias("n_images"), share(F.col("_box")).alias("in_box"), share(F.col("_sum")).alias("in_budget"), share(F.col("_box") & F.col("_sum")).alias("in_both"))


def quantile_bins(df: DataFrame, width: str, error: str, bins: int) -> DataFrame:
    """Half-open bins between quantile edges, the last closed: count, mean width, error rate."""
    edges = quantiles(df, F.col(width), {f"_q{i}": i / bins for i in range(1, bins)}).select(F.array(*(f"_q{i}" for i in range(1, bins))).alias("_q"))
    d = df.crossJoin(F.broadcast(edges))  # one row
    b = F.size(F.filter("_q", lambda q: F.col(width) >= q))
    return d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(width).alias("mean_width"), F.avg(error).alias("error_rate"))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, average rank) per distinct value; ties share the mean of their ranks."""
    g = df.groupBy(value).agg(F.count(F.lit(1)).alias("_k"))
    return running(g, [F.col(value)], {"_upto": F.col("_k")}).select(value, (F.col("_upto") - (F.col("_k") - 1) / 2).alias(name))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks; ranks are found per distinct value and joined back."""
    d = df.join(average_rank(df, a, "_ra"), a).join(average_rank(df, b, "_rb"), b)
    return d.agg(correlation(F.col("_ra"), F.col("_rb")).alias("spearman"), F.count(F.lit(1)).alias("n"))


def chain_loglik(df: DataFrame, couplings: Sequence[float], group: str = "image_id", order: str = "ordinal", theta: str = "theta", label: str = "y") -> DataFrame:
    """Sum over groups of the labels' log-likelihood under a chain, per coupling: energy of the labels less the log partition sum.

    The partition sum runs along the chain in the JVM, as the logarithms of the two states' weights.
    """
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(theta).alias("t"), (2 * F.col(label) - 1).cast("double").alias("s")))).alias("_c"))
    g = g.withColumn("_j", F.explode(F.array(*(F.lit(float(j)) for j in couplings))))
    j = F.col("_j")
    pair = lambda p, m: F.struct(p.alias("p"), m.alias("m"))
    add = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    start = F.struct(F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("m"))
    z = F.aggregate("_c", start, lambda a, x: F.when(a["p"].isNull(), pair(x["t"], -x["t"])).otherwise(pair(x["t"] + add(a["p"] + j, a["m"] - j), -x["t"] + add(a["p"] - j, a["m"] + j))), lambda a: add(a["p"], a["m"]))
    own = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x["t"] * x["s"])
    links = F.when(F.size("_c") > 1, F.aggregate(F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda i: F.element_at("_c", i)["s"] * F.element_at("_c", i + 1)["s"]), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    return g.groupBy(j.alias("coupling")).agg(F.sum(own + j * links - z).alias("log_likelihood"), F.count(F.lit(1)).alias("n_groups"))
