"""Conformal filtering under a shift of the scores: thresholds, radii, risks, and their spread over random splits of the images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.functions import scalar as S
from verispan.operators.ordered import join_keys, order_statistic, running


def claim_threshold(cal: DataFrame, score: str, delta: float, keys: Sequence[str] = ()) -> DataFrame:
    """The score that at most a share delta of hallucinated claims exceed: keys and ``tau``; +inf where too few are known."""
    return order_statistic(cal.where("y = 1"), F.col(score), 1 - delta, keys).select(*keys, F.col("threshold").alias("tau"))


def image_threshold(cal: DataFrame, score: str, alpha: float, keys: Sequence[str] = (), image: str = "image_id") -> DataFrame:
    """The same over the images' worst hallucinated claim, -inf for an image without any."""
    g = cal.groupBy(*keys, image).agg(F.coalesce(F.max(F.when(F.col("y") == 1, F.col(score))), F.lit(float("-inf"))).alias("_worst"))
    return order_statistic(g, F.col("_worst"), 1 - alpha, keys).select(*keys, F.col("threshold").alias("tau"))


def claim_radius(cal: DataFrame, clean: str, shifted: str, beta: float, keys: Sequence[str] = ()) -> DataFrame:
    """How far a shift lifts the score of a hallucinated claim, at most: keys and ``eps``, not under 0."""
    return order_statistic(cal.where("y = 1"), F.greatest(F.col(shifted) - F.col(clean), F.lit(0.0)), 1 - beta, keys).select(*keys, F.col("threshold").alias("eps"))


def image_radius(cal: DataFrame, clean: str, shifted: str, beta: float, keys: Sequence[str] = (), image: str = "image_id") -> DataFrame:
    """The largest change of any claim of an image, to either side."""
    g = cal.groupBy(*keys, image).agg(F.max(F.abs(F.col(shifted) - F.col(clean))).alias("_d"))
    return order_statistic(g, F.col("_d"), 1 - beta, keys).select(*keys, F.col("threshold").alias("eps"))


def claim_risk(test: DataFrame, score: Column, tau: Column, eps: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Share of hallucinated claims kept and of supported ones kept."""
    k = S.kept(score, tau, eps).cast("double")
    return test.groupBy(*keys).agg(F.avg(F.when(F.col("y") == 1, k)).alias("risk"), F.avg(F.when(F.col("y") == 0, k)).alias("retention"))


def image_risk(test: DataFrame, score: Column, tau: Column, eps: Column, keys: Sequence[str] = (), image: str = "image_id") -> DataFrame:
    """Share of images that keep a hallucinated claim, and of those that keep none at all."""
    k = S.kept(score, tau, eps)
    g = test.groupBy(*keys, image).agg(F.max((k & (F.col("y") == 1)).cast("int")).alias("_bad"), F.count_if(k).alias("_kept"))
    return g.groupBy(*keys).agg(F.avg("_bad").alias("bad_rate"), F.avg((F.col("_kept") == 0).cast("double")).alias("abstention"))


def random_splits(claims: DataFrame, n: int, share: float, seed: str, image: str = "image_id") -> DataFrame:
    """claims times n, with ``rep`` and whether the image calibrates in it (by hash: an image's claims stay together)."""
    d = claims.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.withColumn("is_cal", S.uniform(F.col(image), F.col("rep"), F.lit(seed)) < share)


def split_study(claims: DataFrame, clean: str, shifted: str, n: int, share: float = 0.5, delta: float = 0.1, beta: float = 0.1, seed: str = "splits") -> DataFrame:
    """rep, tau, eps, risk and retention on the clean scores, on the shifted ones, and on those with the radius taken off. One pass per step over all replicates."""
    d = random_splits(claims, n, share, seed)
    cal = d.where("is_cal")
    t = join_keys(claim_threshold(cal, clean, delta, ["rep"]), claim_radius(cal, clean, shifted, beta, ["rep"]), ["rep"])  # a row per replicate
    test = d.where("not is_cal").join(F.broadcast(t), "rep")
    parts = []
    for name, score, eps in (("clean", clean, F.lit(0.0)), ("shifted", shifted, F.lit(0.0)), ("robust", shifted, F.col("eps"))):
        k = S.kept(F.col(score), F.col("tau"), eps).cast("double")
        parts += [F.avg(F.when(F.col("y") == 1, k)).alias(f"risk_{name}"), F.avg(F.when(F.col("y") == 0, k)).alias(f"retention_{name}")]
    return test.groupBy("rep").agg(F.max("tau").alias("tau"), F.max("eps").alias("eps"), *parts)


def decide(lower: Column, upper: Column, target: float, slack: float = 0.03) -> Column:
    """violated where the whole interval is over the target, preserved where it ends within the slack, else inconclusive."""
    return F.when(lower > target, "violated").when(upper <= target + slack, "preserved").otherwise("inconclusive")


def image_stats(test: DataFrame, score: str, taus: Sequence[float], image: str = "image_id") -> DataFrame:
    """Per image, over a short list of thresholds: mean numbers of hallucinated and supported claims kept, bad rate and abstention; and their totals."""
    g = test.groupBy(image).agg(F.count_if(F.col("y") == 1).alias("n_hallucinated"), F.count_if(F.col("y") == 0).alias("n_supported"), *(a for i, t in enumerate(taus) for a in (F.count_if((F.col(score) > t) & (F.col("y") == 1)).alias(f"_h{i}"), F.count_if((F.col(score) > t) & (F.col("y") == 0)).alias(f"_s{i}"))))
    mean = lambda cols: sum(cols, F.lit(0.0)) / len(taus)
    r = range(len(taus))
    return g.select(image, "n_hallucinated", "n_supported", mean([F.col(f"_h{i}") for i in r]).alias("kept_hallucinated"), mean([F.col(f"_s{i}") for i in r]).alias("kept_supported"), mean([(F.col(f"_h{i}") > 0).cast("double") for i in r]).alias("bad"), mean([((F.col(f"_h{i}") + F.col(f"_s{i}")) == 0).cast("double") for i in r]).alias("abstained"))


def weighted_metrics(stats: DataFrame, weight: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Ratios of weighted sums of image_stats; null where the weights add up to nothing."""
    w = lambda c: F.sum(weight * F.col(c))
    return stats.groupBy(*keys).agg(F.try_divide(w("kept_hallucinated"), w("n_hallucinated")).alias("claim_risk"), F.try_divide(w("kept_supported"), w("n_supported")).alias("retention"), F.try_divide(w("bad"), F.sum(weight)).alias("image_risk"), F.try_divide(w("abstained"), F.sum(weight)).alias("abstention"))


def shift_stats(claims: DataFrame, clean: str, shifted: str) -> DataFrame:
    """Per label: number, mean and median change of the score, share that rose."""
    from verispan.operators.ordered import quantiles

    d = claims.where("y is not null").select(F.col("y").alias("label"), (F.col(shifted) - F.col(clean)).alias("_d"))
    g = d.groupBy("label").agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_change"), F.avg((F.col("_d") > 0).cast("double")).alias("share_up"))
    return join_keys(g, quantiles(d, F.col("_d"), {"median_change": 0.5}, ["label"]).drop("n"), ["label"])


def dominance_bootstrap(claims: DataFrame, clean: str, shifted: str, reps: int, image: str = "image_id", seed: str = "dominance", digits: int = 3) -> DataFrame:
    """rep (0 the data) and d_plus, the largest excess of the shifted survivor function over the clean one, under resampled images.

    Scores are rounded to ``digits`` and counted per image and value before replicates are made.
    """
    a = claims.select(F.col(image).alias("_i"), F.round(clean, digits).alias("x"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    b = claims.select(F.col(image).alias("_i"), F.round(shifted, digits).alias("x"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    g = a.unionByName(b).where("x is not null").groupBy("_i", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    e = g.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    w = F.when(F.col("rep") == 0, 1).otherwise(S.poisson_weight(S.uniform(F.col("_i"), F.col("rep") - 1, F.lit(seed))))
    t = e.groupBy("rep", "x").agg(F.sum(w * F.col("a")).alias("_a"), F.sum(w * F.col("b")).alias("_b"))
    r = running(t, [F.col("x").desc()], {"ra": F.col("_a"), "rb": F.col("_b")}, ["rep"])
    return r.groupBy("rep").agg(F.greatest(F.max(F.try_divide("rb", "rb_total") - F.try_divide("ra", "ra_total")), F.lit(0.0)).alias("d_plus"))


def swap_scores(claims: DataFrame, keys: Sequence[str], swaps: DataFrame, score: str) -> DataFrame:
    """Inner join to another detector's scores by the keys; claims without a finite one are left out."""
    s = swaps.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))).groupBy(*keys).agg(F.min(score).alias("swap_score"))
    return claims.join(s, list(keys))


def resampled_thresholds(cal: DataFrame, score: str, level: float, n: int, share: float = 0.8, seed: str = "taus", image: str = "image_id") -> DataFrame:
    """rep, tau: the claim threshold on n random parts of the images, each with about the share of them."""
    d = random_splits(cal, n, share, seed, image).where("is_cal")
    return claim_threshold(d, score, 1 - level, ["rep"])


def width_ratio(df: DataFrame, image: str, robust: Column, box: Column, reps: int, seed: str = "ratio") -> DataFrame:
    """Mean robust width over mean box width with its interval over resampled images; null where boxes have no width."""
    from verispan.operators.reliability import interval_of, weighted_replicates

    g = df.select(F.col(image), robust.cast("double").alias("_a"), box.cast("double").alias("_b")).where("_a is not null and _b is not null").groupBy(image).agg(F.sum("_a").alias("sa"), F.sum("_b").alias("sb"))
    r = weighted_replicates(g, image, reps, {"sa": F.col("sa"), "sb": F.col("sb")}, seed)
    return interval_of(r, F.try_divide("sa", "sb"), "ratio")
