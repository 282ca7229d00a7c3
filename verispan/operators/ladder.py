"""The ladder of methods, from one score to budgeted bounds, as rows (claim, method), and what each rung adds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.functions import scalar as S
from verispan.operators import inference
from verispan.operators.metrics import ratio

# The rungs in their order.
METHODS = ("M0_detector", "M1_similarity", "M2_fusion", "M3_unary", "M4_belief", "M5_box", "M6_budget")


def ladder(claims: DataFrame, coupling: float, budget: float, steps: int = 100, keep: Sequence[str] = ("y",)) -> DataFrame:
    """One row per claim and method: posterior, lower, upper (null where a method has no bounds).

    claims: image_id, ordinal, det, sim, p, theta, eps and the kept columns. Claims of
    an image form a chain by ordinal. M5 lets every field move by its radius, M6
    within the budget as well; both are taken from one run of the chain kernel.
    """
    g = inference.chain_graphs(claims, coupling)
    b = inference.robust_bounds(g, budget, steps).select("image_id", (F.col("target") + 1).alias("ordinal"), "nominal", "lower_grid", "upper_grid")
    field = lambda sign, name: inference.chain_bp(claims.withColumn("_moved", F.col("theta") + sign * F.col("eps")), coupling, theta="_moved").select("image_id", "ordinal", F.col("marginal").alias(name))
    j = claims.join(b, ["image_id", "ordinal"]).join(field(-1, "_low"), ["image_id", "ordinal"]).join(field(1, "_high"), ["image_id", "ordinal"])
    none = F.lit(None).cast("double")
    p0 = S.clip(1 - F.coalesce("det", F.lit(0.5)), 0.001, 0.999)
    p1 = S.clip(1 - S.clip((F.coalesce("sim", F.lit(0.0)) + 1) / 2, 0.0, 1.0), 0.001, 0.999)
    rungs = [(p0, none, none), (p1, none, none), (F.col("p"), none, none), (S.theta_to_probability(F.col("theta")), none, none), (F.col("nominal"), none, none), (F.col("nominal"), F.col("_low"), F.col("_high")), (F.col("nominal"), F.col("lower_grid"), F.col("upper_grid"))]
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), p.alias("posterior"), lo.alias("lower"), hi.alias("upper")) for m, (p, lo, hi) in zip(METHODS, rungs))))
    return j.select("image_id", "ordinal", *keep, rows.alias("_r")).select("image_id", "ordinal", *keep, "_r.*")


def method_summary(rows: DataFrame, label: str = "y", tau: float = 0.5) -> DataFrame:
    """Per method: claims, images, accuracy, precision, recall and F1 (0 where undefined), Brier score, mean width and share of intervals that hold the threshold."""
    d = rows.withColumn("_y", F.col(label).cast("double")).withColumn("_pos", F.col("posterior") >= tau)
    y, pos, p = F.col("_y"), F.col("_pos"), F.col("posterior")
    g = d.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_claims"), F.countDistinct("image_id").alias("n_images"), F.count_if((y == 1) & pos).alias("tp"), F.count_if((y == 0) & pos).alias("fp"), F.count_if((y == 0) & ~pos).alias("tn"), F.count_if((y == 1) & ~pos).alias("fn"),
        F.avg((p - y) ** 2).alias("brier"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width"), (F.count_if((F.col("lower") < tau) & (F.col("upper") > tau)) / F.count(F.lit(1))).alias("crossing_rate"),
    )
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select("method", "n_claims", "n_images", zero(ratio(tp + tn, tp + fp + tn + fn)).alias("accuracy"), zero(ratio(tp, tp + fp)).alias("precision"), zero(ratio(tp, tp + fn)).alias("recall"), zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), "brier", "mean_width", "crossing_rate")


def rung_gains(summary: DataFrame, columns: Sequence[str] = ("accuracy", "f1", "brier")) -> DataFrame:
    """What each method changes against the one before it; the list of methods is short."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy("method")  # a row per method
    return summary.select("method", F.lag("method").over(w).alias("against"), *((F.col(c) - F.lag(c).over(w)).alias(f"gain_{c}") for c in columns)).where("against is not null")


def by_budget(claims: DataFrame, coupling: float, budgets: Sequence[float], steps: int = 100) -> DataFrame:
    """The profile of every claim: budget, lower and upper, for each of the budgets."""
    g = inference.chain_graphs(claims, coupling)
    out = None
    for b in budgets:
        x = inference.robust_bounds(g, float(b), steps).select("image_id", (F.col("target") + 1).alias("ordinal"), F.lit(float(b)).alias("budget"), F.col("lower_grid").alias("lower"), F.col("upper_grid").alias("upper"))
        out = x if out is None else out.unionByName(x)
    return out


def trapezoid_pr_auc(curve: DataFrame) -> DataFrame:
    """Area under a precision-recall curve (i, precision, recall) in order of recall, by trapezoids; undefined precision counts 1. A curve has few points."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy("recall", F.desc("i"))
    d = curve.select("i", F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("precision", F.lit(1.0)).alias("_p"))
    d = d.select((F.col("recall") - F.lag("recall").over(w)).alias("_dx"), (F.col("_p") + F.lag("_p").over(w)).alias("_s"))
    return d.agg(F.coalesce(F.sum(F.col("_dx") * F.col("_s") / 2), F.lit(0.0)).alias("pr_auc"))


def strata(claims: DataFrame, image: Column, split: Column) -> DataFrame:
    """Per split: images with 1, 2, 3 and 4 or more claims, spanning edges, and a rating by the share of images with edges."""
    g = claims.select(image.alias("_i"), split.alias("split")).where("_i is not null").groupBy("split", "_i").agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k")
    d = g.groupBy("split").agg(F.count(F.lit(1)).alias("n_images"), *(F.count_if(k == n).alias(f"g{n}") for n in (1, 2, 3)), F.count_if(k >= 4).alias("g4_plus"), F.sum(k - 1).alias("spanning_edges"))
    share = 1 - F.col("g1") / F.col("n_images")
    return d.withColumn("rating", F.when(share >= 0.5, "adequate").when(share >= 0.2, "limited").otherwise("inadequate"))
