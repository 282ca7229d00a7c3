"""Fits by sums: logistic models by Newton steps, Platt and isotonic calibration, couplings by grid.

A step of a fit is one aggregation of gradient and Hessian sums over all rows,
combined on the map side; only those few numbers come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.functions import scalar as S
from verispan.operators.inference import chain_fields
from verispan.session import cut


def evidence_features(det: Column, sim: Column, kind: str = "both") -> list[Column]:
    """Features of a claim: detector, similarity, both, or both and their product; a missing detector counts 0.5, a missing similarity 0."""
    d, s = F.coalesce(det, F.lit(0.5)), F.coalesce(sim, F.lit(0.0))
    return {"detector": [d], "similarity": [s], "both": [d, s], "product": [d, s, d * s]}[kind]


def scaler(df: DataFrame, features: Sequence[Column]) -> list[tuple[float, float]]:
    """(mean, population standard deviation) of each feature; a constant one gets deviation 1."""
    r = df.agg(*(x for i, f in enumerate(features) for x in (F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}")))).first()
    return [(r[f"m{i}"] or 0.0, r[f"s{i}"] if r[f"s{i}"] and r[f"s{i}"] > 1e-12 else 1.0) for i in range(len(features))]


def scaled(features: Sequence[Column], scale: Sequence[tuple[float, float]]) -> list[Column]:
    return [(f - m) / s for f, (m, s) in zip(features, scale)]


def filled(df: DataFrame, features: Sequence[Column]) -> list[Column]:
    """Features with a missing value replaced by the feature's mean."""
    r = df.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features))).first()
    return [F.coalesce(f, F.lit(float(r[i] or 0.0))) for i, f in enumerate(features)]


def predict(weights: Sequence[float], features: Sequence[Column]) -> Column:
    """Probability of a logistic model whose first weight is the constant."""
    z = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features):
        z = z + float(w) * f
    return S.sigmoid(z)


def logistic(df: DataFrame, features: Sequence[Column], label: Column, l2: float = 1e-2, steps: int = 50, tolerance: float = 1e-10) -> list[float]:
    """Weights (constant first, not penalised) of a ridge logistic model; zeros without rows. Rows with a null label or feature are left out."""
    return logistic_many(df.withColumn("_model", F.lit(0)), features, label, "_model", [0], l2, steps, tolerance)[0]


def logistic_many(df: DataFrame, features: Sequence[Column], label: Column, model: str, models: Sequence[int], l2: float = 1e-2, steps: int = 50, tolerance: float = 1e-10, times: Column | None = None) -> dict[int, list[float]]:
    """One model per value of the column ``model``, all in the same steps: one aggregation each, with a row per model. A row counts ``times`` rows."""
    k = len(features) + 1
    d = df.select(F.col(model).alias("_m"), (F.lit(1.0) if times is None else times.cast("double")).alias("_times"), label.cast("double").alias("_y"), *(f.cast("double").alias(f"_f{i + 1}") for i, f in enumerate(features))).dropna()
    w = {m: np.zeros(k) for m in models}
    x = [F.lit(1.0), *(F.col(f"_f{i}") for i in range(1, k))]
    pen = np.diag([0.0] + [l2] * (k - 1))
    for _ in range(steps):
        now = F.create_map(*[c for m in models for c in (F.lit(m), F.array(*(F.lit(float(v)) for v in w[m])))])
        e = d.withColumn("_w", F.element_at(now, F.col("_m")))
        z = F.lit(0.0)
        for i in range(k):
            z = z + F.col("_w")[i] * x[i]
        e = e.withColumn("_p", S.sigmoid(z))
        v = F.col("_times") * F.col("_p") * (1 - F.col("_p"))
        sums = [F.sum(F.col("_times") * (F.col("_y") - F.col("_p")) * x[i]).alias(f"g{i}") for i in range(k)] + [F.sum(v * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        moved = 0.0
        for r in e.groupBy("_m").agg(*sums).collect():  # a row per model
            g = np.array([r[f"g{i}"] for i in range(k)]) - pen @ w[r["_m"]]
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + pen + 1e-9 * np.eye(k)
            step = np.linalg.solve(h, g)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))  # no wild step where the classes lie apart
            w[r["_m"]] = w[r["_m"]] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    return {m: [float(v) for v in w[m]] for m in models}


def logistic_by_grid(train: DataFrame, held: DataFrame, features: Sequence[Column], label: Column, grid: Sequence[float] = (0.01, 0.1, 1.0, 10.0), fallback: float = -1.5) -> tuple[list[float], float | None]:
    """(weights over the unscaled features, strength): scaled on the train rows, the penalty 1 / C chosen by the Brier score of the held rows.

    Where the train rows have one class only, the first feature gets the fallback weight and the strength is None.
    """
    n = train.where(label.isNotNull()).agg(F.count_if(label == 1).alias("p"), F.count_if(label == 0).alias("n")).first()
    if not n.p or not n.n:
        return [0.0, fallback] + [0.0] * (len(features) - 1), None
    scale = scaler(train, features)
    found = {c: logistic(train, scaled(features, scale), label, 1.0 / c) for c in grid}
    y = label.cast("double")
    briers = held.where(label.isNotNull()).agg(*(F.avg((predict(w, scaled(features, scale)) - y) ** 2).alias(f"b{i}") for i, w in enumerate(found.values()))).first()
    best = min(range(len(grid)), key=lambda i: (briers[i] if briers[i] is not None else 0.0, i))
    w = found[grid[best]]
    slopes = [v / s for v, (_, s) in zip(w[1:], scale)]
    return [w[0] - sum(v * m for v, (m, _) in zip(slopes, scale)), *slopes], float(grid[best])


def platt(df: DataFrame, prob: Column, label: Column, least: int = 4) -> tuple[float, float] | None:
    """(constant, slope) on the logit of the probability; None with fewer rows or one class."""
    n = df.where(label.isNotNull() & prob.isNotNull()).agg(F.count_if(label == 1).alias("p"), F.count_if(label == 0).alias("n")).first()
    if not n.p or not n.n or n.p + n.n < least:
        return None
    a, b = logistic(df, [S.logit(prob, 1e-6)], label, 1e-6)
    return a, b


def apply_platt(fit: tuple[float, float] | None, prob: Column) -> Column:
    return prob if fit is None else S.sigmoid(fit[0] + fit[1] * S.logit(prob, 1e-6))


def isotonic(df: DataFrame, prob: Column, label: Column, least: int = 20) -> list[tuple[float, float]] | None:
    """(probability, calibrated) corners of the non-decreasing fit; None under ``least`` rows or with one class. Pooling runs over ranges in parallel."""
    from pyspark.ml.regression import IsotonicRegression

    d = df.where(label.isNotNull() & prob.isNotNull()).groupBy(prob.cast("double").alias("x")).agg(F.avg(label.cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    n = d.agg(F.sum("w").alias("n"), F.sum(F.col("y") * F.col("w")).alias("p")).first()
    if not n.n or n.n < least or n.p in (0.0, n.n):
        return None
    m = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(d)
    return list(zip(m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()))


def apply_isotonic(corners: Sequence[tuple[float, float]] | None, prob: Column) -> Column:
    """Linear between corners, constant outside; a short list of corners."""
    if not corners:
        return prob
    out = F.lit(corners[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(corners, corners[1:]))):
        out = F.when(prob <= x1, y0 + (y1 - y0) * (prob - x0) / (x1 - x0) if x1 > x0 else F.lit(y1)).otherwise(out)
    return F.when(prob <= corners[0][0], corners[0][1]).otherwise(out)


def coupling_scores(claims: DataFrame, grid: Sequence[float], group: str = "image_id", order: str = "ordinal", theta: str = "theta", label: str = "y") -> DataFrame:
    """coupling, log_loss, brier, n: how well chain marginals under each coupling foretell the labels. A negative coupling is an error."""
    if any(g < 0 for g in grid):
        raise ValueError("couplings must not be negative")
    g = claims.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(theta).alias("t"), F.col(label).alias("y")))).alias("_c"))  # one image
    g = g.withColumn("coupling", F.explode(F.array(*(F.lit(float(x)) for x in grid))))
    f = chain_fields(F.transform("_c", lambda x: x["t"]), F.col("coupling"))
    e = g.select("coupling", F.inline(F.arrays_zip(F.transform("_c", lambda x: x["y"]).alias("y"), f.alias("f")))).where("y is not null")
    p = S.clip(S.theta_to_probability(F.col("f")), 1e-12, 1 - 1e-12)
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    return e.groupBy("coupling").agg(F.avg(loss).alias("log_loss"), F.avg((p - F.col("y")) ** 2).alias("brier"), F.count(F.lit(1)).alias("n"))


def best_coupling(scores: DataFrame, objective: str = "log_loss") -> DataFrame:
    """The coupling with the least score; the smaller on ties."""
    return scores.agg(F.min_by("coupling", F.struct(objective, "coupling")).alias("coupling"), F.min(objective).alias(objective))


def incremental_utility(df: DataFrame, nominal: Sequence[Column], robust: Sequence[Column], label: Column, group: Column, folds: int = 5, seed: str = "folds", least: int = 20) -> DataFrame:
    """What the robust features add to the nominal ones out of fold: log-loss and Brier score of both models and their differences, by groups kept whole.

    Folds come from the hash of the group. One row; null scores and status
    ``too_few`` under ``least`` labelled rows or with one class.
    """
    fold = (S.uniform(group, F.lit(seed)) * folds).cast("int")
    every = [*nominal, *robust]
    d = df.where(label.isNotNull()).select(fold.alias("_fold"), label.cast("double").alias("_y"), *(f.cast("double").alias(f"_x{i}") for i, f in enumerate(every)))
    # read once: every step of the fits goes over what is stored here, equal rows as one; a test for nulls before would work the features out again and again
    d = cut(d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("_times"))).dropna()
    times = F.col("_times")
    n = d.agg(F.coalesce(F.sum(times), F.lit(0)).alias("n"), F.sum(F.col("_y") * times).alias("p")).first()
    spark = df.sparkSession
    schema = "n long, log_loss_nominal double, log_loss_both double, brier_nominal double, brier_both double, gain_log_loss double, gain_brier double, status string"
    if n.n < least or not n.p or n.p == n.n:
        return spark.createDataFrame([(n.n, *[None] * 6, "too_few")], schema)
    train = d.withColumn("_model", F.explode(F.array(*(F.lit(m) for m in range(folds))))).where("_model != _fold")
    xs = [F.col(f"_x{i}") for i in range(len(every))]
    fits = {name: logistic_many(train, cols, F.col("_y"), "_model", range(folds), times=times) for name, cols in (("nominal", xs[: len(nominal)]), ("both", xs))}
    aggs = []
    for name, cols in (("nominal", xs[: len(nominal)]), ("both", xs)):
        p = F.lit(None).cast("double")
        for m, w in fits[name].items():
            p = F.when(F.col("_fold") == m, predict(w, cols)).otherwise(p)
        p = S.clip(p, 1e-12, 1 - 1e-12)
        mean = lambda e: F.sum(times * e) / F.sum(times)
        aggs += [mean(-(F.col("_y") * F.log(p) + (1 - F.col("_y")) * F.log(1 - p))).alias(f"log_loss_{name}"), mean((p - F.col("_y")) ** 2).alias(f"brier_{name}")]
    r = d.agg(F.sum(times).alias("n"), *aggs)
    return r.select("n", "log_loss_nominal", "log_loss_both", "brier_nominal", "brier_both", (F.col("log_loss_nominal") - F.col("log_loss_both")).alias("gain_log_loss"), (F.col("brier_nominal") - F.col("brier_both")).alias("gain_brier"), F.lit("evaluated").alias("status"))
