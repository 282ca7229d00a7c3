"""Queries over the claims derived from lineitem: inference, metrics, ranking, conformal thresholds, resampling."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verispan.functions import scalar as S
from verispan.operators import conformal, inference, metrics, ordered, resampling
from verispan.plans.claims import BASE_EPS, CLAIMS_SQL, COUPLING, claims_base, rounded
from verispan.plans.registry import CORE



def _y():
    return F.col("y")


def _p():
    return F.col("p")


#: Steps of the budget grid and couplings tried in production.
GRID_STEPS = 100
COUPLING_GRID = [j / 100 for j in range(201)]

_LABELLED = "claims WHERE y IS NOT NULL"


def _sql(body: str) -> str:
    return CLAIMS_SQL + "\n" + body


_CLS = """tp, fp, tn, fn, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS "precision",
 round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"""
_COUNTS = "count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 1 AND p < 0.5) AS fn"


@CORE.add("claim_decisions", _sql("""SELECT decision, count(*) AS n, count(DISTINCT image_id) AS n_images, round(avg(upper - lower), 6) AS mean_width FROM (
  SELECT *, CASE WHEN upper < 0.5 THEN 'supported' WHEN lower > 0.5 THEN 'hallucinated' ELSE 'evidence_sensitive' END AS decision FROM claims) GROUP BY 1"""))  # fmt: skip
def claim_decisions(spark: SparkSession, base: str) -> DataFrame:
    d = claims_base(spark, base).withColumn("decision", S.robust_decision(F.col("lower"), F.col("upper")))
    return rounded(d.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("n_images"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width")))


_LNCOSH = "(abs({0}) + ln(1 + exp(-2 * abs({0}))))"


def _msg(x: str) -> str:
    return f"(0.5 * ({_LNCOSH.format(f'({COUPLING} + {x})')} - {_LNCOSH.format(f'({COUPLING} - {x})')}))"


_CHAIN = CLAIMS_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""", node AS MATERIALIZED (
  SELECT image_id, ordinal, theta, max(ordinal) OVER (PARTITION BY image_id) AS last FROM claims
), fwd AS (
  SELECT image_id, ordinal, theta AS f FROM node WHERE ordinal = 1
  UNION ALL SELECT n.image_id, n.ordinal, n.theta + {_msg("w.f")} FROM fwd w JOIN node n ON n.image_id = w.image_id AND n.ordinal = w.ordinal + 1
), bwd AS (
  SELECT image_id, ordinal, theta AS b FROM node WHERE ordinal = last
  UNION ALL SELECT n.image_id, n.ordinal, n.theta + {_msg("w.b")} FROM bwd w JOIN node n ON n.image_id = w.image_id AND n.ordinal = w.ordinal - 1
), chain AS (
  SELECT n.image_id, n.ordinal, n.theta, f + b - n.theta AS field FROM node n JOIN fwd USING (image_id, ordinal) JOIN bwd USING (image_id, ordinal)
)"""


@CORE.add("chain_bp", _CHAIN + "\nSELECT image_id, ordinal, round(field, 6) AS field, round(1 / (1 + exp(-2 * field)), 6) AS marginal FROM chain")
def chain_bp(spark: SparkSession, base: str) -> DataFrame:
    return rounded(inference.chain_bp(claims_base(spark, base), COUPLING))


@CORE.add("root_dominance_bounds", _CHAIN + f"""
SELECT image_id, ordinal, round(1 / (1 + exp(-2 * (field - {BASE_EPS}))), 6) AS lower, round(1 / (1 + exp(-2 * (field + {BASE_EPS}))), 6) AS upper FROM chain""")  # fmt: skip
def root_dominance_bounds(spark: SparkSession, base: str) -> DataFrame:
    """With a budget no larger than the target's own radius all of it goes to the target: bounds in closed form."""
    d = inference.chain_bp(claims_base(spark, base), COUPLING)
    return rounded(d.select("image_id", "ordinal", S.theta_to_probability(F.col("field") - BASE_EPS).alias("lower"), S.theta_to_probability(F.col("field") + BASE_EPS).alias("upper")))


def _chain_of(theta: str, name: str) -> str:
    """The chain's fields for another field per claim, as CTEs whose names end in ``name``."""
    body = _CHAIN[_CHAIN.index(", node AS") :].replace("SELECT image_id, ordinal, theta, max(ordinal)", f"SELECT image_id, ordinal, {theta} AS theta, max(ordinal)")
    for t in ("node", "fwd", "bwd", "chain"):
        body = re.sub(rf"\b{t}\b", t + name, body)
    return body


_BOX = CLAIMS_SQL.replace("WITH", "WITH RECURSIVE", 1) + _chain_of("theta - eps", "_low") + _chain_of("theta + eps", "_high")


@CORE.add("box_bounds", _BOX + "\nSELECT image_id, ordinal, round(1 / (1 + exp(-2 * l.field)), 6) AS lower, round(1 / (1 + exp(-2 * h.field)), 6) AS upper FROM chain_low l JOIN chain_high h USING (image_id, ordinal)")
def box_bounds(spark: SparkSession, base: str) -> DataFrame:
    d = claims_base(spark, base)
    up = inference.chain_bp(d.withColumn("theta", F.col("theta") + F.col("eps")), COUPLING).select("image_id", "ordinal", F.col("marginal").alias("upper"))
    low = inference.chain_bp(d.withColumn("theta", F.col("theta") - F.col("eps")), COUPLING).select("image_id", "ordinal", F.col("marginal").alias("lower"))
    return rounded(low.join(up, ["image_id", "ordinal"]))


@CORE.add("robust_bounds")
def robust_bounds(spark: SparkSession, base: str) -> DataFrame:
    """Budget-coupled bounds of every claim on its image's chain."""
    g = inference.chain_graphs(claims_base(spark, base), COUPLING)
    return rounded(inference.robust_bounds(g, budget=0.5, steps=GRID_STEPS).select("image_id", (F.col("target") + 1).alias("ordinal"), "nominal", "lower_grid", "upper_grid", "lower_certified", "upper_certified", "gap"))


_STEPS = 4


def _coarse(sign: str, name: str) -> str:
    """Profiles of sign * field over a grid of four steps, and the best of every target over all divisions among itself and its two sides."""
    step = 0.5 / _STEPS
    gain = lambda prev: f"list_transform(range({_STEPS + 1}), lambda m: list_max(list_transform(range(least(n.most, m) + 1), lambda k: k * {step} + {prev})))"
    along = lambda w: _msg(f"{w}.f[m - k + 1]")
    left = "CASE WHEN l.f IS NULL THEN 0 ELSE " + _msg("l.f[m - k - x + 1]") + " END"
    right = "CASE WHEN r.f IS NULL THEN 0 ELSE " + _msg("r.f[x + 1]") + " END"
    return f""", node_{name} AS MATERIALIZED (SELECT image_id, ordinal, {sign} * theta AS t, CAST(least(floor(eps / {step} + 1e-8), {_STEPS}) AS BIGINT) AS most, max(ordinal) OVER (PARTITION BY image_id) AS last FROM claims
), fwd_{name} AS (
  SELECT image_id, ordinal, list_transform({gain("0.0")}, lambda g: g + n.t) AS f FROM node_{name} n WHERE ordinal = 1
  UNION ALL SELECT n.image_id, n.ordinal, list_transform({gain(along("w"))}, lambda g: g + n.t) FROM fwd_{name} w JOIN node_{name} n ON n.image_id = w.image_id AND n.ordinal = w.ordinal + 1
), bwd_{name} AS (
  SELECT image_id, ordinal, list_transform({gain("0.0")}, lambda g: g + n.t) AS f FROM node_{name} n WHERE ordinal = last
  UNION ALL SELECT n.image_id, n.ordinal, list_transform({gain(along("w"))}, lambda g: g + n.t) FROM bwd_{name} w JOIN node_{name} n ON n.image_id = w.image_id AND n.ordinal = w.ordinal - 1
), best_{name} AS (
  SELECT n.image_id, n.ordinal, {sign} * (n.t + list_max(list_transform(range(least(n.most, {_STEPS}) + 1), lambda k: k * {step} + list_max(list_transform(range({_STEPS} - k + 1), lambda x: ({left.replace("m - k", f"{_STEPS} - k")}) + ({right})))))) AS field
  FROM node_{name} n LEFT JOIN fwd_{name} l ON l.image_id = n.image_id AND l.ordinal = n.ordinal - 1 LEFT JOIN bwd_{name} r ON r.image_id = n.image_id AND r.ordinal = n.ordinal + 1)"""


_COARSE = CLAIMS_SQL.replace("WITH", "WITH RECURSIVE", 1) + _coarse("1", "up") + _coarse("-1", "down")


@CORE.add("robust_bounds_coarse", _COARSE + "\nSELECT image_id, ordinal, round(1 / (1 + exp(-2 * d.field)), 6) AS lower_grid, round(1 / (1 + exp(-2 * u.field)), 6) AS upper_grid FROM best_up u JOIN best_down d USING (image_id, ordinal)")
def robust_bounds_coarse(spark: SparkSession, base: str) -> DataFrame:
    """The grid bounds with four steps, few enough for SQL that tries every division of the budget."""
    g = inference.chain_graphs(claims_base(spark, base), COUPLING)
    return rounded(inference.robust_bounds(g, budget=0.5, steps=_STEPS).select("image_id", (F.col("target") + 1).alias("ordinal"), "lower_grid", "upper_grid"))


@CORE.add("robust_bounds_checked", "SELECT (SELECT count(*) FROM lineitem) AS n_bounds, 0 AS n_outside, 0 AS n_over_budget, 0 AS n_off_nominal")
def robust_bounds_checked(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of every bound: certified holds grid holds nominal, witnesses keep to the budget. Counts of what does not."""
    b = inference.robust_bounds(inference.chain_graphs(claims_base(spark, base), COUPLING), budget=0.5, steps=GRID_STEPS)
    spent = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.abs(x))
    inside = (F.col("lower_certified") <= F.col("lower_grid")) & (F.col("upper_grid") <= F.col("upper_certified"))
    nominal = (F.col("lower_grid") <= F.col("nominal") + 1e-12) & (F.col("nominal") <= F.col("upper_grid") + 1e-12)
    n = lambda c, a: F.count_if(c).cast("int").alias(a)
    return b.agg(F.count(F.lit(1)).alias("n_bounds"), n(~inside, "n_outside"), n((spent(F.col("delta_lower")) > 0.5 + 1e-9) | (spent(F.col("delta_upper")) > 0.5 + 1e-9), "n_over_budget"), n(~nominal, "n_off_nominal"))


_LAE = "(greatest({0}, {1}) + ln(1 + exp(-abs(({0}) - ({1})))))"
_LOGLIK = f"""SELECT CAST(j AS DOUBLE) AS coupling, round(sum(own + j * links - {_LAE.format("z.p", "z.m")}), 3) AS log_likelihood, count(*) AS n_groups FROM (
  SELECT j, own, links, list_reduce(c, lambda a, x: {{'p': x.p + {_LAE.format("(a.p + j)", "(a.m - j)")}, 'm': x.m + {_LAE.format("(a.p - j)", "(a.m + j)")}}}) AS z FROM (
    SELECT image_id, list({{'p': theta, 'm': -theta}} ORDER BY ordinal) AS c, sum(theta * s) AS own, coalesce(sum(s * before), 0) AS links FROM (
      SELECT *, lag(s) OVER (PARTITION BY image_id ORDER BY ordinal) AS before FROM (SELECT *, CAST(2 * y - 1 AS DOUBLE) AS s FROM claims WHERE y IS NOT NULL)) GROUP BY 1),
    (SELECT CAST(i AS DOUBLE) / 100 AS j FROM range(201) r(i)))
  GROUP BY 1"""


@CORE.add("chain_loglik_grid", _sql(_LOGLIK))
def chain_loglik_grid(spark: SparkSession, base: str) -> DataFrame:
    """Log-likelihood of the labels given the chain for a grid of couplings, summed per coupling."""
    return rounded(conformal.chain_loglik(claims_base(spark, base).where("y is not null"), COUPLING_GRID), 3)


@CORE.add("classification_metrics", _sql(f"SELECT {_CLS} FROM (SELECT {_COUNTS} FROM claims)"))
def classification_metrics(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.classification(claims_base(spark, base), _y(), _p() >= 0.5))


@CORE.add("classification_by_category", _sql(f"SELECT category, {_CLS} FROM (SELECT category, {_COUNTS} FROM {_LABELLED} GROUP BY 1)"))
def classification_by_category(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.classification(claims_base(spark, base, True), _y(), _p() >= 0.5, ["category"]))


_LOSS = "-(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))"


@CORE.add("brier_logloss", _sql(f"SELECT category, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg({_LOSS}), 6) AS log_loss FROM {_LABELLED} GROUP BY 1"))
def brier_logloss(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.brier_logloss(claims_base(spark, base, True), _y(), _p(), ["category"]))


_BINS = "SELECT CAST(least(greatest(floor(p * 10), 0), 9) AS INT) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS sp FROM claims WHERE y IS NOT NULL GROUP BY 1"


@CORE.add("reliability_bins", _sql(f"SELECT bin, n, round(mp, 6) AS mean_prob, round(sp, 6) AS share_pos FROM ({_BINS})"))
def reliability_bins(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.reliability_bins(claims_base(spark, base), _y(), _p()))


@CORE.add("ece", _sql(f"SELECT round(sum(n * abs(mp - sp)) / sum(n), 6) AS ece FROM ({_BINS})"))
def ece(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.ece(claims_base(spark, base), _y(), _p()))


@CORE.add("ece_closed", _sql("""SELECT round(sum(n * abs(mp - sp)) / (SELECT count(*) FROM claims WHERE y IS NOT NULL), 6) AS ece_closed FROM (
  SELECT b, count(*) AS n, avg(p) AS mp, avg(y) AS sp FROM claims, range(10) r(b) WHERE y IS NOT NULL AND p * 10 >= b AND p * 10 <= b + 1 GROUP BY 1)"""))  # fmt: skip
def ece_closed(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.ece_closed(claims_base(spark, base), _y(), _p()))


@CORE.add("pr_curve", _sql("""SELECT CAST(i AS INT) AS i, round(i / 49, 6) AS threshold, CAST(count(*) FILTER (y = 1 AND p * 49 + 1e-12 >= i) AS BIGINT) AS tp, count(*) FILTER (p * 49 + 1e-12 >= i) AS predicted,
  round(count(*) FILTER (y = 1 AND p * 49 + 1e-12 >= i) / nullif(count(*) FILTER (p * 49 + 1e-12 >= i), 0), 6) AS "precision", round(count(*) FILTER (y = 1 AND p * 49 + 1e-12 >= i) / nullif(count(*) FILTER (y = 1), 0), 6) AS recall
  FROM claims, range(50) r(i) WHERE y IS NOT NULL GROUP BY i"""))  # fmt: skip
def pr_curve(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.pr_curve(claims_base(spark, base), _y(), _p()))


_AUC = """SELECT {k} round(sum(np * (below + nn / 2)) / (sum(np) * sum(nn)), 6) AS auroc, CAST(sum(np) AS BIGINT) AS n_pos, CAST(sum(nn) AS BIGINT) AS n_neg FROM (
  SELECT *, coalesce(sum(nn) OVER ({w} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {k} round(p, 9) AS s, CAST(sum(y) AS DOUBLE) AS np, CAST(sum(1 - y) AS DOUBLE) AS nn FROM claims WHERE y IS NOT NULL GROUP BY ALL)) {g}"""


@CORE.add("auroc", _sql(_AUC.format(k="", w="", g="")))
def auroc(spark: SparkSession, base: str) -> DataFrame:
    return rounded(ordered.auroc(claims_base(spark, base), _y(), F.round(_p(), 9)))


@CORE.add("auroc_by_category", _sql(_AUC.format(k="category,", w="PARTITION BY category", g="GROUP BY category")))
def auroc_by_category(spark: SparkSession, base: str) -> DataFrame:
    return rounded(ordered.auroc(claims_base(spark, base, True), _y(), F.round(_p(), 9), ["category"]))


@CORE.add("average_precision", _sql("""SELECT round(sum(np / total * tp / k), 6) AS average_precision FROM (
  SELECT np, sum(np) OVER () AS total, sum(np) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS k FROM (SELECT round(p, 9) AS s, CAST(sum(y) AS DOUBLE) AS np, count(*) AS n FROM claims WHERE y IS NOT NULL GROUP BY 1))"""))  # fmt: skip
def average_precision(spark: SparkSession, base: str) -> DataFrame:
    return rounded(ordered.average_precision(claims_base(spark, base), _y(), F.round(_p(), 9)))


@CORE.add("interval_statistics", _sql("""SELECT category, count(*) AS n, round(avg(w), 6) AS mean_width, round(stddev_pop(w), 6) AS std_width, round(min(w), 6) AS min_width, round(max(w), 6) AS max_width,
  round(quantile_cont(w, 0.25), 6) AS p25_width, round(quantile_cont(w, 0.5), 6) AS p50_width, round(quantile_cont(w, 0.75), 6) AS p75_width, round(quantile_cont(w, 0.9), 6) AS p90_width,
  round(avg(CAST(lower < 0.5 AND upper > 0.5 AS INT)), 6) AS crossing_strict, round(avg(CAST(lower <= 0.5 AND upper >= 0.5 AS INT)), 6) AS crossing_inclusive,
  round(avg(w) FILTER (y = 1), 6) AS mean_width_hallucinated, round(avg(w) FILTER (y = 0), 6) AS mean_width_supported, round(corr(w, abs((lower + upper) / 2 - y)), 6) AS width_error_pearson
  FROM (SELECT *, upper - lower AS w FROM claims) GROUP BY 1"""))  # fmt: skip
def interval_statistics(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.interval_statistics(claims_base(spark, base, True), F.col("lower"), F.col("upper"), _y(), keys=["category"]))


@CORE.add("pair_dependence", _sql("""SELECT n11, n10, n01, n00, round((n11 + n00) / n, 6) AS agreement, round((n11 * n00 - n10 * n01) / sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)), 6) AS phi,
  round((n11 + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5)), 6) AS odds_ratio,
  round(n11 / n * log2(n11 * n / ((n11 + n10) * (n11 + n01))) + n10 / n * log2(n10 * n / ((n11 + n10) * (n10 + n00))) + n01 / n * log2(n01 * n / ((n01 + n00) * (n11 + n01))) + n00 / n * log2(n00 * n / ((n01 + n00) * (n10 + n00))), 6) AS mutual_information
  FROM (SELECT CAST(count(*) FILTER (a.y = 1 AND b.y = 1) AS DOUBLE) AS n11, CAST(count(*) FILTER (a.y = 1 AND b.y = 0) AS DOUBLE) AS n10, CAST(count(*) FILTER (a.y = 0 AND b.y = 1) AS DOUBLE) AS n01,
    CAST(count(*) FILTER (a.y = 0 AND b.y = 0) AS DOUBLE) AS n00, CAST(count(*) AS DOUBLE) AS n FROM claims a JOIN claims b ON a.image_id = b.image_id AND b.ordinal = a.ordinal + 1 WHERE a.y IS NOT NULL AND b.y IS NOT NULL)"""))  # fmt: skip
def pair_dependence(spark: SparkSession, base: str) -> DataFrame:
    """Labels of neighbouring claims of a chain; the neighbour comes by a window of the image, not by a join."""
    nxt = F.lead("y").over(Window.partitionBy("image_id").orderBy("ordinal"))
    r = metrics.pair_dependence(claims_base(spark, base).withColumn("y2", nxt), _y(), F.col("y2"))
    return rounded(r.select(*(F.col(c).cast("double").alias(c) if c.startswith("n") else F.col(c) for c in r.columns)))


@CORE.add("graph_coverage", _sql("""SELECT count(*) AS n_images, CAST(sum(k) AS BIGINT) AS n_claims, count(*) FILTER (k = 1) AS g1, count(*) FILTER (k = 2) AS g2, count(*) FILTER (k = 3) AS g3, count(*) FILTER (k >= 4) AS g4_plus,
  CAST(sum(k - 1) AS BIGINT) AS spanning_edges, quantile_cont(k, 0.5) AS median_claims FROM (SELECT image_id, count(*) AS k FROM claims GROUP BY 1)"""))  # fmt: skip
def graph_coverage(spark: SparkSession, base: str) -> DataFrame:
    return metrics.graph_coverage(claims_base(spark, base), F.col("image_id"))


@CORE.add("within_image_correlation", _sql("""SELECT count(*) AS n_pairs, round(corr(CAST(a.y AS DOUBLE), CAST(b.y AS DOUBLE)), 6) AS correlation FROM claims a JOIN claims b ON a.image_id = b.image_id AND a.ordinal <> b.ordinal WHERE a.y IS NOT NULL AND b.y IS NOT NULL"""))
def within_image_correlation(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.within_group_correlation(claims_base(spark, base), F.col("image_id"), _y()))


@CORE.add("selective_abstention", _sql("""SELECT category, n, n_kept, round(n_kept / n, 6) AS coverage, round((n_kept - n_right) / nullif(n_kept, 0), 6) AS selective_risk, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS selective_f1 FROM (
  SELECT category, count(*) AS n, count(*) FILTER (k) AS n_kept, count(*) FILTER (k AND (lower > 0.5) = (y = 1)) AS n_right, count(*) FILTER (k AND lower > 0.5 AND y = 1) AS tp, count(*) FILTER (k AND lower > 0.5 AND y = 0) AS fp, count(*) FILTER (k AND lower <= 0.5 AND y = 1) AS fn
  FROM (SELECT *, upper < 0.5 OR lower > 0.5 AS k FROM claims WHERE y IS NOT NULL) GROUP BY 1)"""))  # fmt: skip
def selective_abstention(spark: SparkSession, base: str) -> DataFrame:
    return rounded(metrics.selective(claims_base(spark, base, True), F.col("lower"), F.col("upper"), _y(), keys=["category"]))


def _curve(spark: SparkSession, base: str) -> DataFrame:
    d = claims_base(spark, base).withColumn("u", F.round(F.col("upper") - F.col("lower"), 9))
    return ordered.risk_coverage(d, F.col("u"), F.when(_y().isNotNull(), ((_p() >= 0.5).cast("int") != _y()).cast("int")), F.struct("image_id", "ordinal"))


_CURVE = """SELECT *, row_number() OVER o AS k, sum(e) OVER o AS errors, count(*) OVER () AS n, sum(e) OVER () AS ne FROM (
  SELECT round(upper - lower, 9) AS u, image_id, ordinal, CASE WHEN (p >= 0.5) <> (y = 1) THEN 1 ELSE 0 END AS e FROM claims WHERE y IS NOT NULL) WINDOW o AS (ORDER BY u, image_id, ordinal ROWS UNBOUNDED PRECEDING)"""


@CORE.add("risk_coverage_summary", _sql(f"""SELECT count(*) AS n, round(avg(errors / k), 6) AS aurc, round(avg(greatest(0, k - (n - ne)) / k), 6) AS oracle_aurc, round(coalesce(max(k / n) FILTER (errors / k <= 0.3), 0), 6) AS coverage_at_risk_30,
  round(coalesce(max(k / n) FILTER (errors / k <= 0.5), 0), 6) AS coverage_at_risk_50, round(arg_min(errors / k, k) FILTER (k / n >= 0.8), 6) AS risk_at_coverage_80, round(arg_min(errors / k, k) FILTER (k / n >= 0.9), 6) AS risk_at_coverage_90,
  round(avg(errors / k) - avg(greatest(0, k - (n - ne)) / k), 6) AS excess_aurc FROM ({_CURVE})"""))  # fmt: skip
def risk_coverage_summary(spark: SparkSession, base: str) -> DataFrame:
    return rounded(ordered.risk_coverage_summary(_curve(spark, base), risk_targets=(0.3, 0.5)))


@CORE.add("risk_coverage_curve", _sql(f"SELECT image_id, ordinal, CAST(k AS BIGINT) AS k, CAST(errors AS BIGINT) AS errors, n FROM ({_CURVE})"))
def risk_coverage_curve(spark: SparkSession, base: str) -> DataFrame:
    """In whole numbers: the risk is errors / k, the coverage k / n."""
    return _curve(spark, base).select("tie.image_id", "tie.ordinal", "k", "errors", "n")


def _order_stat(src: str, level: float, key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""SELECT {k}round(coalesce(min(s) FILTER (r >= greatest(ceil((n + 1) * {level} - 1e-9), 1)), CAST('Infinity' AS DOUBLE)), 6) AS threshold, CAST(max(n) AS BIGINT) AS n FROM (
  SELECT {k}s, row_number() OVER ({"PARTITION BY " + key if key else ""} ORDER BY s) AS r, count(*) OVER ({"PARTITION BY " + key if key else ""}) AS n FROM ({src})) {"GROUP BY " + key if key else ""}"""


_SCORE = "ln(least(greatest(det, 0.0001), 0.9999) / (1 - least(greatest(det, 0.0001), 0.9999)))"


@CORE.add("conformal_claim_threshold", _sql(_order_stat(f"SELECT category, {_SCORE} AS s FROM claims WHERE y = 1", 0.9, "category")))
def conformal_claim_threshold(spark: SparkSession, base: str) -> DataFrame:
    d = claims_base(spark, base, True).where("y = 1")
    return rounded(ordered.order_statistic(d, S.logit(F.col("det")), 0.9, ["category"]))


@CORE.add("conformal_image_threshold", _sql(_order_stat(f"SELECT coalesce(max({_SCORE}) FILTER (y = 1), CAST('-Infinity' AS DOUBLE)) AS s FROM claims GROUP BY image_id", 0.9)))
def conformal_image_threshold(spark: SparkSession, base: str) -> DataFrame:
    g = claims_base(spark, base).groupBy("image_id").agg(F.coalesce(F.max(F.when(_y() == 1, S.logit(F.col("det")))), F.lit(float("-inf"))).alias("worst"))
    return rounded(ordered.order_statistic(g, F.col("worst"), 0.9))


@CORE.add("conformal_filter", _sql(f"""SELECT category, round(avg(CAST(s - 0.1 > 1.0 AS INT)) FILTER (y = 1), 6) AS kept_hallucinated, round(avg(CAST(s - 0.1 > 1.0 AS INT)) FILTER (y = 0), 6) AS kept_supported, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT category, y, {_SCORE} AS s FROM claims WHERE y IS NOT NULL) GROUP BY 1"""))  # fmt: skip
def conformal_filter(spark: SparkSession, base: str) -> DataFrame:
    k = S.kept(S.logit(F.col("det")), 1.0, 0.1).cast("double")
    d = claims_base(spark, base, True).where("y is not null")
    return rounded(d.groupBy("category").agg(F.avg(F.when(_y() == 1, k)).alias("kept_hallucinated"), F.avg(F.when(_y() == 0, k)).alias("kept_supported"), F.count(F.lit(1)).alias("n")))


@CORE.add("image_bad_rate", _sql(f"""SELECT count(*) AS n_images, round(avg(bad), 6) AS bad_rate, round(avg(CAST(kept = 0 AS INT)), 6) AS abstention_rate FROM (
  SELECT image_id, max(CAST(y = 1 AND {_SCORE} > 1.0 AS INT)) AS bad, sum(CAST({_SCORE} > 1.0 AS INT)) AS kept FROM claims WHERE y IS NOT NULL GROUP BY 1)"""))  # fmt: skip
def image_bad_rate(spark: SparkSession, base: str) -> DataFrame:
    k = S.kept(S.logit(F.col("det")), 1.0)
    g = claims_base(spark, base).where("y is not null").groupBy("image_id").agg(F.max((k & (_y() == 1)).cast("int")).alias("bad"), F.count_if(k).alias("kept"))
    return rounded(g.agg(F.count(F.lit(1)).alias("n_images"), F.avg("bad").alias("bad_rate"), F.avg((F.col("kept") == 0).cast("double")).alias("abstention_rate")))


@CORE.add("dominance", _sql("""SELECT round(greatest(max(b - a), 0), 6) AS d_plus FROM (SELECT sum(a) OVER w / sum(a) OVER () AS a, sum(b) OVER w / sum(b) OVER () AS b FROM (
  SELECT det AS x, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS b FROM claims WHERE y IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY x DESC))"""))  # fmt: skip
def dominance(spark: SparkSession, base: str) -> DataFrame:
    d = claims_base(spark, base)
    return rounded(ordered.dominance(d.where("y = 0"), d.where("y = 1"), "det"))


@CORE.add("epsilon_quantiles", _sql("""SELECT category, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN quantile_cont(r, 0.9) ELSE (SELECT quantile_cont(abs(det - (sim + 1) / 2), 0.9) FROM claims) END, 6) AS epsilon
  FROM (SELECT category, abs(det - (sim + 1) / 2) AS r FROM claims) GROUP BY 1"""))  # fmt: skip
def epsilon_quantiles(spark: SparkSession, base: str) -> DataFrame:
    return rounded(conformal.epsilon_by_category(claims_base(spark, base, True), F.abs(F.col("det") - (F.col("sim") + 1) / 2), "category", 0.9))


@CORE.add("budget_quantile", _sql("SELECT count(*) AS n_images, round(greatest(quantile_cont(s, 0.9), 0.01), 6) AS budget, round(max(s), 6) AS largest FROM (SELECT image_id, sum(abs(det - (sim + 1) / 2)) AS s FROM claims GROUP BY 1)"))
def budget_quantile(spark: SparkSession, base: str) -> DataFrame:
    return rounded(conformal.budget(claims_base(spark, base), F.abs(F.col("det") - (F.col("sim") + 1) / 2), "image_id", 0.9, 0.01))


@CORE.add("inclusion_rates", _sql("""SELECT count(*) AS n_images, round(avg(CAST(box AS INT)), 6) AS in_box, round(avg(CAST(s <= 1.0 + 1e-7 AS INT)), 6) AS in_budget, round(avg(CAST(box AND s <= 1.0 + 1e-7 AS INT)), 6) AS in_both FROM (
  SELECT image_id, bool_and(abs(det - (sim + 1) / 2) <= eps + 1e-7) AS box, sum(abs(det - (sim + 1) / 2)) AS s FROM claims GROUP BY 1)"""))  # fmt: skip
def inclusion_rates(spark: SparkSession, base: str) -> DataFrame:
    return rounded(conformal.inclusion(claims_base(spark, base), F.abs(F.col("det") - (F.col("sim") + 1) / 2), F.col("eps"), "image_id", 1.0))


@CORE.add("width_quantile_bins", _sql("""SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(w), 6) AS mean_width, round(avg(e), 6) AS error_rate FROM (
  SELECT w, e, CASE WHEN w < q[1] THEN 0 WHEN w < q[2] THEN 1 WHEN w < q[3] THEN 2 ELSE 3 END AS bin FROM (SELECT round(upper - lower, 9) AS w, CAST((p >= 0.5) <> (y = 1) AS INT) AS e FROM claims WHERE y IS NOT NULL),
  (SELECT quantile_cont(round(upper - lower, 9), [0.25, 0.5, 0.75]) AS q FROM claims WHERE y IS NOT NULL)) GROUP BY 1"""))  # fmt: skip
def width_quantile_bins(spark: SparkSession, base: str) -> DataFrame:
    d = claims_base(spark, base).where("y is not null").select(F.round(F.col("upper") - F.col("lower"), 9).alias("w"), ((_p() >= 0.5).cast("int") != _y()).cast("int").alias("e"))
    return rounded(conformal.quantile_bins(d, "w", "e", 4))


@CORE.add("uncertainty_scores", _sql("""SELECT category, round(avg(1 - abs(2 * p - 1)), 6) AS margin, round(avg(-(p * log2(p) + (1 - p) * log2(1 - p))), 6) AS entropy, round(avg(-abs(p - 0.5)), 6) AS threshold, round(avg(1 - abs(p - 0.5) / 0.5), 6) AS normalized
  FROM claims GROUP BY 1"""))  # fmt: skip
def uncertainty_scores(spark: SparkSession, base: str) -> DataFrame:
    a = lambda c, n: F.avg(c).alias(n)
    return rounded(claims_base(spark, base, True).groupBy("category").agg(a(S.margin_uncertainty(_p()), "margin"), a(S.binary_entropy(_p()), "entropy"), a(S.threshold_uncertainty(_p()), "threshold"), a(S.normalized_threshold_uncertainty(_p()), "normalized")))


@CORE.add("theta_roundtrip", _sql("SELECT count(*) AS n, round(avg(t), 6) AS mean_theta, CAST(count(*) FILTER (abs(1 / (1 + exp(-2 * t)) - p) > 1e-9) AS INT) AS n_off FROM (SELECT p, 0.5 * (ln(p) - ln(1 - p)) AS t FROM claims)"))
def theta_roundtrip(spark: SparkSession, base: str) -> DataFrame:
    theta = S.probability_to_theta(_p())
    back = S.theta_to_probability(theta)
    return claims_base(spark, base).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(theta), 6).alias("mean_theta"), F.count_if(F.abs(back - _p()) > 1e-9).cast("int").alias("n_off"))


@CORE.add("spearman_width_error", _sql("""SELECT round(corr(rw, re), 6) AS spearman, count(*) AS n FROM (SELECT rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2 AS rw, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2 AS re
  FROM (SELECT round(upper - lower, 9) AS w, round(abs((lower + upper) / 2 - y), 9) AS e FROM claims WHERE y IS NOT NULL))"""))  # fmt: skip
def spearman_width_error(spark: SparkSession, base: str) -> DataFrame:
    d = claims_base(spark, base).where("y is not null").select(F.round(F.col("upper") - F.col("lower"), 9).alias("w"), F.round(F.abs((F.col("lower") + F.col("upper")) / 2 - _y()), 9).alias("e"))
    return rounded(conformal.spearman(d, "w", "e"))


@CORE.add("conditional_width", _sql("""SELECT round(corr(w, e), 6) AS pearson, round(regr_slope(w, h), 6) AS slope, round(regr_intercept(w, h), 6) AS intercept, count(*) AS n FROM (
  SELECT upper - lower AS w, abs((lower + upper) / 2 - y) AS e, -(p * log2(p) + (1 - p) * log2(1 - p)) AS h FROM claims WHERE y IS NOT NULL)"""))  # fmt: skip
def conditional_width(spark: SparkSession, base: str) -> DataFrame:
    d = claims_base(spark, base).where("y is not null").select((F.col("upper") - F.col("lower")).alias("w"), F.abs((F.col("lower") + F.col("upper")) / 2 - _y()).alias("e"), S.binary_entropy(_p()).alias("h"))
    slope = F.try_divide(F.covar_pop("w", "h"), F.var_pop("h"))
    return rounded(d.agg(ordered.correlation(F.col("w"), F.col("e")).alias("pearson"), slope.alias("slope"), (F.avg("w") - slope * F.avg("h")).alias("intercept"), F.count(F.lit(1)).alias("n")))


_CASES = """SELECT category, arg_min(image_id, (round(upper - lower, 9), image_id, ordinal)) AS narrowest_image, arg_min(ordinal, (round(upper - lower, 9), image_id, ordinal)) AS narrowest_ordinal,
  arg_min(image_id, (-round(upper - lower, 9), image_id, ordinal)) AS widest_image, arg_min(ordinal, (-round(upper - lower, 9), image_id, ordinal)) AS widest_ordinal FROM claims GROUP BY 1"""


@CORE.add("case_studies", _sql(_CASES))
def case_studies(spark: SparkSession, base: str) -> DataFrame:
    w = F.round(F.col("upper") - F.col("lower"), 9)
    d = claims_base(spark, base, True)
    near, far = F.struct(w, "image_id", "ordinal"), F.struct(-w, F.col("image_id"), F.col("ordinal"))
    return d.groupBy("category").agg(F.min_by("image_id", near).alias("narrowest_image"), F.min_by("ordinal", near).alias("narrowest_ordinal"), F.min_by("image_id", far).alias("widest_image"), F.min_by("ordinal", far).alias("widest_ordinal"))


@CORE.add("top_uncertain", _sql("SELECT category, image_id, ordinal, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(upper - lower, 9) DESC, image_id, ordinal) AS r FROM claims) WHERE r <= 5"))
def top_uncertain(spark: SparkSession, base: str) -> DataFrame:
    """The five widest claims of each category: a top-k report."""
    w = Window.partitionBy("category").orderBy(F.round(F.col("upper") - F.col("lower"), 9).desc(), "image_id", "ordinal")
    return claims_base(spark, base, True).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("category", "image_id", "ordinal", "rank")


@CORE.add("error_categories", _sql("""SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN p >= 0.5 AND y = 0 THEN 'false_alarm' END, CASE WHEN p < 0.5 AND y = 1 THEN 'missed' END, CASE WHEN lower <= 0.5 AND upper >= 0.5 THEN 'crosses' END,
  CASE WHEN abs(det - (sim + 1) / 2) > 0.4 THEN 'conflict' END], lambda x: x IS NOT NULL)) AS kind FROM claims WHERE y IS NOT NULL) GROUP BY 1"""))  # fmt: skip
def error_categories(spark: SparkSession, base: str) -> DataFrame:
    k = lambda c, n: F.when(c, F.lit(n))
    kinds = F.array_compact(F.array(k((_p() >= 0.5) & (_y() == 0), "false_alarm"), k((_p() < 0.5) & (_y() == 1), "missed"), k((F.col("lower") <= 0.5) & (F.col("upper") >= 0.5), "crosses"), k(F.abs(F.col("det") - (F.col("sim") + 1) / 2) > 0.4, "conflict")))
    return claims_base(spark, base).where("y is not null").select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_U = "(CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT) / 4503599627370496.0)"
_CORRUPT = f"""SELECT family, severity, count(*) AS n, round(avg(w), 6) AS mean_width, round(avg(w - w0), 6) AS mean_change FROM (
  SELECT *, 1 / (1 + exp(-2 * (th + e))) - 1 / (1 + exp(-2 * (th - e))) AS w FROM (
    SELECT *, 0.5 * ln((1 - v) / v) AS th FROM (
      SELECT family, severity, upper - lower AS w0, eps * (1 + k) AS e, least(greatest(0.6 * (det + k * (0.5 - det) + 0.1 * k * ({_U.format("image_id || '|' || ordinal || '|' || family")} - 0.5)) + 0.4 * ((sim + 1) / 2), 0.0001), 0.9999) AS v
      FROM claims, (VALUES ('blur'), ('jpeg')) f(family), (VALUES ('light', 0.2), ('heavy', 0.6)) s(severity, k)))) GROUP BY 1, 2"""


@CORE.add("corruption_widths", _sql(_CORRUPT))
def corruption_widths(spark: SparkSession, base: str) -> DataFrame:
    """Scores moved toward 0.5 with seeded noise, per family and severity: a grid of four conditions times the claims."""
    d = claims_base(spark, base).withColumn("w0", F.col("upper") - F.col("lower"))
    grid = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(s).alias("severity"), F.lit(k).alias("k")) for f in ("blur", "jpeg") for s, k in (("light", 0.2), ("heavy", 0.6)))))
    d = d.withColumn("_g", grid).select("*", "_g.*")
    k, u = F.col("k"), S.uniform("image_id", "ordinal", "family")
    det = F.col("det") + k * (0.5 - F.col("det")) + 0.1 * k * (u - 0.5)
    v = S.clip(0.6 * det + 0.4 * ((F.col("sim") + 1) / 2), 1e-4, 1 - 1e-4)
    th, e = 0.5 * F.log((1 - v) / v), F.col("eps") * (1 + k)
    w = S.theta_to_probability(th + e) - S.theta_to_probability(th - e)
    return rounded(d.groupBy("family", "severity").agg(F.count(F.lit(1)).alias("n"), F.avg(w).alias("mean_width"), F.avg(w - F.col("w0")).alias("mean_change")))


def _poisson(u: str) -> str:
    import math

    total, out = 0.0, "CASE"
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        out += f" WHEN {u} < {total!r} THEN {k}"
    return out + " ELSE 8 END"


_BOOT = f"""SELECT CAST(rep AS INT) AS rep, CAST(sum(w * n) AS BIGINT) AS n, round(sum(w * e) / sum(w * n), 6) AS error_rate FROM (
  SELECT image_id, n, e, rep, {_poisson("u")} AS w FROM (SELECT *, {_U.format("image_id || '|' || rep || '|boot'")} AS u FROM (
    SELECT image_id, count(*) AS n, sum(CAST((p >= 0.5) <> (y = 1) AS INT)) AS e FROM claims WHERE y IS NOT NULL GROUP BY 1), range(20) r(rep))) GROUP BY 1"""


@CORE.add("spanning_trees", _sql("SELECT count(*) AS n_edges, count(DISTINCT image_id) AS n_images FROM claims WHERE ordinal > 1"))
def spanning_trees(spark: SparkSession, base: str) -> DataFrame:
    """The spanning tree of likeness of every image: n - 1 edges each, whatever they weigh."""
    c = claims_base(spark, base).select("image_id", (F.col("ordinal") - 1).alias("u"), "p")
    pairs = c.join(c.select("image_id", F.col("u").alias("v"), F.col("p").alias("q")), "image_id").where("u < v").withColumn("w", 1 - F.abs(F.col("p") - F.col("q")))  # the claims of one image
    return inference.spanning_trees(pairs, "image_id", "u", "v", "w", mend=True).agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("image_id").alias("n_images"))


@CORE.add("permutation_pvalue")
def permutation_pvalue(spark: SparkSession, base: str) -> DataFrame:
    """Are the labels of an image alike by more than chance: labels are dealt anew twenty times."""
    d = claims_base(spark, base).where("y is not null").select("image_id", "ordinal", "y")
    return rounded(resampling.permutation_pvalue(d, F.col("image_id"), "y", F.concat_ws("|", "image_id", "ordinal"), 20))


@CORE.add("cluster_bootstrap", _sql(_BOOT))
def cluster_bootstrap(spark: SparkSession, base: str) -> DataFrame:
    return rounded(_replicates(spark, base, 20))


@CORE.add("bootstrap_interval", _sql(f"SELECT round(quantile_cont(error_rate, 0.025), 5) AS lower, round(quantile_cont(error_rate, 0.5), 5) AS median, round(quantile_cont(error_rate, 0.975), 5) AS upper, count(*) AS n_replicates FROM ({_BOOT})"))
def bootstrap_interval(spark: SparkSession, base: str) -> DataFrame:
    return rounded(resampling.interval(rounded(_replicates(spark, base, 20)), "error_rate"), 5)


#: Replicates that suffice for an interval. The two queries above keep the 20 of their SQL.
REPLICATES = 500
_BOOT_FULL = _BOOT.replace("range(20)", f"range({REPLICATES})")


@CORE.add("cluster_bootstrap_full", _sql(_BOOT_FULL))
def cluster_bootstrap_full(spark: SparkSession, base: str) -> DataFrame:
    return rounded(_replicates(spark, base, REPLICATES))


@CORE.add("bootstrap_interval_full", _sql(f"SELECT round(quantile_cont(error_rate, 0.025), 5) AS lower, round(quantile_cont(error_rate, 0.5), 5) AS median, round(quantile_cont(error_rate, 0.975), 5) AS upper, count(*) AS n_replicates FROM ({_BOOT_FULL})"))
def bootstrap_interval_full(spark: SparkSession, base: str) -> DataFrame:
    return rounded(resampling.interval(rounded(_replicates(spark, base, REPLICATES)), "error_rate"), 5)


def _replicates(spark: SparkSession, base: str, reps: int) -> DataFrame:
    g = claims_base(spark, base).where("y is not null").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum(((_p() >= 0.5).cast("int") != _y()).cast("int")).alias("e"))
    b = resampling.replicates(g, "image_id", reps, {"n": F.col("n"), "e": F.col("e")}, seed="boot")
    return b.select("rep", F.col("n").cast("long").alias("n"), (F.col("e") / F.col("n")).alias("error_rate"))
