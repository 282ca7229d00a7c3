"""The method ladder, reliability, shift and table queries over the claims derived from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verispan.functions import scalar as S
from verispan.operators import fits, inference, ladder, metrics, reliability, shift
from verispan.plans.claim_queries import _CHAIN, _U, _chain_of, _msg, _poisson, _sql
from verispan.plans.claims import BASE_EPS, CLAIMS_SQL, COUPLING, claims_base, rounded
from verispan.plans.registry import CORE

_RECURSIVE = CLAIMS_SQL.replace("WITH", "WITH RECURSIVE", 1)
_BUDGET = BASE_EPS
_SIG = "1 / (1 + exp(-2 * ({0})))"
# with a budget no larger than any radius all of it goes to the target itself
_LADDER = _RECURSIVE + _CHAIN[_CHAIN.index(", node AS") :] + _chain_of("theta - eps", "_low") + _chain_of("theta + eps", "_high") + f""", rungs AS (
  SELECT c.image_id, c.ordinal, y, method, posterior, r.lower, r.upper FROM (SELECT c.*, k.field, {_SIG.format("k.field")} AS belief, {_SIG.format("l.field")} AS box_low, {_SIG.format("h.field")} AS box_high
    FROM claims c JOIN chain k USING (image_id, ordinal) JOIN chain_low l USING (image_id, ordinal) JOIN chain_high h USING (image_id, ordinal)) c,
  LATERAL (VALUES ('M0_detector', least(greatest(1 - det, 0.001), 0.999), NULL, NULL), ('M1_similarity', least(greatest(1 - (sim + 1) / 2, 0.001), 0.999), NULL, NULL), ('M2_fusion', p, NULL, NULL), ('M3_unary', {_SIG.format("theta")}, NULL, NULL),
    ('M4_belief', belief, NULL, NULL), ('M5_box', belief, box_low, box_high), ('M6_budget', belief, {_SIG.format(f"field - {_BUDGET}")}, {_SIG.format(f"field + {_BUDGET}")})) r(method, posterior, lower, upper)
), summary AS (
  SELECT method, count(*) AS n_claims, count(DISTINCT image_id) AS n_images, count(*) FILTER (y = 1 AND posterior >= 0.5) AS tp, count(*) FILTER (y = 0 AND posterior >= 0.5) AS fp, count(*) FILTER (y = 0 AND posterior < 0.5) AS tn, count(*) FILTER (y = 1 AND posterior < 0.5) AS fn,
    avg((posterior - y) * (posterior - y)) AS brier, avg(upper - lower) AS mean_width, count(*) FILTER (lower < 0.5 AND upper > 0.5) / count(*) AS crossing_rate FROM rungs GROUP BY 1
), rated AS (
  SELECT method, n_claims, n_images, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, brier, mean_width, crossing_rate FROM summary
)"""


def _rungs(spark: SparkSession, base: str) -> DataFrame:
    return ladder.ladder(claims_base(spark, base), COUPLING, _BUDGET)


@CORE.add("method_ladder", _LADDER + """ SELECT method, n_claims, n_images, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(brier, 6) AS brier, round(mean_width, 6) AS mean_width, round(crossing_rate, 6) AS crossing_rate FROM rated""")
def method_ladder(spark: SparkSession, base: str) -> DataFrame:
    return rounded(ladder.method_summary(_rungs(spark, base)))


@CORE.add("rung_gains", _LADDER + """ SELECT * FROM (SELECT method, lag(method) OVER o AS against, round(accuracy - lag(accuracy) OVER o, 6) + 0 AS gain_accuracy, round(f1 - lag(f1) OVER o, 6) + 0 AS gain_f1, round(brier - lag(brier) OVER o, 6) + 0 AS gain_brier FROM rated WINDOW o AS (ORDER BY method)) WHERE against IS NOT NULL""")
def rung_gains(spark: SparkSession, base: str) -> DataFrame:
    g = rounded(ladder.rung_gains(ladder.method_summary(_rungs(spark, base))))
    return g.select("method", "against", *((F.col(c) + F.lit(0.0)).alias(c) for c in g.columns[2:]))  # no negative zeros


_BUDGETS = (0.0, 0.05, 0.1, 0.15, 0.2)


@CORE.add("bounds_by_budget", _CHAIN + f" SELECT image_id, ordinal, budget, round({_SIG.format('field - budget')}, 6) AS lower, round({_SIG.format('field + budget')}, 6) AS upper FROM chain, (SELECT unnest([{', '.join(f'CAST({b} AS DOUBLE)' for b in _BUDGETS)}]) AS budget)")
def bounds_by_budget(spark: SparkSession, base: str) -> DataFrame:
    """The bounds of every claim as its budget grows."""
    return rounded(ladder.by_budget(claims_base(spark, base), COUPLING, _BUDGETS))


_STAR = f"""SELECT image_id, ordinal, round(field, 6) AS field, round({_SIG.format("field")}, 6) AS marginal FROM (
  SELECT image_id, ordinal, CASE WHEN ordinal = 1 THEN centre ELSE theta + {_msg("(centre - m)")} END AS field FROM (
    SELECT *, max(CASE WHEN ordinal = 1 THEN theta END) OVER w + sum(m) OVER w AS centre FROM (SELECT image_id, ordinal, theta, CASE WHEN ordinal = 1 THEN 0 ELSE {_msg("theta")} END AS m FROM claims) WINDOW w AS (PARTITION BY image_id)))"""


@CORE.add("star_bp", _sql(_STAR))
def star_bp(spark: SparkSession, base: str) -> DataFrame:
    """Belief propagation on a star around the first claim."""
    return rounded(inference.star_bp(claims_base(spark, base), COUPLING))


@CORE.add("topologies", _CHAIN + f""", star AS (SELECT image_id, ordinal, field FROM ({_STAR.replace("round(field, 6) AS field, round(" + _SIG.format("field") + ", 6) AS marginal", "field")})),
 t AS (SELECT image_id, ordinal, 'none' AS topology, theta AS field FROM claims UNION ALL SELECT image_id, ordinal, 'chain', field FROM chain UNION ALL SELECT image_id, ordinal, 'star', field FROM star)
 SELECT topology, count(*) AS n, round(avg(CAST((field >= 0) = (y = 1) AS INT)), 6) AS accuracy, round(avg(({_SIG.format("field")} - y) * ({_SIG.format("field")} - y)), 6) AS brier FROM t JOIN claims USING (image_id, ordinal) WHERE y IS NOT NULL GROUP BY 1""")  # fmt: skip
def topologies(spark: SparkSession, base: str) -> DataFrame:
    """Accuracy and Brier score without a graph, on chains and on stars."""
    c = claims_base(spark, base)
    y = c.where("y is not null").select("image_id", "ordinal", "y")
    t = c.select("image_id", "ordinal", F.lit("none").alias("topology"), F.col("theta").alias("field"))
    for name, f in (("chain", inference.chain_bp), ("star", inference.star_bp)):
        t = t.unionByName(f(c, COUPLING).select("image_id", "ordinal", F.lit(name).alias("topology"), "field"))
    p = S.theta_to_probability(F.col("field"))
    return rounded(t.join(y, ["image_id", "ordinal"]).groupBy("topology").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("field") >= 0) == (F.col("y") == 1)).cast("double")).alias("accuracy"), F.avg((p - F.col("y")) ** 2).alias("brier")))


_GRID = (0.0, 0.1, 0.3, 0.6)


@CORE.add("coupling_scores", _RECURSIVE + "".join(_chain_of("theta", f"_{i}").replace(f"({COUPLING} ", f"({g} ") for i, g in enumerate(_GRID)) + " SELECT coupling, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT CAST({g} AS DOUBLE) AS coupling, y, least(greatest({_SIG.format('field')}, 1e-12), 1 - 1e-12) AS p FROM chain_{i} JOIN claims USING (image_id, ordinal)" for i, g in enumerate(_GRID)) + ") WHERE y IS NOT NULL GROUP BY 1")
def coupling_scores(spark: SparkSession, base: str) -> DataFrame:
    """How well the marginals under several couplings foretell the labels."""
    return rounded(fits.coupling_scores(claims_base(spark, base), _GRID))


def _halves(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    c = claims_base(spark, base).where("y is not null")
    u = S.uniform(F.col("image_id"), F.lit("half"))
    return c.where(u < 0.5), c.where(u >= 0.5)


@CORE.add("logistic_fit")
def logistic_fit(spark: SparkSession, base: str) -> DataFrame:
    """Weights of the logistic model of both scores, its strength, and the Brier score on the other half of the images."""
    train, held = _halves(spark, base)
    x = fits.evidence_features(F.col("det"), F.col("sim"), "product")
    w, c = fits.logistic_by_grid(train, held, x, F.col("y"))
    b = held.agg(F.avg((fits.predict(w, x) - F.col("y")) ** 2).alias("brier"), F.count(F.lit(1)).alias("n"))
    return rounded(b.select(*(F.lit(float(v)).alias(f"w{i}") for i, v in enumerate(w)), F.lit(c).cast("double").alias("strength"), "brier", "n"), 4)


@CORE.add("probability_calibration")
def probability_calibration(spark: SparkSession, base: str) -> DataFrame:
    """Expected calibration error and Brier score of raw, Platt and isotonic probabilities on the half not fitted."""
    cal, held = _halves(spark, base)
    a, i = fits.platt(cal, F.col("p"), F.col("y")), fits.isotonic(cal.withColumn("p", F.round("p", 2)), F.col("p"), F.col("y"))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), q.alias("q")) for n, q in (("raw", F.col("p")), ("platt", fits.apply_platt(a, F.col("p"))), ("isotonic", fits.apply_isotonic(i, F.col("p")))))))
    d = held.select("y", rows.alias("_r")).select("y", "_r.*")
    e = metrics.ece(d, F.col("y"), F.col("q"), keys=["method"])
    return rounded(e.join(metrics.brier_logloss(d, F.col("y"), F.col("q"), ["method"]), "method"), 4)


@CORE.add("incremental_utility")
def incremental_utility(spark: SparkSession, base: str) -> DataFrame:
    """Does the width of the interval add to the probability, out of fold by images."""
    c = claims_base(spark, base)
    return rounded(fits.incremental_utility(c, [S.logit(F.col("p"))], [F.col("upper") - F.col("lower")], F.col("y"), F.col("image_id")), 4)


_ERR = "CAST((p >= 0.5) <> (y = 1) AS INT)"


def _error():
    return F.when(F.col("y").isNotNull(), ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("int"))


@CORE.add("error_detection", _sql(f"""SELECT count(*) AS n, CAST(sum(e) AS BIGINT) AS n_errors, round(avg(u) FILTER (e = 1), 6) AS mean_error, round(avg(u) FILTER (e = 0), 6) AS mean_right, round(quantile_cont(u, 0.5) FILTER (e = 1), 6) AS median_error, round(quantile_cont(u, 0.5) FILTER (e = 0), 6) AS median_right,
  (SELECT round(sum(np * (below + nn / 2)) / (sum(np) * sum(nn)), 6) FROM (SELECT *, coalesce(sum(nn) OVER (ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT round(upper - lower, 9) AS u, CAST(sum({_ERR}) AS DOUBLE) AS np, CAST(sum(1 - {_ERR}) AS DOUBLE) AS nn FROM claims WHERE y IS NOT NULL GROUP BY 1))) AS auroc,
  (SELECT round(sum(np / total * tp / k), 6) FROM (SELECT np, sum(np) OVER () AS total, sum(np) OVER (ORDER BY u DESC) AS tp, sum(n) OVER (ORDER BY u DESC) AS k FROM (SELECT round(upper - lower, 9) AS u, CAST(sum({_ERR}) AS DOUBLE) AS np, count(*) AS n FROM claims WHERE y IS NOT NULL GROUP BY 1))) AS average_precision, 'evaluated' AS status
  FROM (SELECT {_ERR} AS e, round(upper - lower, 9) AS u FROM claims WHERE y IS NOT NULL)"""))  # fmt: skip
def error_detection(spark: SparkSession, base: str) -> DataFrame:
    """Does a wide interval tell an error."""
    return rounded(reliability.error_detection(claims_base(spark, base), _error(), F.round(F.col("upper") - F.col("lower"), 9)))


@CORE.add("width_by_label", _sql("SELECT coalesce(CAST(y AS VARCHAR), 'unknown') AS label, count(*) AS n, round(avg(upper - lower), 6) AS mean_width, round(quantile_cont(upper - lower, 0.5), 6) AS median_width FROM claims GROUP BY 1"))
def width_by_label(spark: SparkSession, base: str) -> DataFrame:
    return rounded(reliability.width_by_label(claims_base(spark, base), F.col("y"), F.col("upper") - F.col("lower")))


@CORE.add("uncertainty_summary", _sql("""SELECT decision, count(*) AS n, round(avg(hi - lo), 6) AS mean_width, CAST(sum(CAST(lo < 0.5 AND hi > 0.5 AS INT)) AS BIGINT) AS n_strict, CAST(sum(CAST(lo <= 0.5 AND hi >= 0.5 AS INT)) AS BIGINT) AS n_inclusive, round(avg(greatest(lo - 0.5, 0.5 - hi, 0)), 6) AS mean_margin FROM (
  SELECT lower AS lo, upper AS hi, CASE WHEN upper < 0.5 THEN 'supported' WHEN lower > 0.5 THEN 'hallucinated' ELSE 'evidence_sensitive' END AS decision FROM claims) GROUP BY 1"""))  # fmt: skip
def uncertainty_summary(spark: SparkSession, base: str) -> DataFrame:
    d = claims_base(spark, base).select(*reliability.uncertainty_columns(F.col("lower"), F.col("upper")))
    return rounded(d.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.avg("width").alias("mean_width"), F.count_if("crossing_strict").alias("n_strict"), F.count_if("crossing_inclusive").alias("n_inclusive"), F.avg("margin").alias("mean_margin")))


_LEVELS = (("clean", 0.0), ("light", 0.2), ("medium", 0.4), ("heavy", 0.6))


def _severities(spark: SparkSession, base: str) -> DataFrame:
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(k).alias("k")) for s, k in _LEVELS)))
    d = claims_base(spark, base).withColumn("_g", grid).select("*", "_g.*")
    w = S.theta_to_probability(F.col("theta") * (1 - F.col("k")) + F.col("eps") * (1 + F.col("k"))) - S.theta_to_probability(F.col("theta") * (1 - F.col("k")) - F.col("eps") * (1 + F.col("k")))
    return d.select("image_id", "ordinal", "severity", F.round(w, 9).alias("width"))


_SEV = f"sev AS (SELECT image_id, ordinal, severity, lv, round(1 / (1 + exp(-2 * (theta * (1 - k) + eps * (1 + k)))) - 1 / (1 + exp(-2 * (theta * (1 - k) - eps * (1 + k)))), 9) AS w FROM claims, (VALUES {', '.join(f'({i + 1}, {s!r}, CAST({k} AS DOUBLE))' for i, (s, k) in enumerate(_LEVELS))}) v(lv, severity, k))"


@CORE.add("width_tracking", CLAIMS_SQL + ", " + _SEV + " SELECT s.severity, count(*) AS n, round(avg(s.w - c.w), 6) AS mean_change, round(avg(CAST(s.w > c.w AS INT)), 6) AS share_wider FROM sev s JOIN sev c USING (image_id, ordinal) WHERE c.lv = 1 AND s.lv > 1 GROUP BY 1")
def width_tracking(spark: SparkSession, base: str) -> DataFrame:
    """Do intervals widen with the severity of a corruption, claim by claim."""
    return rounded(reliability.width_tracking(_severities(spark, base), ["image_id", "ordinal"], "severity", "width", [s for s, _ in _LEVELS]))


@CORE.add("rank_tracking", CLAIMS_SQL + ", " + _SEV + """ SELECT count(r) AS n_claims, round(avg(r), 6) AS mean_rank_correlation FROM (SELECT image_id, ordinal, CASE WHEN count(DISTINCT rw) > 1 THEN corr(lv, rw) END AS r FROM (
  SELECT image_id, ordinal, lv, rank() OVER (PARTITION BY image_id, ordinal ORDER BY w) + (count(*) OVER (PARTITION BY image_id, ordinal, w) - 1) / 2 AS rw FROM sev) GROUP BY 1, 2)""")  # fmt: skip
def rank_tracking(spark: SparkSession, base: str) -> DataFrame:
    return rounded(reliability.rank_tracking(_severities(spark, base), ["image_id", "ordinal"], "severity", "width", [s for s, _ in _LEVELS]))


@CORE.add("edge_audit", _sql("""SELECT count(*) AS n_edges, round(avg(a), 6) AS agreement, round(corr(rs, ra), 6) AS rank_correlation, 'evaluated' AS status FROM (SELECT a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rs, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra FROM (
  SELECT round(1 - abs(i.p - j.p), 6) AS s, CAST(i.y = j.y AS DOUBLE) AS a FROM claims i JOIN claims j ON i.image_id = j.image_id AND j.ordinal = i.ordinal + 1 WHERE i.y IS NOT NULL AND j.y IS NOT NULL))"""))  # fmt: skip
def edge_audit(spark: SparkSession, base: str) -> DataFrame:
    """Are alike neighbours labelled alike."""
    w = Window.partitionBy("image_id").orderBy("ordinal")
    e = claims_base(spark, base).select(F.round(1 - F.abs(F.col("p") - F.lead("p").over(w)), 6).alias("similarity"), F.col("y").alias("y_u"), F.lead("y").over(w).alias("y_v"))
    return rounded(reliability.edge_audit(e))


def _boot_sql(sums: str, value: str, name: str, seed: str, reps: int) -> str:
    return f"""SELECT round(max(v) FILTER (rep = 0), 6) AS {name}, round(quantile_cont(v, 0.025) FILTER (rep > 0), 5) AS lower, round(quantile_cont(v, 0.975) FILTER (rep > 0), 5) AS upper, count(v) FILTER (rep > 0) AS n_replicates FROM (SELECT rep, {value} AS v FROM (
  SELECT *, CASE WHEN rep = 0 THEN 1 ELSE {_poisson("u")} END AS w FROM (SELECT *, {_U.format(f"image_id || '|' || (rep - 1) || '|{seed}'")} AS u FROM ({sums}), range({reps + 1}) r(rep))) GROUP BY rep)"""


REPS = 100


def _rough(d: DataFrame) -> DataFrame:
    return d.select(*(F.round(c, 5).alias(c) if c in ("lower", "upper") else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes))


@CORE.add("crossing_stability", _sql(_boot_sql(f"SELECT image_id, sum(c) AS nc, sum(1 - c) AS no, sum(c * e) AS ec, sum((1 - c) * e) AS eo FROM (SELECT image_id, CAST(lower < 0.5 AND upper > 0.5 AS INT) AS c, {_ERR} AS e FROM claims WHERE y IS NOT NULL) GROUP BY 1", "sum(w * ec) / nullif(sum(w * nc), 0) - sum(w * eo) / nullif(sum(w * no), 0)", "risk_difference", "crossing", REPS)))
def crossing_stability(spark: SparkSession, base: str) -> DataFrame:
    """Are claims whose interval holds the threshold wrong more often; a hundred resamples."""
    return _rough(reliability.crossing_stability(claims_base(spark, base), "image_id", _error(), F.col("lower"), F.col("upper"), REPS))


@CORE.add("paired_bootstrap", _CHAIN + " " + _boot_sql("SELECT image_id, count(*) AS n, sum((p - y) * (p - y)) AS sa, sum((m - y) * (m - y)) AS sb FROM (SELECT image_id, y, p, " + _SIG.format("field") + " AS m FROM chain JOIN claims USING (image_id, ordinal) WHERE y IS NOT NULL) GROUP BY 1", "(sum(w * sa) - sum(w * sb)) / nullif(sum(w * n), 0)", "difference", "paired", REPS))
def paired_bootstrap(spark: SparkSession, base: str) -> DataFrame:
    """Brier score without less that with the graph, on the same claims of every resample."""
    c = claims_base(spark, base)
    j = c.where("y is not null").join(inference.chain_bp(c, COUPLING).select("image_id", "ordinal", "marginal"), ["image_id", "ordinal"])
    return _rough(reliability.paired_difference(j, "image_id", (F.col("p") - F.col("y")) ** 2, (F.col("marginal") - F.col("y")) ** 2, REPS))


@CORE.add("roc_points", _sql("""SELECT bin, CAST(sum(p) OVER o AS BIGINT) AS tp, CAST(sum(n) OVER o AS BIGINT) AS fp FROM (SELECT CAST(least(greatest(floor(p * 100), 0), 100) AS INT) AS bin, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM claims WHERE y IS NOT NULL GROUP BY 1) WINDOW o AS (ORDER BY bin DESC)"""))
def roc_points(spark: SparkSession, base: str) -> DataFrame:
    return reliability.roc_points(claims_base(spark, base), F.col("y"), F.col("p"))


@CORE.add("width_histogram", _sql("SELECT CAST(least(greatest(floor((upper - lower) / 0.05), 0), 19) AS INT) AS bin, count(*) AS n FROM claims GROUP BY 1"))
def width_histogram(spark: SparkSession, base: str) -> DataFrame:
    return reliability.histogram(claims_base(spark, base), F.col("upper") - F.col("lower"), 20)


@CORE.add("pr_auc", _sql("""SELECT round(sum((recall - before) * (pr + pb) / 2), 6) AS pr_auc FROM (SELECT recall, pr, lag(recall) OVER o AS before, lag(pr) OVER o AS pb FROM (SELECT i, coalesce(count(*) FILTER (y = 1 AND p * 49 + 1e-12 >= i) / nullif(count(*) FILTER (p * 49 + 1e-12 >= i), 0), 1) AS pr,
  coalesce(count(*) FILTER (y = 1 AND p * 49 + 1e-12 >= i) / nullif(count(*) FILTER (y = 1), 0), 0) AS recall FROM claims, range(50) r(i) WHERE y IS NOT NULL GROUP BY i) WINDOW o AS (ORDER BY recall, i DESC))"""))  # fmt: skip
def pr_auc(spark: SparkSession, base: str) -> DataFrame:
    """Area under the curve of fifty thresholds, by trapezoids."""
    return rounded(ladder.trapezoid_pr_auc(metrics.pr_curve(claims_base(spark, base), F.col("y"), F.col("p"))))


@CORE.add("graph_strata", _sql("""SELECT split, n_images, g1, g2, g3, g4_plus, spanning_edges, CASE WHEN 1 - g1 / n_images >= 0.5 THEN 'adequate' WHEN 1 - g1 / n_images >= 0.2 THEN 'limited' ELSE 'inadequate' END AS rating FROM (
  SELECT split, count(*) AS n_images, count(*) FILTER (k = 1) AS g1, count(*) FILTER (k = 2) AS g2, count(*) FILTER (k = 3) AS g3, count(*) FILTER (k >= 4) AS g4_plus, CAST(sum(k - 1) AS BIGINT) AS spanning_edges FROM (SELECT image_id, 'part' || (image_id % 4) AS split, count(*) AS k FROM claims GROUP BY 1, 2) GROUP BY 1)"""))  # fmt: skip
def graph_strata(spark: SparkSession, base: str) -> DataFrame:
    return ladder.strata(claims_base(spark, base), F.col("image_id"), F.concat(F.lit("part"), (F.col("image_id") % 4).cast("string")))


@CORE.add("dataset_composition", _sql("""SELECT coalesce(category, 'total') AS category, coalesce(label, 'total') AS label, count(*) AS n_claims, count(DISTINCT image_id) AS n_images FROM (SELECT image_id, coalesce(category, 'none') AS category, CASE y WHEN 1 THEN 'hallucinated' WHEN 0 THEN 'supported' ELSE 'unknown' END AS label FROM claims)
  GROUP BY GROUPING SETS ((category, label), (category), ())"""))  # fmt: skip
def dataset_composition(spark: SparkSession, base: str) -> DataFrame:
    """Claims and images per category and label, with totals."""
    d = claims_base(spark, base, True).select("image_id", F.coalesce("category", F.lit("none")).alias("category"), F.when(F.col("y") == 1, "hallucinated").when(F.col("y") == 0, "supported").otherwise("unknown").alias("label"))
    g = d.groupingSets([["category", "label"], ["category"], []], "category", "label").agg(F.count(F.lit(1)).alias("n_claims"), F.countDistinct("image_id").alias("n_images"))
    return g.select(F.coalesce("category", F.lit("total")).alias("category"), F.coalesce("label", F.lit("total")).alias("label"), "n_claims", "n_images")


# --- shift

_SHIFTED = """sc AS (SELECT image_id, ordinal, y, round(ln(least(greatest(det, 0.0001), 0.9999) / (1 - least(greatest(det, 0.0001), 0.9999))), 6) AS clean, 0.6 * """ + _U.format("image_id || '|' || ordinal || '|shift'") + " - 0.2 AS moved FROM claims WHERE y IS NOT NULL), s AS (SELECT *, round(clean + moved, 6) AS shifted FROM sc)"


def _scores(spark: SparkSession, base: str) -> DataFrame:
    d = claims_base(spark, base).where("y is not null").withColumn("clean", F.round(S.logit(F.col("det")), 6))
    return d.withColumn("shifted", F.round(F.col("clean") + 0.6 * S.uniform("image_id", "ordinal", F.lit("shift")) - 0.2, 6)).select("image_id", "ordinal", "y", "clean", "shifted")


@CORE.add("shift_stats", CLAIMS_SQL + ", " + _SHIFTED + " SELECT y AS label, count(*) AS n, round(avg(shifted - clean), 6) AS mean_change, round(quantile_cont(shifted - clean, 0.5), 6) AS median_change, round(avg(CAST(shifted - clean > 0 AS INT)), 6) AS share_up FROM s GROUP BY 1")
def shift_stats(spark: SparkSession, base: str) -> DataFrame:
    return rounded(shift.shift_stats(_scores(spark, base), "clean", "shifted"))


_SPLITS = 5
_STUDY = f"""{CLAIMS_SQL}, {_SHIFTED}, r AS (SELECT s.*, CAST(rep AS INT) AS rep, {_U.format("image_id || '|' || rep || '|splits'")} < 0.5 AS is_cal FROM s, range({_SPLITS}) x(rep)),
 h AS (SELECT rep, clean, greatest(shifted - clean, 0) AS up, row_number() OVER (PARTITION BY rep ORDER BY clean) AS k, row_number() OVER (PARTITION BY rep ORDER BY greatest(shifted - clean, 0)) AS ku, count(*) OVER (PARTITION BY rep) AS n FROM r WHERE is_cal AND y = 1),
 t AS (SELECT rep, min(clean) FILTER (k >= ceil((n + 1) * 0.9 - 1e-9)) AS tau, min(up) FILTER (ku >= ceil((n + 1) * 0.9 - 1e-9)) AS eps FROM h GROUP BY 1)"""


@CORE.add("split_study", _STUDY + """ SELECT rep, round(max(tau), 6) AS tau, round(max(eps), 6) AS eps, round(avg(CAST(clean > tau AS INT)) FILTER (y = 1), 6) AS risk_clean, round(avg(CAST(clean > tau AS INT)) FILTER (y = 0), 6) AS retention_clean, round(avg(CAST(shifted > tau AS INT)) FILTER (y = 1), 6) AS risk_shifted, round(avg(CAST(shifted > tau AS INT)) FILTER (y = 0), 6) AS retention_shifted,
  round(avg(CAST(shifted - eps > tau AS INT)) FILTER (y = 1), 6) AS risk_robust, round(avg(CAST(shifted - eps > tau AS INT)) FILTER (y = 0), 6) AS retention_robust FROM r JOIN t USING (rep) WHERE NOT is_cal GROUP BY 1""")  # fmt: skip
def split_study(spark: SparkSession, base: str) -> DataFrame:
    """Risk and retention on clean, shifted and radius-corrected scores over random splits of the images."""
    return rounded(shift.split_study(_scores(spark, base), "clean", "shifted", _SPLITS))


@CORE.add("shift_verdicts", _STUDY + """, q AS (SELECT rep, avg(CAST(clean > tau AS INT)) FILTER (y = 1) AS clean, avg(CAST(shifted > tau AS INT)) FILTER (y = 1) AS shifted, avg(CAST(shifted - eps > tau AS INT)) FILTER (y = 1) AS robust FROM r JOIN t USING (rep) WHERE NOT is_cal GROUP BY 1), v AS (UNPIVOT q ON clean, shifted, robust INTO NAME scores VALUE risk)
  SELECT scores, round(avg(risk), 6) AS mean_risk, CASE WHEN min(risk) > 0.1 THEN 'violated' WHEN max(risk) <= 0.13 THEN 'preserved' ELSE 'inconclusive' END AS verdict FROM v GROUP BY 1""")  # fmt: skip
def shift_verdicts(spark: SparkSession, base: str) -> DataFrame:
    """Is the target risk kept: the range over the splits stands for the interval."""
    d = shift.split_study(_scores(spark, base), "clean", "shifted", _SPLITS)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("scores"), F.col(f"risk_{n}").alias("risk")) for n in ("clean", "shifted", "robust"))))
    g = d.select(each.alias("_r")).select("_r.*").groupBy("scores").agg(F.avg("risk").alias("mean_risk"), F.min("risk").alias("_lo"), F.max("risk").alias("_hi"))
    return rounded(g.select("scores", "mean_risk", shift.decide(F.col("_lo"), F.col("_hi"), 0.1).alias("verdict")))


_TAUS = (-1.0, 0.0, 1.0, 2.0)


@CORE.add("image_stats", CLAIMS_SQL + ", " + _SHIFTED + ", i AS (SELECT image_id, t, count(*) FILTER (y = 1) AS nh, count(*) FILTER (y = 0) AS ns, count(*) FILTER (y = 1 AND shifted > t) AS h, count(*) FILTER (y = 0 AND shifted > t) AS k FROM s, (SELECT unnest([" + ", ".join(f"CAST({t} AS DOUBLE)" for t in _TAUS) + "]) AS t) GROUP BY 1, 2) SELECT round(sum(h) / sum(nh), 6) AS claim_risk, round(sum(k) / sum(ns), 6) AS retention, round(avg(CAST(h > 0 AS INT)), 6) AS image_risk, round(avg(CAST(h + k = 0 AS INT)), 6) AS abstention FROM i")
def image_stats(spark: SparkSession, base: str) -> DataFrame:
    """Mean over thresholds of what images keep, put together over images."""
    return rounded(shift.weighted_metrics(shift.image_stats(_scores(spark, base), "shifted", _TAUS), F.lit(1.0)))


@CORE.add("image_radius", CLAIMS_SQL + ", " + _SHIFTED + """ SELECT round(min(d) FILTER (k >= ceil((n + 1) * 0.9 - 1e-9)), 6) AS eps FROM (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM (SELECT image_id, max(abs(shifted - clean)) AS d FROM s GROUP BY 1))""")
def image_radius(spark: SparkSession, base: str) -> DataFrame:
    return rounded(shift.image_radius(_scores(spark, base), "clean", "shifted", 0.1))


@CORE.add("dominance_bootstrap", CLAIMS_SQL + ", " + _SHIFTED + f""", g AS (SELECT image_id, x, sum(a) AS a, sum(b) AS b FROM (SELECT image_id, round(clean, 3) AS x, 1 AS a, 0 AS b FROM s UNION ALL SELECT image_id, round(shifted, 3), 0, 1 FROM s) GROUP BY 1, 2),
  w AS (SELECT rep, x, sum(w * a) AS a, sum(w * b) AS b FROM (SELECT *, CASE WHEN rep = 0 THEN 1 ELSE {_poisson("u")} END AS w FROM (SELECT *, {_U.format("image_id || '|' || (rep - 1) || '|dominance'")} AS u FROM g, range(11) r(rep))) GROUP BY 1, 2)
  SELECT CAST(rep AS INT) AS rep, round(greatest(max(sb / tb - sa / ta), 0), 6) AS d_plus FROM (SELECT rep, sum(a) OVER o AS sa, sum(b) OVER o AS sb, sum(a) OVER (PARTITION BY rep) AS ta, sum(b) OVER (PARTITION BY rep) AS tb FROM w WINDOW o AS (PARTITION BY rep ORDER BY x DESC)) GROUP BY 1""")  # fmt: skip
def dominance_bootstrap(spark: SparkSession, base: str) -> DataFrame:
    """By how much shifted scores dominate the clean ones, in the data and in ten resamples."""
    return rounded(shift.dominance_bootstrap(_scores(spark, base), "clean", "shifted", 10))


@CORE.add("resampled_thresholds", CLAIMS_SQL + ", " + _SHIFTED + f""", r AS (SELECT clean, CAST(rep AS INT) AS rep FROM s, range(10) x(rep) WHERE y = 1 AND {_U.format("image_id || '|' || rep || '|taus'")} < 0.8)
  SELECT rep, round(min(clean) FILTER (k >= ceil((n + 1) * 0.9 - 1e-9)), 6) AS tau FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY clean) AS k, count(*) OVER (PARTITION BY rep) AS n FROM r) GROUP BY 1""")  # fmt: skip
def resampled_thresholds(spark: SparkSession, base: str) -> DataFrame:
    """The claim threshold on ten random parts of the images."""
    return rounded(shift.resampled_thresholds(_scores(spark, base), "clean", 0.9, 10))


@CORE.add("width_ratio", _LADDER + " " + _boot_sql("SELECT image_id, sum(upper - lower) FILTER (method = 'M6_budget') AS sa, sum(upper - lower) FILTER (method = 'M5_box') AS sb FROM rungs GROUP BY 1", "sum(w * sa) / nullif(sum(w * sb), 0)", "ratio", "ratio", REPS))
def width_ratio(spark: SparkSession, base: str) -> DataFrame:
    """How much of the box width the budget leaves."""
    r = _rungs(spark, base).where("method in ('M5_box', 'M6_budget')").groupBy("image_id", "ordinal").agg(*(F.max(F.when(F.col("method") == m, F.col("upper") - F.col("lower"))).alias(n) for m, n in (("M6_budget", "a"), ("M5_box", "b"))))
    return _rough(shift.width_ratio(r, "image_id", F.col("a"), F.col("b"), REPS))


@CORE.add("holm_adjusted", _sql("""SELECT category, round(p, 6) AS p, round(max(least(1, (m - r) * p)) OVER (ORDER BY p, category ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, category) - 1 AS r, count(*) OVER () AS m FROM (
  SELECT category, round(exp(-2 * count(*) * pow(avg(CAST(y AS DOUBLE)) - 0.5, 2)), 9) AS p FROM claims WHERE y IS NOT NULL AND category IS NOT NULL GROUP BY 1))"""))  # fmt: skip
def holm_adjusted(spark: SparkSession, base: str) -> DataFrame:
    """Bounds on the chance that a category's label share is off a half, adjusted for their number."""
    from verispan.operators.ordered import holm

    g = claims_base(spark, base, True).where("y is not null and category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("m"))
    p = g.select(F.col("category").alias("name"), F.round(F.exp(-2 * F.col("n") * (F.col("m") - 0.5) ** 2), 9).alias("p"))
    return rounded(holm(p).select(F.col("name").alias("category"), "p", "p_holm"))


@CORE.add("critical_radius")
def critical_radius(spark: SparkSession, base: str) -> DataFrame:
    """The radius at which the box interval of every claim reaches one half."""
    g = inference.chain_graphs(claims_base(spark, base), COUPLING)
    return rounded(inference.critical_radii(g).select("image_id", (F.col("target") + 1).alias("ordinal"), "radius"), 4)
