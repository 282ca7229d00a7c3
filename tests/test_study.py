import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispan.functions import scalar as S
from verispan.kernels import tree
from verispan.operators import fits, inference, ladder, reliability, shift


def _numpy_logistic(x, y, l2):
    x = np.c_[np.ones(len(x)), x]
    w, pen = np.zeros(x.shape[1]), np.diag([0.0] + [l2] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ w)
    return w


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 2))
    y = (r.uniform(size=300) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, -1.0])))).astype(int)
    rows = [(i // 3, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame([*rows, (999, None, 0.0, 1), (998, 0.0, 0.0, None)], "g int, a double, b double, y int"), x, y


def test_logistic_equals_newton_in_numpy(labelled, spark):
    d, x, y = labelled
    assert np.allclose(fits.logistic(d, [F.col("a"), F.col("b")], F.col("y"), 0.5), _numpy_logistic(x, y, 0.5), atol=1e-6)
    two = d.withColumn("m", F.pmod("g", F.lit(2)))
    many = fits.logistic_many(two, [F.col("a")], F.col("y"), "m", [0, 1], 0.1)
    odd = (np.arange(300) // 3) % 2
    for m in (0, 1):
        assert np.allclose(many[m], _numpy_logistic(x[odd == m, :1], y[odd == m], 0.1), atol=1e-6)
    assert fits.logistic(d.limit(0), [F.col("a")], F.col("y")) == [0.0, 0.0]
    w, c = fits.logistic_by_grid(d, d, [F.col("a"), F.col("b")], F.col("y"))
    assert c in (0.01, 0.1, 1.0, 10.0) and w[1] > 0 > w[2]
    assert fits.logistic_by_grid(d.where("y = 1"), d, [F.col("a"), F.col("b")], F.col("y")) == ([0.0, -1.5, 0.0], None)


def test_calibration_fits(labelled, spark):
    d, x, y = labelled
    p = d.withColumn("p", S.sigmoid(F.col("a") * 3))
    a, b = fits.platt(p, F.col("p"), F.col("y"))
    assert np.allclose((a, b), _numpy_logistic(np.log(1 / (1 + np.exp(-3 * x[:, :1])) / (1 - 1 / (1 + np.exp(-3 * x[:, :1])))), y, 1e-6), atol=1e-4)
    corners = fits.isotonic(p, F.col("p"), F.col("y"))
    ys = [c for _, c in corners]
    assert ys == sorted(ys)
    got = p.select("p", fits.apply_isotonic(corners, F.col("p")).alias("q")).where("p is not null").collect()
    assert np.allclose([r.q for r in got], np.interp([r.p for r in got], *zip(*corners)))
    assert fits.platt(p.where("y = 1"), F.col("p"), F.col("y")) is None and fits.isotonic(p.limit(5), F.col("p"), F.col("y")) is None


def test_incremental_utility_tells_a_useful_feature(labelled):
    d, _, _ = labelled
    r = fits.incremental_utility(d, [F.col("a")], [F.col("b")], F.col("y"), F.col("g")).first()
    assert r.n == 300 and r.gain_log_loss > 0.02 and r.gain_brier > 0.005 and r.status == "evaluated"
    assert fits.incremental_utility(d.limit(3), [F.col("a")], [F.col("b")], F.col("y"), F.col("g")).first().status == "too_few"


def test_incremental_utility_reads_its_rows_once(labelled, spark):
    d, x, y = labelled
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    twice = d.unionByName(d).withColumn("a", F.udf(seen, "double").asNondeterministic()("a"))
    r = fits.incremental_utility(twice, [F.col("a")], [F.col("b")], F.col("y"), F.col("g")).first()
    assert read.value <= 2 * d.count()  # not once for each step of each fit
    folds = np.array([f.f for f in spark.createDataFrame([(i // 3,) for i in range(300)], "g int").select((S.uniform("g", F.lit("folds")) * 5).cast("int").alias("f")).collect()])
    p = np.zeros(300)
    for f in range(5):
        m = folds != f
        w = _numpy_logistic(np.r_[x[m], x[m]], np.r_[y[m], y[m]], 1e-2)
        p[~m] = 1 / (1 + np.exp(-np.c_[np.ones((~m).sum()), x[~m]] @ w))
    assert r.n == 600 and r.log_loss_both == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), abs=1e-7) and r.brier_both == pytest.approx(np.mean((p - y) ** 2), abs=1e-7)


def test_coupling_is_found(spark):
    rows = [(g, i, 0.0, (g + i // 4) % 2) for g in range(8) for i in range(4)]  # all labels of an image agree
    d = spark.createDataFrame(rows + [(9, 0, 0.3, None)], "image_id int, ordinal int, theta double, y int")
    s = fits.coupling_scores(d, (0.0, 0.5))
    assert s.count() == 2 and {r.n for r in s.collect()} == {32}
    assert fits.best_coupling(s).first().coupling == 0.0  # no field, no preference: the smaller
    with pytest.raises(ValueError):
        fits.coupling_scores(d, (-1.0,))


def test_star_equals_kernel(spark):
    r = random.Random(3)
    rows = [(g, i + 1, r.gauss(0, 1)) for g in range(5) for i in range(g + 1)]
    got = {(x.image_id, x.ordinal): x.field for x in inference.star_bp(spark.createDataFrame(rows, "image_id int, ordinal int, theta double"), 0.4).collect()}
    for g in range(5):
        th = [t for a, _, t in rows if a == g]
        want = tree.fields(tree.Tree(th, [(0, i, 0.4) for i in range(1, len(th))]))
        assert np.allclose([got[g, i + 1] for i in range(len(th))], want)


def test_ladder_has_all_rungs(spark):
    rows = [("i", k, 0.2 * k, 0.1, 0.3, 0.2 * k - 0.5, 0.3, k % 2) for k in (1, 2, 3)] + [("j", 1, None, None, 0.6, 0.1, 0.0, None)]
    d = spark.createDataFrame(rows, "image_id string, ordinal int, det double, sim double, p double, theta double, eps double, y int")
    l = ladder.ladder(d, 0.3, 0.2, 50)
    x = {(r.method, r.image_id, r.ordinal): r for r in l.collect()}
    assert len(x) == 28 and {m for m, _, _ in x} == set(ladder.METHODS)
    for k in (1, 2, 3):
        box, bud = x["M5_box", "i", k], x["M6_budget", "i", k]
        assert box.lower <= bud.lower + 1e-12 <= bud.posterior + 1e-9 <= bud.upper + 1e-8 and bud.upper <= box.upper + 1e-12
    s = {r.method: r for r in ladder.method_summary(l).collect()}
    assert s["M0_detector"].n_claims == 4 and s["M0_detector"].mean_width is None and s["M6_budget"].mean_width > 0
    assert ladder.rung_gains(ladder.method_summary(l)).count() == 6


def test_error_detection_guards(spark):
    d = spark.createDataFrame([(i % 2, float(i % 2) + i / 100) for i in range(20)] + [(None, 0.1), (1, None)], "e int, u double")
    r = reliability.error_detection(d, F.col("e"), F.col("u")).first()
    assert (r.n, r.n_errors, r.auroc, r.status) == (20, 10, 1.0, "evaluated") and r.median_error > r.median_right
    assert reliability.error_detection(d.limit(3), F.col("e"), F.col("u")).first().status == "too_few"
    assert reliability.error_detection(d.where("e = 0"), F.col("e"), F.col("u")).first().status == "one_class"


def test_tracking(spark):
    rows = [(k, s, w) for k in range(4) for s, w in (("clean", 0.1), ("light", 0.2), ("heavy", 0.3 if k else 0.05))] + [(9, "clean", 0.1), (8, "clean", 0.5), (8, "heavy", 0.5)]
    d = spark.createDataFrame(rows, "k int, s string, w double")
    t = {r.severity: r for r in reliability.width_tracking(d, ["k"], "s", "w", ["clean", "light", "heavy"]).collect()}
    assert t["light"].n == 4 and t["light"].mean_change == pytest.approx(0.1) and t["heavy"].n == 5 and t["heavy"].share_wider == 0.6
    r = reliability.rank_tracking(d, ["k"], "s", "w", ["clean", "light", "heavy"]).first()
    assert r.n_claims == 4 and r.mean_rank_correlation == pytest.approx((3 * 1 - 0.5) / 4)


def test_thresholds_radii_and_verdicts(spark):
    d = spark.createDataFrame([(i // 2, i % 2, float(i), i + (0.5 if i % 3 else -1.0)) for i in range(40)], "image_id int, y int, clean double, shifted double")
    bad = sorted(float(i) for i in range(40) if i % 2)
    assert shift.claim_threshold(d, "clean", 0.1).first().tau == bad[int(np.ceil(21 * 0.9 - 1e-9)) - 1]
    assert shift.claim_threshold(d.limit(4), "clean", 0.1).first().tau == float("inf")
    assert shift.claim_radius(d, "clean", "shifted", 0.1).first().eps == 0.5 and shift.image_radius(d, "clean", "shifted", 0.1).first().eps == 1.0
    r = shift.image_risk(d, F.col("clean"), F.lit(29.5), F.lit(0.0)).first()
    assert r.bad_rate == pytest.approx(5 / 20) and r.abstention == pytest.approx(15 / 20)
    v = spark.createDataFrame([(0.2, 0.3), (0.0, 0.12), (0.05, 0.2)], "lo double, hi double").select(shift.decide(F.col("lo"), F.col("hi"), 0.1)).collect()
    assert [x[0] for x in v] == ["violated", "preserved", "inconclusive"]
    s = shift.split_study(d, "clean", "shifted", 3).collect()
    assert len(s) == 3 and all(x.risk_robust is None or x.risk_shifted is None or x.risk_robust <= x.risk_shifted for x in s)
    boot = {x.rep: x.d_plus for x in shift.dominance_bootstrap(d, "clean", "shifted", 4).collect()}
    assert len(boot) == 5 and all(0 <= v <= 1 for v in boot.values())
    w = spark.createDataFrame([("a", "dog", 0.5), ("a", "dog", float("nan")), ("b", "dog", float("inf"))], "i string, c string, s double")
    k = spark.createDataFrame([("a", "dog"), ("b", "dog")], "i string, c string")
    assert [(x.i, x.swap_score) for x in shift.swap_scores(k, ["i", "c"], w, "s").collect()] == [("a", 0.5)]
