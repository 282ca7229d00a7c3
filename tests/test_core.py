import datetime as dt
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verispan.functions import keys, scalar
from verispan.kernels import digests, tree
from verispan.operators import inference, metrics, ordered, resampling
from verispan.operators.references import Reference, orphan_references, orphan_report

T = lambda d: dt.datetime(2025, 1, d)


def test_key_forms(spark):
    df = spark.createDataFrame([(" Coco_1\t", "SHA256:AB" + "1" * 62, "VAL ", "Run-Reports "), (None, "0" * 64, "unassigned", None), ("  ", "", None, " "), ("x", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "train", "a_b")], "a string, h string, s string, o string")
    rows = df.select(keys.norm_id("a"), keys.norm_hash("h"), keys.norm_split("s"), keys.norm_source("o")).collect()
    assert [tuple(r) for r in rows] == [("coco_1", "ab" + "1" * 62, "validation", "run_reports"), (None, None, None, None), (None, None, None, None), ("x", None, "train", "a_b")]


def _refs(spark, child, parent):
    c = spark.createDataFrame(child, "k string, ref string, t timestamp, parent string")
    p = spark.createDataFrame(parent, "k string, t timestamp, gone boolean, child string")  # clashing extra columns
    return [Reference("c", "p", c, F.col("k"), keys.norm_id("ref"), F.col("t"), p, keys.norm_id("k"), F.col("t"), F.col("gone"))]


def test_orphans(spark):
    child = [("1", "a", T(5), None), ("2", "B ", T(5), None), ("3", "d", T(1), None), ("4", "e", T(5), None), ("5", None, T(5), None), (None, "zz", T(5), None), ("1", "A", T(4), None), ("6", "d", None, None), ("3", "d", T(1), None)]
    parent = [("a", T(1), False, None), ("b", T(1), True, None), ("b", T(2), True, None), ("d", T(2), False, None), (None, T(1), False, None), ("a", T(9), True, None)]
    got = {tuple(r) for r in orphan_references(_refs(spark, child, parent)).collect()}
    assert got == {("c", "2", "deleted"), ("c", "3", "late"), ("c", "4", "missing")}
    rep = {r.period: r for r in orphan_report(_refs(spark, child, parent)).collect()}
    assert (rep["2025-01"].n_rows, rep["2025-01"].n_null_ref, rep["2025-01"].n_missing, rep["2025-01"].n_deleted, rep["2025-01"].n_late) == (8, 1, 2, 1, 2)
    assert rep["none"].n_rows == 1


def test_orphans_of_empty_tables(spark):
    assert orphan_references(_refs(spark, [], [("a", T(1), False, None)])).count() == 0
    assert [r.orphan_kind for r in orphan_references(_refs(spark, [("1", "a", T(1), None)], [])).collect()] == ["missing"]


def test_chain_in_catalyst_equals_kernel(spark):
    r = random.Random(1)
    rows = [(g, i, r.gauss(0, 1)) for g in range(6) for i in range(g + 1)]
    got = {(x.image_id, x.ordinal): x.field for x in inference.chain_bp(spark.createDataFrame(rows, "image_id long, ordinal int, theta double"), 0.4).collect()}
    for g in range(6):
        th = [t for a, _, t in rows if a == g]
        want = tree.fields(tree.Tree(th, [(i, i + 1, 0.4) for i in range(len(th) - 1)]))
        assert np.allclose([got[g, i] for i in range(len(th))], want)


def test_order_operators(spark):
    r = random.Random(2)
    rows = [(i, r.randint(0, 1), r.randint(0, 9) / 10) for i in range(300)] + [(999, None, 0.5), (998, 1, None)]
    df = spark.createDataFrame(rows, "i int, y int, s double")
    pos, neg = [s for _, y, s in rows if y == 1 and s is not None], [s for _, y, s in rows if y == 0]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert ordered.auroc(df, F.col("y"), F.col("s")).first().auroc == pytest.approx(want)
    s = sorted(x for _, _, x in rows if x is not None)
    k = int(np.ceil((len(s) + 1) * 0.9 - 1e-9))
    assert ordered.order_statistic(df, F.col("s"), 0.9).first().threshold == s[k - 1]
    assert ordered.order_statistic(df.where("i < 3"), F.col("s"), 0.9).first().threshold == float("inf")
    run = ordered.running(df.where("s is not null"), [F.col("s"), F.col("i")], {"c": F.lit(1)}).orderBy("c").collect()
    assert [x.c for x in run] == list(range(1, len(s) + 1)) and [x.s for x in run] == s
    h = ordered.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double"))
    assert {x.name: round(x.p_holm, 6) for x in h.collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_metrics_of_nothing(spark):
    e = spark.createDataFrame([], "y int, p double")
    r = metrics.classification(e, F.col("y"), F.col("p") > 0.5).first()
    assert r.tp == 0 and r.precision is None
    assert metrics.ece(e, F.col("y"), F.col("p")).first().ece is None
    assert ordered.auroc(e, F.col("y"), F.col("p")).first().auroc is None


def test_within_group_correlation_needs_no_pairs(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 20), r.randint(0, 1)) for _ in range(200)]
    pairs = [(a[1], b[1]) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and a[0] == b[0]]
    got = metrics.within_group_correlation(spark.createDataFrame(rows, "g int, y int"), F.col("g"), F.col("y")).first()
    assert got.n_pairs == len(pairs) and got.correlation == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1])


def test_bootstrap_weights_have_mean_one(spark):
    w = spark.range(4000).select(scalar.poisson_weight(scalar.uniform("id", F.lit("s"))).alias("w"))
    m = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(m[0] - 1) < 0.06 and abs(m[1] - 1) < 0.12
    reps = resampling.replicates(spark.range(50).withColumn("n", F.lit(1)), "id", 12, {"n": F.col("n")}, "x")
    assert resampling.interval(reps, "n").first().n_replicates == 12


def test_pgm_label_refuses_unknown(spark):
    d = spark.createDataFrame([("unknown",)], "s string")
    with pytest.raises(Exception, match="no spin"):
        d.select(scalar.pgm_label(F.col("s"))).collect()


def test_claim_grids_are_those_of_production(spark, monkeypatch):
    from verispan.plans import claim_queries as q

    rows = [(f"i{i}", o, 0.1 * o, 0.2, 1) for i in range(3) for o in (1, 2, 3)]
    claims = spark.createDataFrame(rows, "image_id string, ordinal int, theta double, eps double, y int")
    monkeypatch.setattr(q, "claims_base", lambda *_: claims)
    grid = {r.coupling: r.log_likelihood for r in q.chain_loglik_grid(spark, "").collect()}
    assert len(grid) == 201 and max(grid, key=grid.get) == 2.0  # labels that always agree
    gap = max(r.gap for r in q.robust_bounds(spark, "").collect())
    assert gap <= 3 * 0.5 / 100 + 1e-9
    assert tuple(q.robust_bounds_checked(spark, "").first()) == (9, 0, 0, 0)


def test_bootstrap_with_enough_replicates(spark, monkeypatch):
    from verispan.plans import claim_queries as q

    claims = spark.createDataFrame([(f"i{i}", 0.9 if i % 3 else 0.1, i % 2) for i in range(60)], "image_id string, p double, y int")
    monkeypatch.setattr(q, "claims_base", lambda *_: claims)
    assert q.CORE.queries["cluster_bootstrap_full"](spark, "").count() == 500
    r = q.CORE.queries["bootstrap_interval_full"](spark, "").first()
    assert r.n_replicates == 500 and r.lower < r.median < r.upper


def _drawn(cluster, rep, seed):
    text = "|".join(str(x) for x in (cluster, rep, seed) if x is not None)
    u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
    return sum(u >= b for b in scalar.poisson_bounds())


def test_replicates_make_no_row_per_cluster_and_replicate(spark):
    rows = [(f"c{i}" if i else None, float(i), None if i % 3 else 0.5, None) for i in range(200)]
    d = spark.createDataFrame(rows, "c string, a double, b double, e double")
    got = resampling.replicates(d, "c", 30, {n: F.col(n) for n in "abe"}, "x")
    assert "Generate" not in got._jdf.queryExecution().toString()
    found = {r.rep: r for r in got.collect()}
    assert sorted(found) == list(range(30)) and {r.e for r in found.values()} == {None}
    for rep, r in found.items():
        w = [_drawn(c, rep, "x") for c, *_ in rows]
        assert r.a == pytest.approx(sum(k * a for k, (_, a, _, _) in zip(w, rows))) and r.b == pytest.approx(sum(k * (b or 0) for k, (_, _, b, _) in zip(w, rows)))
    assert resampling.replicates(d.limit(0), "c", 3, {"a": F.col("a")}, "x").count() == 0


def test_full_bootstrap_draws_every_replicate_by_its_hash(spark, monkeypatch):
    from verispan.plans import claim_queries as q

    rows = [(i // 3, 0.9 if i % 5 else 0.1, None if i % 7 == 0 else i % 2) for i in range(90)]
    claims = spark.createDataFrame(rows, "image_id long, p double, y int")
    monkeypatch.setattr(q, "claims_base", lambda *_: claims)
    d = q.CORE.queries["cluster_bootstrap_full"](spark, "")
    assert "Generate" not in d._jdf.queryExecution().toString()
    found = {r.rep: (r.n, r.error_rate) for r in d.collect()}
    assert sorted(found) == list(range(500))
    for rep in (0, 7, 99, 499):
        w = [_drawn(i, rep, "boot") if y is not None else 0 for i, _, y in rows]
        wrong = sum(k for k, (_, p, y) in zip(w, rows) if (p >= 0.5) != (y == 1))
        assert found[rep] == (sum(w), pytest.approx(wrong / sum(w), abs=1e-6))


def test_quantiles_and_keyed_sums_need_no_whole_key(spark):
    r = random.Random(5)
    rows = [(r.choice(("a", "b", None)), r.choice((None, float("nan"), r.random(), 0.5)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, i int")
    got = {x.k: x for x in ordered.quantiles(df, F.col("x"), {"q1": 0.1, "q2": 0.5, "q3": 1.0}, ["k"]).collect()}
    for k in ("a", "b", None):
        v = [x for a, x, _ in rows if a == k and x is not None and x == x]
        assert got[k].n == len(v) and np.allclose([got[k].q1, got[k].q2, got[k].q3], np.quantile(v, [0.1, 0.5, 1.0]))
    run = ordered.running(df, [F.col("i")], {"c": F.lit(1)}, ["k"]).collect()
    for k in ("a", "b", None):
        mine = sorted((x.i, x.c, x.c_total) for x in run if x.k == k)
        assert [c for _, c, _ in mine] == list(range(1, len(mine) + 1)) and {t for *_, t in mine} == {len(mine)}
    assert ordered.quantiles(df.limit(0), F.col("x"), {"q": 0.5}).first().q is None


def test_permutations_keep_the_number_of_ones(spark):
    d = spark.createDataFrame([(i, i // 4, int(i // 4 % 2)) for i in range(80)] + [(99, 1, None)], "i int, g int, y int")
    p = resampling.permuted_labels(d, "y", F.col("i"), 5, "s").groupBy("rep").agg(F.sum("drawn").alias("n"), F.count("*").alias("m")).collect()
    assert len(p) == 5 and all((x.n, x.m) == (40, 80) for x in p)
    t = resampling.permutation_pvalue(d, F.col("g"), "y", F.col("i"), 19).first()
    assert t.observed == pytest.approx(1.0) and t.p_value == pytest.approx(0.05)


@pytest.mark.parametrize("shape", ["even", "one giant group", "few rows", "rows without a name"])
def test_permutations_are_not_stored_per_replicate(spark, monkeypatch, shape):
    r = random.Random(8)
    n, reps = (12, 19) if shape == "few rows" else (3000, 7)
    group = {"one giant group": lambda: 1 if r.random() < 0.9 else r.randrange(9), "few rows": lambda: r.randrange(4)}.get(shape, lambda: r.choice((None, *range(700))))
    rows = [(f"é{i}" if i % 2 else str(i), group(), int(r.random() < 0.3)) for i in range(n)]
    if shape == "rows without a name":  # equal hashes miss any margin
        rows = [(None, g, y) for _, g, y in rows]
    d = spark.createDataFrame([*rows, ("none", 3, None)], "i string, g int, y int")
    stored = []
    own = resampling.cut
    monkeypatch.setattr(resampling, "cut", lambda x: [own(x), stored.append(x.count())][0])
    monkeypatch.setattr(ordered, "cut", lambda x: [own(x), stored.append(x.count())][0])
    monkeypatch.setattr(resampling.digests, "ROWS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")  # groups reach over batches
    try:
        got = resampling.permutation_pvalue(d, F.col("g"), "y", F.col("i"), reps, "s").first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    if shape == "rows without a name":
        assert got.n_permutations == reps and 0 < got.p_value <= 1
        return
    assert shape == "few rows" or sum(stored) < n * reps / 2

    def correlation(of):
        groups = {}
        for (_, g, _), v in zip(rows, of):
            groups.setdefault(g, []).append(v)
        sizes = [(len(v), sum(v)) for g, v in groups.items() if g is not None]
        count, sx, sxy = sum(k * (k - 1) for k, _ in sizes), sum((k - 1) * s for k, s in sizes), sum(s * s - s for _, s in sizes)
        m = sx / count
        return (sxy / count - m * m) / (m - m * m)

    ones = sum(y for *_, y in rows)
    hits, observed = 0, correlation([y for *_, y in rows])
    for rep in range(reps):
        order = sorted(range(n), key=lambda k: hashlib.md5(f"{rows[k][0]}|{rep}|s".encode()).hexdigest()[:13])
        taken = set(order[:ones])
        hits += correlation([int(k in taken) for k in range(n)]) >= observed - 1e-12
    assert got.n_permutations == reps and got.observed == pytest.approx(observed) and got.p_value == pytest.approx((hits + 1) / (reps + 1))


def test_hashes_in_numpy_are_those_of_md5():
    r = random.Random(4)
    texts = ["", "é|", *("x" * k for k in range(60)), *(f"{r.randrange(10 ** r.randrange(1, 30))}|" for _ in range(500))]
    a = pa.array(["skipped", *texts]).slice(1)
    bounds = digests.Bounds(scalar.poisson_bounds())
    for suffix in (b"", b"0|boot", b"499|boot"):
        got, counts = np.zeros(len(texts), np.uint32), np.zeros(len(texts), int)
        for b in digests.blocks(a):
            got[b.rows] = b.heads(suffix)
            counts[b.rows] = b.counts(suffix, bounds)
        want = [hashlib.md5(t.encode() + suffix).hexdigest() for t in texts]
        assert got.tolist() == [int(w[:8], 16) for w in want]
        assert counts.tolist() == [sum(int(w[:13], 16) / 2**52 >= b for b in bounds.of) for w in want]
    # a bound that lies inside the first 32 bits of a digest needs the rest of it
    b = next(digests.blocks(pa.array(["a|"])))
    u = b.exact(0, b"0|s")
    assert b.counts(b"0|s", digests.Bounds([u])).tolist() == [1] and b.counts(b"0|s", digests.Bounds([u + 2**-52])).tolist() == [0]


def test_blocks_fill_up_over_batches(monkeypatch):
    """One unfilled block for each length of a task, not for each length and batch."""
    monkeypatch.setattr(digests, "ROWS", 40)
    texts = [f"{i}|" for i in range(5, 305)]  # 5, 90 and 205 of a length
    parts = [(pa.array(texts[i : i + 7]), np.array([[float(t[:-1])] for t in texts[i : i + 7]])) for i in range(0, 300, 7)]
    found = list(digests.filled([*parts, (pa.array([], pa.string()), np.empty((0, 1)))]))
    assert sorted(len(d) for d, _ in found) == [5, 5, 10, *[40] * 7]
    assert sorted((t.tobytes().decode(), *v) for d, values in found for t, v in zip(d, values)) == sorted((t, float(t[:-1])) for t in texts)
    assert [len(d) for d, _ in digests.filled([(pa.array(["x" * 2**21] * 3), np.zeros((3, 1)))])] == [1, 1, 1]  # long texts


def test_replicates_are_summed_in_java(spark, monkeypatch):
    """Java's sums are those of hashlib and of numpy: empty and long texts, other than ASCII, more rows than one step takes."""
    texts = [None, *("x" * k for k in range(70)), *(f"é{i}" for i in range(300)), *(str(i) for i in range(1000, 6000))]
    d = spark.createDataFrame([(t, float(i % 7), None if i % 3 else 0.5) for i, t in enumerate(texts)], "c string, a double, b double").coalesce(1)
    r = lambda: resampling.replicates(d, "c", 12, {n: F.col(n) for n in "ab"}, "sé")
    assert "verispan_WeightedSums" in r()._jdf.queryExecution().toString()
    java = {x.rep: (x.a, x.b) for x in r().collect()}
    for rep in (0, 11):
        w = [_drawn(t, rep, "sé") for t in texts]
        assert java[rep] == (sum(k * (i % 7) for i, k in enumerate(w)), sum(k * 0.5 for i, k in enumerate(w) if i % 3 == 0))
    monkeypatch.setattr(resampling.jvm, "function", lambda *_: None)
    assert "verispan_WeightedSums" not in r()._jdf.queryExecution().toString()
    assert {x.rep: (x.a, x.b) for x in r().collect()} == java


def test_planted_contract_breaks_are_found(spark):
    from verispan.operators import audits

    rows = [("a", 0.5, True, 0.1, True), (None, None, True, None, False), ("b", 1.5, True, -2.0, True), ("c", 0.0, False, None, None), ("d", float("nan"), True, float("nan"), True), ("e", None, None, 0.2, False)]
    d = spark.createDataFrame(rows, "k string, d double, don boolean, s double, son boolean")
    got = sorted((r.record_key or "", r.violation) for r in audits.evidence_violations(d, F.col("k"), F.col("d"), F.col("don"), F.col("s"), F.col("son")).collect())
    assert got == [("", "detector_availability"), ("", "empty_key"), ("b", "detector_range"), ("b", "similarity_range"), ("c", "detector_availability"), ("c", "zero_substitution"), ("d", "detector_range"), ("d", "similarity_range"), ("e", "similarity_availability")]
    c = spark.createDataFrame([("i1", "test"), ("i1", "train"), ("i1", "dev"), ("i2", None), ("i3", "train"), ("i4", None)], "k string, v string")
    p = spark.createDataFrame([("i1", "test"), ("i1", "train"), ("i2", "train"), ("i4", None)], "k string, v string")
    got = {tuple(r) for r in audits.disagreeing(c, F.col("k"), F.col("v"), p, F.col("k"), F.col("v")).collect()}
    assert got == {("dev", "test", 1), (None, "train", 1), ("train", None, 1)}
