import pytest
from pyspark.sql import functions as F

from verispan.operators import datasets, hashing, splitting


def _ids(spark, n):
    return spark.createDataFrame([(f"i{k:03d}", k) for k in range(n)] + [(None, 0), ("i000", 5)], "id string, rank int")


def test_splits_have_their_counts(spark):
    d = _ids(spark, 100)
    n = lambda x: {r.split: r["count"] for r in x.groupBy("split").count().collect()}
    assert n(splitting.sliced(d, "id", (("a", 0.7), ("b", 0.3)))) == {"a": 70, "b": 30} == n(splitting.sliced(d, "id", (("a", 7), ("b", 3)), "s"))
    assert n(splitting.counted(d, "id", (("a", 10), ("b", 5)), "s")) == {"a": 10, "b": 5}
    with pytest.raises(Exception, match="fewer than 200 ids"):
        splitting.counted(d, "id", (("a", 200),), "s").collect()
    p = splitting.preregistered(d, "id", (("test", 20), ("train", 50)), 10, 4, "s").collect()
    assert sum(x.pilot == "cal" for x in p) == 4 and sum(x.pilot == "eval" for x in p) == 6 and all(x.split == "train" for x in p if x.pilot)
    assert splitting.cohort(d, "id", 7, "s").count() == 7 and splitting.cohort(d.limit(0), "id", 7, "s").count() == 0
    assert sorted(r["count"] for r in splitting.shards(d, "id", 3).groupBy("shard").count().collect()) == [33, 33, 34]
    assert splitting.condition_grid(d, "id", ("x", "y"), ("1", "2", "3")).count() == 600
    assert splitting.common_ids(d, _ids(spark, 3), "id").count() == 3


def test_groups_stay_together_and_reserved_ones_are_held(spark):
    d = _ids(spark, 90)
    group = F.floor(F.substring("id", 2, 3).cast("int") / 3).cast("string")
    r = splitting.grouped(d, "id", group, (("train", 0.8), ("test", 0.2)), "s", spark.createDataFrame([("i004",), (None,)], "id string"), spark.createDataFrame([("i030", "train"), ("i005", "train")], "id string, split string"))
    rows = r.collect()
    assert len(rows) == 90 and all(len({x.split for x in rows if x.group == g}) == 1 for g in {x.group for x in rows})
    at = {x.id: x.split for x in rows}
    assert at["i003"] == at["i004"] == at["i005"] == "test" and at["i030"] == "train"


def test_digests_do_not_depend_on_order(spark):
    rows = [("a", 1), ("b|", None), (None, 2), ("a", 1), ("", 3)]
    row = hashing.canonical_row(F.col("k"), F.col("v"))
    dig = lambda r: hashing.digest(spark.createDataFrame(r, "k string, v int"), row).first().digest
    assert dig(rows) == dig(rows[::-1]) and len({dig(rows), dig(rows[:-1]), dig([*rows[:-1], (None, 3)]), dig(rows + rows[:1]), dig([])}) == 5


def test_locks_tell_what_changed(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text("1")
    (tmp_path / "f" / "b.json").write_text("2")
    hashing.write_lock(spark, str(tmp_path / "f"), str(tmp_path / "lock"), {"purpose": "t"})
    assert hashing.verify_lock(spark, str(tmp_path / "f"), str(tmp_path / "lock")) == []
    (tmp_path / "f" / "a.json").write_text("3")
    (tmp_path / "f" / "b.json").rename(tmp_path / "f" / "c.json")
    assert hashing.verify_lock(spark, str(tmp_path / "f"), str(tmp_path / "lock")) == ["b.json is missing", "c.json is new", "a.json was changed"]
    with pytest.raises(ValueError, match="results"):
        hashing.write_lock(spark, str(tmp_path / "f"), str(tmp_path / "l2"), {"F1": 1})
    hashing.save_parameters({"w": [1.5]}, str(tmp_path / "p"))
    assert hashing.load_parameters(str(tmp_path / "p")) == {"w": [1.5]}
    (tmp_path / "p").write_text((tmp_path / "p").read_text().replace("1.5", "2.5"))
    with pytest.raises(ValueError, match="checksum"):
        hashing.load_parameters(str(tmp_path / "p"))


def test_caches_keep_real_and_synthetic_apart(spark):
    c = spark.createDataFrame([("k1", True, "x"), ("k2", False, None), ("k3", False, "y"), ("k3", False, "z")], "k string, is_synthetic boolean, value string")
    r = spark.createDataFrame([("k1", False), ("k1", True), ("k2", False), ("k3", False), (None, False)], "k string, is_synthetic boolean")
    assert {(x.k, x.is_synthetic, x.value, x.hit) for x in hashing.lookup(r, c, "k").collect()} == {("k1", False, None, False), ("k1", True, "x", True), ("k2", False, None, False), ("k3", False, "y", True), (None, False, None, False)}


def test_dataset_joins(spark):
    c = spark.createDataFrame([("c1", "i1", "train"), ("c2", "i2", None), ("c3", None, "test"), ("c4", "i9", "test")], "claim_id string, image_id string, split string")
    m = spark.createDataFrame([("i1", "test"), ("i1", "validation"), ("i2", None)], "image_id string, split string")
    got = {x.claim_id: x.split_final for x in datasets.with_parent_split(c, "image_id", "split", m, "image_id", "split").collect()}
    assert got == {"c1": "test", "c2": None, "c3": "test", "c4": "test"}
    with pytest.raises(Exception, match="no parent for"):
        datasets.with_parent_split(c, "image_id", "split", m, "image_id", "split", strict=True).collect()
    t = spark.createDataFrame([("i1", "c1", "dog", 0.2), ("i1", "cx", "cat", 0.4), ("i1", "cy", "cat", 0.3), ("i1", "c3", "dog", None)], "image_id string, claim_id string, category string, score double")
    r = spark.createDataFrame([("i1", "c1", "dog"), ("i1", "c2", "cat"), ("i1", "c3", "bird"), (None, "c1", "dog")], "image_id string, claim_id string, category string")
    assert [(x.score, x.found_by) for x in datasets.with_fallback(r, ["image_id", "claim_id"], ["image_id", "category"], t, "score").orderBy(F.desc_nulls_last("image_id"), "claim_id").collect()] == [(0.2, "exact"), (0.3, "loose"), (None, "none"), (None, "none")]
    with pytest.raises(Exception, match="no row for a key"):
        datasets.with_fallback(r, ["image_id", "claim_id"], ["image_id", "category"], t, "score", strict=True).collect()
    s = spark.createDataFrame([("i1", "clean", 0.1), ("i1", "blur", float("nan")), ("i1", "jpeg", 0.3), ("i2", "jpeg", 0.3)], "image_id string, condition string, score double")
    k = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "image_id string")
    assert [(x.image_id, x.scores) for x in datasets.with_conditions(k, ["image_id"], s, "condition", "score").collect()] == [("i1", {"clean": 0.1, "jpeg": 0.3})]
    u = datasets.choose_rows([("gt", k.where("image_id = 'i1'")), ("raw", k)], ["image_id"])
    assert {(x.image_id, x.source_name) for x in u.collect()} == {("i1", "gt"), ("i2", "raw"), ("i3", "raw")}
    with pytest.raises(Exception, match="repeated key i1"):
        datasets.unique_or_fail(s, ["image_id"]).collect()
    assert datasets.unique_or_fail(k, ["image_id"]).count() == 3
    assert {tuple(x) for x in datasets.last_wins(s.withColumn("t", F.length("condition")), ["image_id"], F.col("t")).select("image_id", "condition").collect()} == {("i1", "clean"), ("i2", "jpeg")}


def test_sets_states_and_gates(spark):
    d = spark.createDataFrame([("a", ["a", "b"], ["a", "c"]), ("c", ["a"], ["c"]), ("z", ["a"], [])], "n string, t array<string>, w array<string>")
    assert [x[0] for x in d.select(datasets.label_by_sets(F.col("n"), F.col("t"), F.col("w"))).collect()] == [0, 1, None]
    assert [x[0] for x in d.select(datasets.only_wrong(F.col("t"), F.col("w"))).collect()] == [["c"], ["c"], []]
    log = spark.createDataFrame([("k", "draft", 1), ("k", "ready", 2), ("k", "draft", 3), ("j", "ready", 1)], "k string, s string, t int")
    bad = datasets.bad_transitions(log, "k", "s", "t", {"new": ["draft"], "draft": ["ready"]}, "new").collect()
    assert {(x.key, x.from_state, x.to_state) for x in bad} == {("k", "ready", "draft"), ("j", "new", "ready")}
    r = {x.check: x.passed for x in datasets.readiness(d, [("named", F.col("n").isNotNull()), ("is_a", F.col("n") == "a")]).collect()}
    assert r == {"named": True, "is_a": False} and not any(x.passed for x in datasets.readiness(d.limit(0), [("named", F.col("n").isNotNull())]).collect())
    e = spark.createDataFrame([(100, 300), (99, 900), (200, 10)], "i int, c int").select(datasets.evaluable(F.col("i"), F.col("c"))).collect()
    assert [x[0] for x in e] == ["evaluable", "too_few_images", "too_few_claims"]
    i = spark.createDataFrame([("b", "h"), ("a", "h"), ("c", None), ("b", "g"), (None, "h")], "id string, h string")
    assert {tuple(x) for x in datasets.identity_groups(i, "id", "h").collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
