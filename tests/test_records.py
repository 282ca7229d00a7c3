import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verispan import cli
from verispan.functions import pictures
from verispan.operators import providers
from verispan.sources import records


def _lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def _manifest(path, ids):
    path.write_text(json.dumps({"manifest_id": "m", "schema_version": "1", "entries": [{"image": {"image_id": i, "file_hash": f"h{i}"}, "split": s} for i, s in ids]}))
    return str(path)


def test_manifest_there_and_back(spark, tmp_path):
    m = records.read_manifest(spark, _manifest(tmp_path / "m.json", [("a", "train"), ("b", None)]))
    assert [(r.image.image_id, r.split) for r in m.collect()] == [("a", "train"), ("b", None)]
    records.write_manifest(m, str(tmp_path / "out"), "m2")
    again = records.read_manifest(spark, str(tmp_path / "out"))
    assert {(r.manifest_id, r.image.image_id) for r in again.collect()} == {("m2", "a"), ("m2", "b")}


def test_evidence_breaks_are_errors(spark, tmp_path):
    good = {"claim_id": "c", "image_id": " A ", "detector_score": 0.5, "detector_available": True, "similarity_available": False, "split": "test"}
    e = records.read_evidence(spark, _lines(tmp_path / "e.jsonl", [good]))
    assert e.count() == 1
    bad = _lines(tmp_path / "b.jsonl", [good, {**good, "claim_id": "x", "detector_score": 1.5}])
    with pytest.raises(Exception, match="detector_range in claim x"):
        records.read_evidence(spark, bad).collect()
    assert records.read_evidence(spark, bad, strict=False).count() == 2
    m = records.read_manifest(spark, _manifest(tmp_path / "m.json", [("a", "train")]))
    assert [r.split for r in records.ingest_evidence(e, m).collect()] == ["train"]
    with pytest.raises(Exception, match="no parent for a"):
        records.ingest_evidence(e, m.limit(0)).collect()
    assert [r.split for r in records.ingest_evidence(e, m.limit(0), allow_missing=True).collect()] == ["test"]


def test_labels_and_decisions(spark, tmp_path):
    row = {"claim_id": "c", "image_id": "i", "annotator_id": "A", "ground_truth_status": " Supported "}
    assert records.read_labels(spark, _lines(tmp_path / "l.jsonl", [row])).first().status == "supported"
    with pytest.raises(Exception, match="repeated key i"):
        records.read_labels(spark, _lines(tmp_path / "l2.jsonl", [row, row])).collect()
    with pytest.raises(Exception, match="no status: maybe"):
        records.read_labels(spark, _lines(tmp_path / "l3.jsonl", [{**row, "ground_truth_status": "maybe"}])).collect()
    d = [{"claim_id": "c", "image_id": "i", "adjudicated_status": s} for s in ("unknown", "supported")]
    assert [r.adjudicated_status for r in records.read_decisions(spark, _lines(tmp_path / "d.jsonl", d)).collect()] == ["supported"]


def test_benchmarks_and_study_rows(spark):
    q = spark.createDataFrame([("Is there a dog in the image?", "yes", "val_00042.jpg"), ("Are there any cats?", "No", "7.jpg"), ("Is the dog brown?", "yes", "7.jpg"), (None, None, None)], "question string, answer string, image string")
    assert [(r.image_id, r.object_category, r.status, r.supported_task) for r in records.map_yes_no(q).collect()] == [("coco_42", "dog", "supported", True), ("coco_7", "cats", "hallucinated", True), ("coco_7", None, "supported", False), (None, None, "unknown", False)]
    g = spark.createDataFrame([(1, "generative", ["a"], ["a", "b"]), (2, "existence", ["a"], [])], "id int, type string, truth array<string>, hallu array<string>")
    assert [tuple(r) for r in records.generative_entries(g).collect()] == [(1, ["a"], ["b"])]
    e = spark.createDataFrame([({"clean": (0.5,), "blur": (None,), "jpeg": (1.0,)},)], "evidence map<string, struct<owl: double>>")
    x = records.condition_logits(e, "owl").first().logits
    assert set(x) == {"clean", "jpeg"} and x["clean"] == 0.0 and x["jpeg"] == pytest.approx(np.log(0.9999 / 0.0001))
    s = spark.createDataFrame([("i", [("dog", {"v1": 0.1, "dino": None})])], "image_id string, claims array<struct<category: string, scores: map<string, double>>>")
    assert [tuple(r) for r in records.swap_rows(s).collect()] == [("i", "dog", "v1", 0.1)]
    t = spark.createDataFrame([([(0, 2), (2, 5), (5, 6)], [-1.0, -2.0, -3.0], 1, 4), ([], [], 0, 1)], "s array<struct<a: int, b: int>>, p array<double>, a int, b int")
    assert [tuple(r[0]) for r in t.select(records.overlapping(F.col("s"), F.col("p"), F.col("a"), F.col("b"))).collect()] == [(-1.5, -1.0, -2.0), (None, None, None)]
    b = spark.createDataFrame([(0.5, 0.25, 0.5, 0.5, 100, 50)], "cx double, cy double, w double, h double, wd int, ht int")
    assert tuple(b.select(records.box_to_pixels(*(F.col(c) for c in b.columns))).first()[0]) == (25, 0, 75, 50)
    k = spark.createDataFrame([([5, 6, 9, 9, 7],), ([],)], "t array<int>")
    assert [r[0] for r in k.select(records.phrase_positions(F.col("t"), F.array(F.lit(9)))).collect()] == [[[0, 1], [4]], []]


def test_writers_and_reports(spark, tmp_path):
    d = spark.createDataFrame([("a", 0.123456, None), ("b|c", 2.0, 1)], "k string, v double, n int")
    assert records.markdown(d).splitlines()[2:] == ["| a | 0.1235 | N/A |", "| b\\|c | 2 | 1 |"]
    assert len(records.write_tables({"t": d}, str(tmp_path / "t"))) == 3 and json.loads((tmp_path / "t" / "t.json").read_text())[1]["n"] == 1
    assert (tmp_path / "t" / "t.csv").read_text().splitlines()[1] == "a,0.123456,"
    with pytest.raises(ValueError, match="more than 1"):
        records.markdown(d, 1)
    assert "## S\n\n| k |" in records.report("R", [("S", d.select("k")), ("T", "text")])
    for v in (d, d.limit(0)):
        records.write_once(v, str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2
    records.write_by(d.select("k", "n"), str(tmp_path / "by"), "n")
    assert spark.read.json(str(tmp_path / "by")).count() == 2
    s = records.synthetic_claims(spark, 5)
    assert s.count() == 15 and s.collect() == records.synthetic_claims(spark, 5).collect()


def test_pictures():
    r = np.random.default_rng(0)
    p = r.integers(0, 256, (24, 30, 3)).astype(np.uint8)
    assert (pictures.corrupt(p, "clean") == p).all() and pictures.parse_condition("blur") == ("blur", 3)
    for c in ("blur_1", "noise_5", "downsample_2", "contrast_4", "brightness_3", "occlusion_1"):
        x = pictures.corrupt(p, c, "i")
        assert x.shape == p.shape and x.dtype == np.uint8 and (x == pictures.corrupt(p, c, "i")).all() and (x != p).any()
    assert pictures.corrupt(p, "blur_5").std() < pictures.corrupt(p, "blur_1").std() < p.std()
    assert (pictures.corrupt(np.full((8, 9, 3), 7, np.uint8), "blur_3") == 7).all()
    for bad in ("fog_1", "blur_6", "blur_x", ""):
        with pytest.raises(ValueError):
            pictures.parse_condition(bad)
    m = pictures.mask_boxes(p, [(5, 4, 10, 6)])
    assert len(np.unique(m[4:10, 5:15].reshape(-1, 3), axis=0)) == 1 and (m[:4] == p[:4]).all()
    assert pictures.padded_crop(p, (10, 10, 20, 20), 0.1).shape == (12, 12, 3) and pictures.padded_crop(p, (0, 0, 0, 0)).size
    assert pictures.cap_pixels(1000, 500, 125_000) == (500, 250) and pictures.cap_pixels(3, 4, 100) == (3, 4)


def test_models_run_in_batches_and_go_on(spark):
    d = spark.createDataFrame([("a", "dog"), ("b", "cat"), ("c", "bad")], "image_id string, object_category string").repartition(3)

    def make():
        def model(pdf: pd.DataFrame) -> pd.DataFrame:
            if (pdf["object_category"] == "bad").any():
                raise RuntimeError("no weights")
            return pdf.assign(score=1.0)

        return model

    out = providers.run_model(d, make, "image_id string, object_category string, score double")
    got = {r.image_id: (r.score, r.error) for r in out.collect()}
    assert got["c"] == (None, "RuntimeError: no weights") and got["a"] == (1.0, None)
    assert [r.image_id for r in providers.pending(d, out, ["image_id"]).collect()] == ["c"]
    with pytest.raises(Exception, match="no weights"):
        providers.run_model(d, make, "image_id string, object_category string, score double", batch_errors=False).collect()
    s = providers.stand_in_detector(spark.range(300).select(F.col("id").cast("string").alias("image_id"), F.lit("dog").alias("object_category"))).collect()
    assert 10 < sum(not r.detector_available for r in s) < 60 and all((r.detector_score is None) == (not r.detector_available) for r in s)
    e = providers.attach_evidence(d, d.limit(1).withColumn("detector_score", F.lit(0.5)), d.limit(0).withColumn("clip_score", F.lit(0.1)))
    assert e.count() == 3 and e.where("detector_available").count() == 1 and e.where("similarity_available").count() == 0
    c = providers.stand_in_caption(d, spark.createDataFrame([("a", "x"), ("a", "y")], "image_id string, caption string"))
    assert {r.image_id: r.caption for r in c.collect()} == {"a": "x", "b": None, "c": None}


def test_commands(spark, tmp_path, capsys):
    a, b = _manifest(tmp_path / "a.json", [("x", None), ("y", None)]), _manifest(tmp_path / "b.json", [("y", None), ("y", None)])
    assert cli.main(["validate-manifest", a]) == 0 and cli.main(["validate-manifest", b]) == 1
    assert cli.main(["audit-overlap", a, b]) == 1
    assert cli.main(["generate-splits", a, str(tmp_path / "s")]) == 0 and spark.read.json(str(tmp_path / "s")).count() == 2
    r = _lines(tmp_path / "r.jsonl", [{"response_id": "r", "image_id": "x", "caption": "A dog."}])
    v = _lines(tmp_path / "v.jsonl", [{"category_name": "dog"}])
    assert cli.main(["extract-claims", r, v, str(tmp_path / "c")]) == 0 and spark.read.json(str(tmp_path / "c")).first().object_category == "dog"
    s = _lines(tmp_path / "s.jsonl", [{"image_id": "x", "object_category": "dog", "detector_score": 0.4, "clip_score": None}])
    assert cli.main(["attach-evidence", str(tmp_path / "c"), s, str(tmp_path / "e")]) == 0 and spark.read.json(str(tmp_path / "e")).first().detector_score == 0.4
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x").write_text("1")
    assert cli.main(["lock", str(tmp_path / "f"), str(tmp_path / "l")]) == 0 and cli.main(["verify-lock", str(tmp_path / "f"), str(tmp_path / "l")]) == 0
    (tmp_path / "f" / "x").write_text("2")
    assert cli.main(["verify-lock", str(tmp_path / "f"), str(tmp_path / "l")]) == 1


def test_settings_and_run_manifest(spark, tmp_path):
    from verispan.config import RunConfig, run_manifest

    c = RunConfig.smoke()
    c.save(str(tmp_path / "c.json"))
    assert RunConfig.load(str(tmp_path / "c.json")) == c and c.digest() != RunConfig().digest() and RunConfig().budget == pytest.approx(0.5493)
    for bad in ({"grid": 1}, {"coupling": -1.0}, {"threshold": 1.5}):
        with pytest.raises(ValueError):
            RunConfig.load(bad)
    m = run_manifest(spark, c, "r1", {"claims": "abc"}, str(tmp_path))
    assert m["config"]["grid_steps"] == 20 and m["revision"] is None and json.dumps(m)


def test_tasks_of_a_benchmark(spark):
    d = spark.createDataFrame([(1, " Existence", "a_0007.jpg", "Dog ", "Yes"), (2, "attribute", "8.jpg", "dog", "no"), (3, None, None, None, None)], "id int, kind string, image string, object string, truth string")
    assert [tuple(r) for r in records.map_tasks(d).collect()] == [("task_1", "coco_7", "dog", "supported", "supported"), ("task_2", "coco_8", "dog", "unknown", "unsupported_kind"), ("task_3", None, None, "unknown", "unknown_kind")]
