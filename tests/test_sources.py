import json

import pytest

from verispan.sources import files
from verispan.streaming.ingest import ingest_new


def test_coco_and_questions(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "1.jpg", "width": 5, "height": 6}, {"id": 2, "file_name": "2.jpg", "width": 5, "height": 6}], "categories": [{"id": 3, "name": "dog", "supercategory": "animal"}], "annotations": [{"image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 1]}] * 2}))
    got = {r.image_id: (list(r.present), r.n_boxes) for r in files.coco_presence(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"coco_1": (["dog"], 2), "coco_2": ([], 0)}
    (tmp_path / "q_popular.json").write_text('{"question_id": 1, "image": "COCO_val_000000000042.jpg", "text": "Is there a dog in the image?", "label": "yes"}\n')
    r = files.read_yes_no(spark, str(tmp_path / "q_popular.json")).first()
    assert (r.image_id, r.object_category, r.status, r.variant) == ("coco_42", "dog", "supported", "popular")
    (tmp_path / "bad.json").write_text('{"question_id": 1, "image": "1.jpg", "text": "Is there a dog in the image?"}\n')
    with pytest.raises(Exception, match="lacks label"):
        files.read_yes_no(spark, str(tmp_path / "bad.json")).collect()


def test_append_and_ingest_are_resumable(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        files.append_new(df, str(tmp_path / "out"), ["k"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    src = tmp_path / "in"
    src.mkdir()
    schema = "k string, v int"
    for i in range(2):
        (src / f"{i}.json").write_text(json.dumps({"k": str(i), "v": i}) + "\n")
        ingest_new(spark, str(src), str(tmp_path / "t"), str(tmp_path / "p"), schema, ["k"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["0", "1"]


def test_ingest_keeps_rows_that_come_weeks_late(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    runs = [[("a", "2024-03-30"), ("a", "2024-03-30")], [("b", "2024-03-31")], [("c", "2024-01-02"), ("a", "2024-03-30"), (None, "2024-01-01"), (None, "2024-01-01")], [(None, "2024-01-01"), ("d", None)]]
    for i, rows in enumerate(runs):
        (src / f"{i}.json").write_text("".join(json.dumps({"k": k, "t": t and t + "T00:00:00"}) + "\n" for k, t in rows))
        ingest_new(spark, str(src), str(tmp_path / "t"), str(tmp_path / "p"), "k string, t timestamp", ["k"], "t")
    ingest_new(spark, str(src), str(tmp_path / "t"), str(tmp_path / "p"), "k string, t timestamp", ["k"], "t")
    assert sorted(str(r.k) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["None", "a", "b", "c", "d"]
