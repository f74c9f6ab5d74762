import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tesserae.sources import images as S
from tesserae.sources import sinks as K


def png(path, w=2, h=2, value=7):
    rows = b"".join(b"\0" + bytes([value]) * (3 * w) for _ in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_folders_and_decoding(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    png(tmp_path / "a.PNG")
    png(tmp_path / "sub" / "b.png")
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    assert S.files(spark, str(tmp_path)).count() == 2
    assert S.files(spark, str(tmp_path), recursive=True).count() == 3
    d = S.decoded(spark, str(tmp_path)).collect()
    assert sorted((r.width is None, r.path.rsplit("/", 1)[1]) for r in d) == [(False, "a.PNG"), (True, "bad.png")]
    assert S.pixel_md5(S.decoded(spark, str(tmp_path)).where("bytes IS NOT NULL")).first().md5


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("image,label,other\na.png,cat,1\n")
    assert S.labelled_csv(spark, str(tmp_path / "x.csv")).collect() == [("a.png", "cat")]
    (tmp_path / "y.csv").write_text("image\na.png\n")
    with pytest.raises(ValueError, match="label"):
        S.labelled_csv(spark, str(tmp_path / "y.csv"))
    have, lack = S.resolved(S.labelled_csv(spark, str(tmp_path / "x.csv")), spark.createDataFrame([("/d/b.png",)], "path string"))
    assert have.count() == 0 and lack.first().image == "a.png"


def test_coco_round_trip(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a", "width": 10, "height": 10}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0], "area": 12.0, "iscrowd": 0, "score": None}], "categories": [{"id": 1, "name": "insect"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    i, a, c = S.coco(spark, str(tmp_path / "a.json"))
    got = json.loads(K.coco_document(i, a, c, corners=True).first().value)
    assert got["annotations"][0]["bbox"] == [1.0, 2.0, 4.0, 6.0] and got["images"] == doc["images"]
    p = spark.createDataFrame([(1, 1, [0.0, 0.0, 2.0, 5.0], 0.5)], "image_id long, category_id long, bbox array<double>, score double")
    r = S.results(p, i).first()
    assert (r.id, r.area, r.iscrowd) == (1, 10.0, 0)
    with pytest.raises(Exception, match="unknown image 9"):
        S.results(p.withColumn("image_id", F.lit(9).cast("long")), i).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "cat", "train"), ("b", "dog", "val")], "image string, label string, split string")
    K.write_splits(df, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=train", "split=val"]
    K.write_counts(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    boxes = spark.createDataFrame([("im", 0, "insect", 10, 20, 50, 30, 100, 100)], "stem string, category int, name string, x int, y int, w int, h int, width int, height int")
    K.write_yolo(boxes, str(tmp_path / "y"))
    assert spark.read.text(str(tmp_path / "y")).first().value == "0 0.350000 0.350000 0.500000 0.300000"
    assert "<xmax>60</xmax>" in K.voc_document(boxes).first().xml


def test_tracking_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1,1,0,0,5,5,1,1,1\n1,-1,0,0,5,5,1,1,1\n2,1,0,0,5,5,1,2,1\n")
    assert S.tracks(spark, str(tmp_path / "t.txt")).count() == 2
    assert S.tracks(spark, str(tmp_path / "t.txt"), classes=[2]).count() == 1
