"""Checks of parameters, shards, tar archives, documents of any size, class averages, boundaries."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.checks import Parameter, checked, time_range, transforms
from tesserae.operators import masks, tracking
from tesserae.sources import images as S
from tesserae.sources import sinks as K


def test_parameters():
    spec = [Parameter("seed", int, 42), Parameter("out_dir", required=True, aliases=("--out-dir",)), Parameter("mode", default="ratio", choices=("ratio", "count")), Parameter("copy", bool, False), Parameter("share", float)]
    good = checked(spec, {"--out-dir": "x", "seed": "7", "copy": None})
    assert good.passed and good.values == {"seed": 7, "out_dir": "x", "mode": "ratio", "copy": True, "share": None} and good.given == {"seed", "out_dir", "copy"}
    bad = checked(spec, {"seed": "x", "mode": "odd", "copy": "perhaps", "what": 1, "share": "a"})
    assert bad.errors == ["Unknown parameter: what", "seed expects integer", "Missing required parameter: out_dir", "mode must be one of: ratio | count", "copy expects boolean (true/false)", "share expects float"]


def test_time_ranges():
    assert time_range(None, None) == (0.0, None) and time_range(1, 3) == (1, 3)
    for bad in ((-1, None), (None, -2), (3, 3), (3, 1)):
        with pytest.raises(ValueError):
            time_range(*bad)


def test_transforms():
    known, presets = {"flip", "blur"}, {"light": ["flip"]}
    assert transforms(None, presets, known) == [] and transforms("light", presets, known) == ["flip"] and transforms('["blur", "flip"]', presets, known) == ["blur", "flip"]
    for bad in ("heavy", '{"a": 1}', '["odd"]', "[1]"):
        with pytest.raises(ValueError):
            transforms(bad, presets, known)


def test_shards_and_archives(spark, tmp_path):
    assert [S.shard_of_epoch(["a", "b", "c"], k) for k in range(5)] == ["a", "b", "c", "a", "b"]
    for n in range(2):
        with tarfile.open(tmp_path / f"s{n}.tar", "w") as tar:
            for k in range(3):
                info = tarfile.TarInfo(f"d/{k}.txt")
                info.size = k
                tar.addfile(info, io.BytesIO(b"x" * k))
    got = sorted((r.archive[-6:], r.member, r.size, bytes(r.content)) for r in S.tar_members(spark, str(tmp_path)).collect())
    assert got == [(f"s{n}.tar", f"d/{k}.txt", k, b"x" * k) for n in range(2) for k in range(3)]


def test_document_of_many_parts(spark, tmp_path):
    images = spark.range(500).select("id", F.concat(F.lit('n"\n'), F.col("id").cast("string")).alias("file_name")).repartition(7)
    anns = spark.range(0).select("id", F.col("id").alias("image_id"), F.array(F.lit(0.0)).alias("bbox"))
    cats = spark.createDataFrame([(1, None)], "id long, name string")
    K.write_coco(images, anns, cats, str(tmp_path / "d.json"))
    d = json.loads((tmp_path / "d.json").read_text())
    assert sorted(x["id"] for x in d["images"]) == list(range(500)) and d["images"][0]["file_name"].startswith('n"\n')
    assert d["annotations"] == [] and d["categories"] == [{"id": 1, "name": None}]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["d.json"]


def test_yolo_and_voc_files(spark, tmp_path):
    assert K.data_yaml(["b", "a", "b"]) == 'train: images\nnc: 2\nnames: ["b", "a"]\n'
    boxes = spark.createDataFrame([("im", 0, "insect", 10, 20, 50, 30, 100, 100, [10.0, 20.0, 60.0, 50.0]), ("im", 0, "insect", 10, 20, 50, 30, 100, 100, None)], "stem string, category int, name string, x int, y int, w int, h int, width int, height int, polygon array<double>")
    K.write_yolo(boxes, str(tmp_path / "y"), ["insect"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "y/labels")).collect()) == ["0 0.100000 0.200000 0.600000 0.500000", "0 0.350000 0.350000 0.500000 0.300000"]
    K.write_voc(boxes, str(tmp_path / "v"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v/ImageSets/Main/default")).collect()] == ["im"]


def test_tracklet_documents(spark, tmp_path):
    doc = {"videos": [{"id": 1, "height": 5, "width": 5, "length": 3}], "annotations": [{"id": 4, "video_id": 1, "category_id": 2, "bboxes": [[1, 1, 2, 3], None, [0, 0, 4, 4]], "areas": [6, None, 16], "iscrowd": 0}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    v, a = S.tracklets(spark, str(tmp_path / "a.json"), one_class=True)
    r = a.first()
    assert (r.image_id, r.category_id, r.bboxes[1], r.area) == (1, -1, [0.0] * 4, 22 / 3)
    p = spark.createDataFrame([(1, 2, [[0.0, 0.0, 2.0, 2.0], None], 0.5), (1, 2, [[0.0, 0.0, 2.0, 2.0]], 0.9)], "image_id long, category_id long, bboxes array<array<double>>, score double")
    got = {r.id: (r.score, r.areas, r.area) for r in S.tracklet_results(p, v).collect()}
    assert got == {1: (0.9, [4.0], 4.0), 2: (0.5, [4.0, 0.0], 2.0)}
    with pytest.raises(Exception, match="unknown image 8"):
        S.tracklet_results(p.withColumn("image_id", F.lit(8).cast("long")), v).collect()


def test_boundaries(spark):
    r = np.random.default_rng(3)
    m = r.random((4, 6, 7)) < 0.5
    m[2] = False
    rows = [(int(k // 2), "go"[k % 2], int(x), int(y)) for k in range(4) for y, x in zip(*np.nonzero(m[k]))]

    def edge(s):
        out = np.zeros_like(s)
        for y in range(6):
            for x in range(7):
                e, d, c = x < 6 and s[y, x + 1], y < 5 and s[y + 1, x], x < 6 and y < 5 and s[y + 1, x + 1]
                out[y, x] = False if x == 6 and y == 5 else s[y, x] ^ e if y == 5 else s[y, x] ^ d if x == 6 else bool(s[y, x] ^ e or s[y, x] ^ d or s[y, x] ^ c)
        return out

    px = spark.createDataFrame(rows, "image int, kind string, x int, y int")
    got = {(b.image, b.kind, b.x, b.y) for b in masks.boundary(px, ["image", "kind"], 7, 6).collect()}
    assert got == {(k // 2, "go"[k % 2], int(x), int(y)) for k in range(4) for y, x in zip(*np.nonzero(edge(m[k])))}
    f = {b.image: b.f for b in masks.boundary_f(px, "g", "o", 7, 6, 3).collect()}
    wide = lambda s: np.array([[s[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for x in range(7)] for y in range(6)])
    g, o = edge(m[0]), edge(m[1])
    p, q = (o & wide(g)).sum() / o.sum(), (g & wide(o)).sum() / g.sum()
    assert f == {0: pytest.approx(2 * p * q / (p + q)), 1: 0.0}


def test_track_ids_over_videos(spark):
    rows = [(0, 1, 5), (1, 1, 6), (2, 2, 5), (3, 3, 7), (4, 2, 5), (5, 3, 6), (6, 1, 5)]  # order, video, track
    got = {r.i: r.track for r in tracking.unique_track_ids(spark.createDataFrame(rows, "i long, video long, track long"), "track", "video", ["i"]).collect()}
    assert got == {0: 8, 1: 9, 2: 10, 3: 7, 4: 10, 5: 11, 6: 8}
