"""Documents of more objects than a row may hold."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tesserae.sources import images as S
from tesserae.sources import sinks as K


def test_large_voc_documents_are_whole(spark, tmp_path):
    d = spark.range(5000).select(F.when(F.col("id") < 4000, "a/ b").when(F.col("id") < 4990, None).otherwise("c").alias("stem"), F.lit("insect").alias("name"), (F.col("id") * 7 % 90).alias("x"), (F.col("id") % 50).alias("y"), F.lit(5).alias("w"), F.lit(6).alias("h"), F.when(F.col("id") < 1000, 60).otherwise(120).alias("width"), F.lit(100).alias("height"))
    K.write_voc(d, str(tmp_path), large=100)
    files = {(p.parent.name, p.name): p.read_text() for p in (tmp_path / "Annotations").glob("*/*") if p.name[0] not in "._"}
    assert sorted((stem, name[-6:] if name.startswith("part") else name) for stem, name in files) == [("stem=__HIVE_DEFAULT_PARTITION__", "120x100.xml"), ("stem=a%2F b", "120x100.xml"), ("stem=a%2F b", "60x100.xml"), ("stem=c", "00.txt"[-6:])]
    counts = {}
    for key, text in files.items():
        root = ET.fromstring(text)  # a whole document: head first, end last
        counts[key[0], root.findtext("size/width")] = len(root.findall("object"))
        things = [x for x in text.split("\n") if x.startswith("<object>")]
        assert things == sorted(things)
    assert counts == {("stem=a%2F b", "60"): 1000, ("stem=a%2F b", "120"): 3000, ("stem=__HIVE_DEFAULT_PARTITION__", "120"): 990, ("stem=c", "120"): 10}
    assert not (tmp_path / "Annotations.large").exists()
    assert sorted(str(r.value) for r in spark.read.text(str(tmp_path / "ImageSets/Main/default")).collect()) == ["", "a/ b", "c"]


def test_coco_documents_are_shared_by_tasks(spark, tmp_path):
    names = ["a", 'q"\n\\', "] }, {", "  é", None]
    images = spark.createDataFrame([(k, names[k % 5], 10, 20) for k in range(300)], "id long, file_name string, width int, height int").repartition(7)
    anns = spark.range(2000).select("id", (F.col("id") % 300).alias("image_id"), F.lit(1).cast("long").alias("category_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.col("id").cast("double")).alias("bbox"), F.lit(2.5).alias("area"), F.lit(0).alias("iscrowd"), F.lit(None).cast("double").alias("score"))
    cats = spark.createDataFrame([(1, "x")], "id long, name string").repartition(3)  # empty files beside
    path = str(tmp_path / "d.json")
    K.write_coco(images, anns, cats, path)
    doc = json.loads((tmp_path / "d.json").read_text())
    assert {k: len(v) for k, v in doc.items()} == {"images": 300, "annotations": 2000, "categories": 1}
    shared, whole = S.coco(spark, path, lines=True), S.coco(spark, path)
    for a, b in zip(shared, whole):
        assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count()
    assert sorted(str(r.file_name) for r in shared[0].collect()) == sorted(str(names[k % 5]) for k in range(300))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        several = S.coco(spark, path, lines=True)[1]
        assert several.rdd.getNumPartitions() > 4 and several.agg(F.sum("id")).first()[0] == sum(range(2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    K.write_coco(images.limit(0), anns.limit(0), cats, path)
    assert [x.count() for x in S.coco(spark, path, lines=True)] == [0, 0, 1] and json.loads((tmp_path / "d.json").read_text())["images"] == []
    (tmp_path / "other.json").write_text(json.dumps(doc, indent=1))
    with pytest.raises(Exception, match="no record on this line"):
        S.coco(spark, str(tmp_path / "other.json"), lines=True)[0].collect()
