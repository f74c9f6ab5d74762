"""Annotations of tracks: every box of a table, numbered over all tracks."""

from itertools import count

import pytest

from tesserae.operators.tracking import track_annotations
from tesserae.plans import registry
from tests.conftest import SF


@pytest.mark.parametrize("per", [1, 3, 1000])
def test_numbers_run_over_parts_and_tracks(spark, per):
    rows = [(v, t, i, i % 3 > 0) for v in "ba" for t in (2, 1) for i in range(0, 40, t + (v == "a"))]
    got = track_annotations(spark.createDataFrame(rows, "video string, track long, image long, present boolean").repartition(5), per).collect()
    ids, expected = count(1), []
    for v, t in sorted({r[:2] for r in rows}):
        images = sorted(r[2:] for r in rows if r[:2] == (v, t))
        expected += [(v, t, i, k, next(ids)) for k, (i, present) in enumerate(images, 1) if present]
    assert sorted((r.video, r.track, r.image, r.frame, r.id) for r in got) == sorted(expected)


def test_no_image_is_left_out(spark):
    boxes = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 4 <> 0")
    d = registry.queries()["tracklets_to_annotations"](spark, SF)
    assert boxes.where("l_orderkey >= 200").count() > 0
    assert d.count() == d.select("id").distinct().count() == boxes.count()
