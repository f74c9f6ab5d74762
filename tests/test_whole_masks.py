"""Masks from all rows of a table, in a number of images that grows with it."""

from pyspark.sql import functions as F

from tesserae.plans import registry
from tests.conftest import SF


def test_no_row_is_left_out(spark):
    boxes = registry.queries()["mask_boxes"](spark, SF)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.floor(F.col("l_orderkey") / 50), "l_linenumber", F.col("l_partkey") % 16, F.col("l_suppkey") % 16)
    assert boxes.agg(F.sum("area")).first()[0] == len({tuple(r) for r in rows.collect()})
    assert boxes.select("image").distinct().count() > 20
