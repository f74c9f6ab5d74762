"""Scores that differ in their last binary digits only, and halves at the last decimal place."""

import math

from pyspark.sql import functions as F

from tesserae.functions.columns import rounded
from tesserae.operators import detection as T


def test_quantile_meets_the_next_score(spark):
    low = high = 0.6
    while 0.3 * high == 0.3 * low:
        high = math.nextafter(high, 1)
    cut = 0.3 * low + (0.3 * high - 0.3 * low) * ((1 - 2 / 3) * 2)
    assert cut == 0.3 * high > 0.3 * low
    columns = "image long, g long, d long, " + ", ".join(f"{s}{c} double" for s in "gd" for c in "xywh") + ", prob double"
    rows = [(1, 0, d, 0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 1.0, 1.0, p) for d, p in enumerate([0.9, high, low])]
    found = T.one_to_many_pairs(spark.createDataFrame(rows, columns), "prob", threshold=0.1, top=2).collect()
    assert [r.d for r in found] == [0]


def test_rounded_by_the_scaled_double(spark):
    x = [0.30343749999999997, -0.30343749999999997, 0.5198374999999999, 0.0, 2.5, None, 1e300]
    want = [0.303438, -0.303438, 0.519837 if 0.5198374999999999 * 1e6 < 519837.5 else 0.519838, 0.0, 2.5, None, 1e300]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(rounded(F.col("x"), 6).alias("r")).collect()
    assert 0.30343749999999997 * 1e6 == 303437.5 and [r.r for r in got] == want
