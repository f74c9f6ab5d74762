"""Masks as tables of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boundary(px: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """Pixels (by..., x, y) where a mask differs from its neighbour to the right, below, or both: a pixel outside next to the mask counts too.

    The last column has a neighbour below alone, the last row one to the right alone, and the last pixel none.
    """
    shift = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))))).alias("d")
    moved = px.select(*by, "x", "y", shift).select(*by, (F.col("x") - F.col("d.dx")).alias("x"), (F.col("y") - F.col("d.dy")).alias("y"), (F.col("d.dx") + 2 * F.col("d.dy")).alias("part")).where("x >= 0 AND y >= 0")
    f = moved.groupBy(*by, "x", "y").agg(*(F.bool_or(F.col("part") == k).alias(f"p{k}") for k in range(4)))
    right, below, both = (F.col("p0") != F.col(f"p{k}") for k in (1, 2, 3))
    last_x, last_y = F.col("x") == width - 1, F.col("y") == height - 1
    return f.where(F.when(last_x & last_y, False).when(last_y, right).when(last_x, below).otherwise(right | below | both)).select(*by, "x", "y")


def dilated(px: DataFrame, by: list[str], width: int, height: int, kernel: int) -> DataFrame:
    """All pixels within a square of odd size ``kernel`` around one of the mask."""
    r = kernel // 2
    steps = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in range(-r, r + 1) for y in range(-r, r + 1)))).alias("d")
    d = px.select(*by, "x", "y", steps).select(*by, (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    return d.where(f"x BETWEEN 0 AND {width - 1} AND y BETWEEN 0 AND {height - 1}").distinct()


def boundary_f(px: DataFrame, gt: str, dt: str, width: int, height: int, kernel: int) -> DataFrame:
    """F measure of boundaries per image, of pixels (image, kind, x, y): shares of each boundary that are within the other's dilated one. Two without a boundary agree; one without gives 0."""
    by = ["image", "kind"]
    edge = boundary(px, by, width, height)
    other = F.when(F.col("kind") == gt, dt).otherwise(gt)
    met = edge.join(dilated(edge, by, width, height, kernel).withColumn("kind", other), ["image", "kind", "x", "y"], "left_semi")
    count = lambda d, a: d.groupBy("image").agg(*(F.count_if(F.col("kind") == k).alias(f"{a}_{n}") for k, n in ((gt, "gt"), (dt, "dt"))))
    c = px.select("image").distinct().join(count(edge, "n"), "image", "left").join(count(met, "m"), "image", "left").na.fill(0)
    n_gt, n_dt = F.col("n_gt"), F.col("n_dt")
    precision = F.when(n_dt == 0, 1.0).when(n_gt == 0, 0.0).otherwise(F.col("m_dt") / n_dt)
    recall = F.when(n_gt == 0, 1.0).when(n_dt == 0, 0.0).otherwise(F.col("m_gt") / n_gt)
    c = c.withColumns({"precision": precision, "recall": recall})
    return c.withColumn("f", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
