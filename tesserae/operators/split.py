"""Seeded open-set splits of a labelled table: quotas by windows, one ``split`` column, no sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.keys import order_key
from tesserae.operators.lineage import settled
from tesserae.operators.numbering import numbered_rows


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, largest first. Null labels are no class."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def unknown_classes(counts: DataFrame, target: DataFrame, seed: int, label: str = "label") -> DataFrame:
    """Classes in shuffled order, taken until their rows reach the target; the class that crosses it is taken.

    ``counts``: one row a class (label, n). ``target``: one row with column ``target``.
    """
    w = Window.orderBy(order_key(seed, label), label).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("n").over(w) - F.col("n")
    return counts.select(label, "n", before.alias("before")).crossJoin(target).where(F.col("before") < F.col("target")).select(label)


def ratio_split(df: DataFrame, id_col: str, label: str, unknown: float, test: float, val: float, seed: int) -> DataFrame:
    """Adds ``split``: unknown classes go to test.unknown, then a share of each known class to test.known, and of
    the rest of each class to val. Shares are rounded half to even, as pandas' group sample does; the order within a class is a seeded hash of the id."""
    df = df.where(F.col(label).isNotNull())
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    target = counts.agg(F.floor(F.sum("n") * F.lit(unknown)).alias("target"))
    away = unknown_classes(counts, target, seed, label).withColumn("is_unknown", F.lit(True))
    ranked = (
        numbered_rows(df, [order_key(seed, id_col), id_col], "rn", [label])
        .join(counts.join(away, label, "left"), label)  # a row a class: adaptive execution broadcasts it if it is small
        .withColumn("n_test", F.bround(F.col("n") * test))
        .withColumn("n_val", F.bround((F.col("n") - F.col("n_test")) * val))
    )
    split = (
        F.when(F.col("is_unknown"), "test.unknown")
        .when(F.col("rn") <= F.col("n_test"), "test.known")
        .when(F.col("rn") <= F.col("n_test") + F.col("n_val"), "val")
        .otherwise("train")
    )
    return ranked.withColumn("split", split).drop("is_unknown", "rn", "n", "n_test", "n_val")


def count_split(df: DataFrame, id_col: str, label: str, unknown: int, test: int, least: int, most: int, val: int, seed: int) -> DataFrame:
    """Split by counts: unknown classes as in ``ratio_split``; the first ``test`` rows of the others, by class and then in shuffled order; of the
    classes that still have ``least`` rows, ``most`` rows at most each, of which the first ``val`` are validation. Rows beyond are left out."""
    df = df.where(F.col(label).isNotNull())
    away = unknown_classes(df.groupBy(label).agg(F.count("*").alias("n")), df.sparkSession.range(1).select(F.lit(unknown).alias("target")), seed, label)
    known = settled(numbered_rows(df.join(away, label, "left_anti"), [label, order_key(seed, id_col), id_col]))
    late = known.where(F.col("rn") > test)
    left = late.groupBy(label).agg(F.count("*").alias("n"), F.min("rn").alias("first"))  # a class's rows follow each other
    rest = late.join(left, label).where((F.col("n") >= least) & (F.col("rn") - F.col("first") < most)).drop("n", "first").withColumnRenamed("rn", "known")
    rest = numbered_rows(rest, ["known"])
    cols = [*(F.col(c) for c in df.columns)]
    return (
        df.join(away, label, "left_semi").select(*cols, F.lit("test.unknown").alias("split"))
        .unionByName(known.where(F.col("rn") <= test).select(*cols, F.lit("test.known").alias("split")))
        .unionByName(rest.select(*cols, F.when(F.col("rn") <= val, "val").otherwise("train").alias("split")))
    )
