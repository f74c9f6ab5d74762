"""Row numbers over whole tables and over classes of any size, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.lineage import settled

_ROWS = 200_000  # of a range, about


def numbered_rows(df: DataFrame, order: list[str | Column], out: str = "rn", by: list[str] | None = None) -> DataFrame:
    """Adds ``out``: 1, 2, ... in ``order``, over all rows or within each value of ``by``.

    Rows are dealt to ranges of (by, order) and sorted there; a range's rows of a value are ranked in place, and shifted by the counts of
    the ranges before. Ranges cut through a value of ``by`` that has many rows; only rows that are equal in all of ``order`` share a range.
    """
    by = by or []
    n = df.count()
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // _ROWS + 1)
    names = [f"_k{k}" for k in range(len(keys))]
    ranged = df.withColumns(dict(zip(names, keys))).repartitionByRange(parts, *names)
    # The range of a row is written down, so the counts and the rows that they shift are of the same ranges.
    d = settled(ranged.withColumn("_part", F.spark_partition_id()))
    same = [F.col(x) for x in names[: len(by)]]
    within = F.row_number().over(Window.partitionBy("_part", *same).orderBy(*names[len(by) :]))
    size = d.groupBy("_part", *same).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    size = size.select("_part", *same, F.coalesce(before, F.lit(0)).alias("_before"))  # a row a range and value
    here, there = d.withColumn("_own", within).alias("d"), size.alias("s")
    on = F.col("d._part") == F.col("s._part")
    for x in names[: len(by)]:
        on &= F.col(f"d.{x}").eqNullSafe(F.col(f"s.{x}"))
    return here.join(there, on).select(*(F.col(f"d.`{c}`") for c in df.columns), (F.col("_own") + F.col("_before")).alias(out))
