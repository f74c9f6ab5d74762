"""Deterministic order keys: the same in every engine and for every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, *cols: str | Column) -> Column:
    """md5 of the seed and the columns, ``:``-joined: stands in for a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)))
