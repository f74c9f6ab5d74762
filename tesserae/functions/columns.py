"""Columns by name and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widened(array: str, n: int, prefix: str) -> list[Column]:
    """The first ``n`` items of an array as columns ``prefix`` and a number; null beyond its end."""
    return [F.get(array, F.lit(k)).alias(f"{prefix}{k}") for k in range(n)]


def named(df: DataFrame, prefix: str) -> list[str]:
    """Columns whose name begins with ``prefix``, in their order."""
    return [c for c in df.columns if c.startswith(prefix)]


def rounded(c: Column, places: int) -> Column:
    """As SQL engines on doubles round: the scaled double to the nearest whole, halves away from zero. ``F.round`` goes by the decimal digits, which differ at halves."""
    scale = 10.0**places
    size = F.abs(c) * scale
    whole = F.floor(size)
    near = F.signum(c) * (whole + F.when(size - whole >= 0.5, 1).otherwise(0)) / scale
    return F.when(size < 2.0**52, near).otherwise(c)
