"""Fréchet distance of two sets of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _row(n, one, two):
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([one.tobytes()], pa.binary()), pa.array([two.tobytes()], pa.binary())], ["n", "one", "two"])


def _sums(batches):
    """Of a partition's vectors: how many, their sum and the sum of their outer products, in one row."""
    n, one, two = 0, 0.0, 0.0
    for b in batches:
        if b.num_rows:
            v = np.stack(b.column("v").to_numpy(zero_copy_only=False))
            n, one, two = n + len(v), one + v.sum(axis=0), two + v.T @ v
    if n:
        yield _row(n, one, two)


def _totals(batches):
    """Such rows added up, in one row."""
    n, one, two = 0, 0.0, 0.0
    for b in batches:
        for k in range(b.num_rows):
            n, one, two = n + b["n"][k].as_py(), one + np.frombuffer(b["one"][k].as_py()), two + np.frombuffer(b["two"][k].as_py())
    if n:
        yield _row(n, one, two)


def moments(df: DataFrame, vec: str, merges: int = 8) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance. What comes to the driver is ``merges`` matrices of the dimensions, however many partitions there are."""
    kind = "n long, one binary, two binary"
    parts = df.select(F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL").mapInArrow(_sums, kind).repartition(merges).mapInArrow(_totals, kind).collect()
    n = sum(p.n for p in parts)
    if n < 2:
        return n, np.zeros(0), np.zeros((0, 0))
    mean = sum(np.frombuffer(p.one) for p in parts) / n
    second = sum(np.frombuffer(p.two) for p in parts).reshape(len(mean), len(mean))
    return n, mean, (second - n * np.outer(mean, mean)) / (n - 1)


def frechet(a: DataFrame, b: DataFrame, vec: str) -> DataFrame:
    """One row: the distance; null where a set has fewer than two rows."""
    (n, m, s), (k, q, t) = moments(a, vec), moments(b, vec)
    out = None
    if min(n, k) > 1:
        w, v = np.linalg.eigh(s)
        root = v @ np.diag(np.sqrt(np.clip(w, 0, None))) @ v.T
        cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ t @ root), 0, None)).sum()
        out = round(float(((m - q) ** 2).sum() + np.trace(s) + np.trace(t) - 2 * cross), 6)
    return a.sparkSession.createDataFrame([(out,)], "distance double")
