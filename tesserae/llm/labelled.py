"""Labelled rows for training: the fold rule, and a sample bounded in rows and in bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import checkpointed

FOLDS = 5
_HASH = 1 << 62
_TASKS = 32  # of the sample, which is small whatever the tables are


def held_out(id_col: Column) -> Column:
    """True if the crc32 of the id as text leaves 0 modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS == 0


def threshold(wanted: int, found: int) -> int:
    """Of 62-bit hashes, those below it are ``wanted`` of ``found``, about."""
    return _HASH if found <= wanted else wanted * _HASH // found


def _drawn(seed: int, bound: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 2) < F.lit(bound)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, most_rows: int, most_mb: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of rows outside the held-out fold, written to the shared folder: about ``most_rows`` labels and ``most_mb`` MB of texts at most.

    Rows are drawn by a hash of the id. A text of over a sixteenth of ``most_mb`` teaches nothing (it is scored like any other). Rows of a null id or
    label are left out; of several labels for an id the largest holds; repeated documents are each a row. The drawn labels are bounded by
    ``most_rows``, so they are broadcast and the table of texts is not shuffled.
    """
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    own = own.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    if (bound := threshold(most_rows, own.count())) < _HASH:
        own = own.where(_drawn(5, bound))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(size <= (most_mb << 20) // 16)
    rows = checkpointed(texts.join(F.broadcast(own), "id").repartition(_TASKS, "id"))
    if (bound := threshold(most_mb << 20, rows.agg(F.sum(size)).first()[0] or 0)) < _HASH:
        rows = rows.where(_drawn(6, bound))
    return rows


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of the margin, by Newton steps with smoothed targets."""
    n1 = y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    scale = max(float(np.abs(margin).mean()), 1e-9)
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ w)
        grad = x.T @ (p - t) + 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])
