"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, under a linear hinge loss.

N-grams are of words (one and two) and of word shapes (one and two; runs of lower-case or non-ASCII, upper-case and digits as a letter each, other bytes as they
are, once a run). The loss is minimised by dual coordinate descent, and a logistic curve of the margin, fitted on rows that the machine did not see, gives the score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.labelled import calibrated, held_out, sigmoid, training_rows
from tesserae.llm.words import SPACE, U, Words, mix

BITS = 20
MOST_ROWS, MOST_MB = 12_000, 32  # of the labelled rows that are learned from
_SHAPE = np.array([ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else 10 if SPACE[c] else c for c in range(256)], np.uint8)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shape(text: bytes) -> bytes:
    a = _SHAPE[np.frombuffer(text, np.uint8)]
    return a[np.append(True, a[1:] != a[:-1])].tobytes() if len(a) else b""


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Different features of the texts: (features, first), those of text d at first[d]:first[d + 1]."""
    data = [(t or "").encode() for t in texts]
    words, shapes = Words([x.translate(_LOWER) for x in data]), Words([_shape(x) for x in data])
    parts = []
    for kind, w in enumerate((words, shapes)):
        of, h = w.text_of(), w.hashes()
        two = w.inside(2)
        parts += [(of, h ^ U(7 * kind + 1)), (of[: len(two)][two], w.windows(2)[two] ^ U(7 * kind + 2))]
    key = np.concatenate([(of.astype(U) << U(32)) | (mix(h) >> U(64 - BITS)) for of, h in parts])
    key = np.unique(key)
    return (key & U((1 << 32) - 1)).astype(np.int64), np.searchsorted(key >> U(32), np.arange(len(texts) + 1).astype(U))


def _featured(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            t = batch.slice(at, 128)
            f, first = ngrams(t.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([t.column("y"), pa.array([f[i:j].astype("<u4").tobytes() for i, j in zip(first, first[1:])], pa.binary())], ["y", "f"])


def log_count_ratio(examples: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """log((1 + documents of class 1 with the feature) / their sum, over the same of class 0); 0 for a feature that was not seen."""
    count = np.ones((2, 1 << BITS))
    for y, f in examples:
        count[y, f] += 1
    seen = count.sum(axis=0) > 2
    ratio = np.log(count[1] / count[1, seen].sum()) - np.log(count[0] / count[0, seen].sum()) if seen.any() else np.zeros(1 << BITS)
    return np.where(seen, ratio, 0.0)


def descend(examples: list[tuple[int, np.ndarray]], ratio: np.ndarray, cost: float = 1.0, epochs: int = 10, tolerance: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Weights of the features and the offset, by dual coordinate descent on the hinge loss of unit-length scaled indicators."""
    weight, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(examples))
    sign = np.array([1.0 if y else -1.0 for y, _ in examples])
    length = np.array([max(np.sqrt((ratio[f] ** 2).sum()), 1e-9) for _, f in examples])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for k in order.permutation(len(examples)).tolist():
            f = examples[k][1]
            x = ratio[f] / length[k]
            grad = sign[k] * (weight[f] @ x + weight[-1]) - 1.0
            if (alpha[k] == 0 and grad > 0) or (alpha[k] == cost and grad < 0):
                continue
            most = max(most, abs(grad))
            new = min(max(alpha[k] - grad / (2.0 if len(f) else 1.0), 0.0), cost)
            step, alpha[k] = (new - alpha[k]) * sign[k], new
            weight[f] += step * x
            weight[-1] += step
        if most < tolerance:
            break
    return weight


def margins(f: np.ndarray, first: np.ndarray, weight: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    of, n = np.repeat(np.arange(len(first) - 1), np.diff(first)), len(first) - 1
    r = ratio[f]
    length = np.sqrt(np.bincount(of, r * r, minlength=n))
    return np.bincount(of, weight[f] * r, minlength=n) / np.maximum(length, 1e-9) + weight[-1]


def fit(examples: list[tuple[int, np.ndarray]]):
    """(weights, ratios, slope, offset): three of four rows fit the machine, the rest its curve."""
    own, rest = [x for k, x in enumerate(examples) if k % 4], examples[::4]
    if len({y for y, _ in own}) < 2 or len({y for y, _ in rest}) < 2:  # too few labels to learn from
        y = np.mean([y for y, _ in examples]) if examples else 0.5
        return np.zeros((1 << BITS) + 1), np.zeros(1 << BITS), 0.0, float(np.log((y + 1e-3) / (1 - y + 1e-3)))
    ratio = log_count_ratio(own)
    weight = descend(own, ratio)
    first = np.cumsum([0, *(len(f) for _, f in rest)])
    margin = margins(np.concatenate([f for _, f in rest]).astype(np.int64), first, weight, ratio)
    return weight, ratio, *calibrated(margin, np.array([y for y, _ in rest]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = MOST_ROWS, most_mb: int = MOST_MB):
    """A model from a sample of the labelled rows outside the held-out fold (see ``training_rows``); no other column is read."""
    rows = training_rows(docs, labels, label_col, most_rows, most_mb).select("y", "text").mapInArrow(_featured, "y int, f binary").collect()
    rows = sorted(((r.y, bytes(r.f)) for r in rows), key=lambda x: (zlib.crc32(x[1]), x))  # the same order for every partitioning
    return fit([(int(y > 0), np.frombuffer(f, "<u4")) for y, f in rows])


def _scored(shared):
    def score(batches):
        weight, ratio, slope, offset = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                t = batch.slice(at, 128)
                f, first = ngrams(t.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([t.column("row"), pa.array(sigmoid(slope * margins(f, first, weight, ratio) + offset))], ["row", "score"])

    return score


def score(docs: DataFrame, model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1).

    A null or empty text has the score of the offsets alone. Repeated rows are each scored; an empty table gives an empty result. Columns not in ``keep`` are not read.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text_col).alias("text"))
    weight, ratio, slope, offset = model
    shared = docs.sparkSession.sparkContext.broadcast((weight.astype(np.float32), ratio.astype(np.float32), slope, offset))
    return rows.mapInArrow(_scored(shared), f"row {rows.schema['row'].dataType.simpleString()}, score double").select("row.*", "score")


def quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_mb: int = MOST_MB) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.3 or more) of each document.

    Learned from at most about ``most_rows`` labelled rows and ``most_mb`` MB of their texts. Null and empty texts have the score of the offsets alone; a null
    id counts as held out. Repeated rows are each scored; without labels of both classes all score alike; an empty table gives an empty result; other columns are not read.
    """
    found = score(docs, train(docs, labels, most_rows=most_rows, most_mb=most_mb), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
