"""Toxicity by multiple-instance learning: a document is a bag of sentences, toxic if any of them is.

A sentence's score is logistic in its words and their beginnings; a document's is the noisy-or of its sentences', fitted to document
labels alone, over features that stand out in toxic documents. The sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.labelled import held_out, sigmoid, training_rows
from tesserae.llm.words import U, Words, mix

#: Lower-cased letters, digits and non-ASCII bytes; sentence ends and line ends become line ends, the rest spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 10 if c in b".!?\n" else 32 for c in range(256))
_BEGINNINGS = (3, 4, 5, 6, 7)  # bytes
_NONE = 0xFFFFFFFF
MOST_ROWS, MOST_MB = 20_000, 64  # of the labelled rows that are learned from


def bags(texts: list[str | None]):
    """Features of each word (a row for whole words and for each length of beginning; 32 bits of hash), sentence of each word, text of each sentence, and the words."""
    w = Words([(t or "").encode().translate(_TABLE) for t in texts])
    ends = np.flatnonzero(np.frombuffer(w.buf, np.uint8) == 10)
    mark = np.searchsorted(ends, w.starts)
    new = np.ones(len(mark), bool)
    new[1:] = mark[1:] != mark[:-1]
    a, length = np.frombuffer(w.buf, np.uint8), w.ends - w.starts
    out, h = [(w.hashes() >> U(32)).astype(np.uint32)], np.zeros(len(w.starts), U)
    for k in range(max(_BEGINNINGS)):
        h = mix(h * U(257) + a[np.minimum(w.starts + k, len(a) - 1)].astype(U) + U(1))
        if k + 1 in _BEGINNINGS:
            out.append(np.where(length > k + 1, (h >> U(32)).astype(np.uint32), np.uint32(_NONE)))
    return out, np.cumsum(new) - 1, w.text_of()[new], w


def groups(w: Words) -> list[str]:
    """The same for near copies, as a rule: the two least hashes of three words in sequence (or of words, where there are no three)."""
    ok, three = w.inside(3), w.windows(3)
    first = np.searchsorted(np.flatnonzero(ok), w.first)
    three, out = three[ok], []
    for d in range(len(w.count)):
        x = three[first[d] : first[d + 1]]
        x = x if len(x) else w.hashes()[w.first[d] : w.first[d + 1]]
        out.append(",".join(map(str, np.sort(np.unique(x))[:2].tolist())))
    return out


def _toxic_features(batches):
    """Of each document, its different features and its group."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            t = batch.slice(at, 128)
            f, _, _, w = bags(t.column("text").to_pylist())
            own = [np.unique(np.concatenate([x[w.first[d] : w.first[d + 1]] for x in f])).astype("<u4").tobytes() for d in range(t.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(groups(w))], ["f", "g"])


def candidates(documents: list[tuple[str, np.ndarray]], base: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Features that enough toxic documents (group, features) have, how many have each, how many documents and how many features there were.

    Near copies count as one document together, so that words of a copied text don't pass for a cause.
    """
    documents = [(g, f) for g, f in documents if len(f)]
    if not documents:
        return np.zeros(0, np.uint32), np.zeros(0), 0.0, 0
    _, of = np.unique([g for g, _ in documents], return_inverse=True)
    size = np.bincount(of)
    every = np.concatenate([f for _, f in documents])
    features, col = np.unique(every, return_inverse=True)
    n1 = np.bincount(col, np.repeat(1.0 / size[of], [len(f) for _, f in documents]))
    ok = (n1 * -np.log(base) > np.log(len(features)) + 5.0) & (features != _NONE)
    return features[ok], n1[ok], float((1.0 / size[of]).sum()), len(features)


def columns(f: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The number of each feature among ``features`` (ascending), or their count if it isn't one of them."""
    if not len(features):
        return np.zeros(len(f), np.int64)
    at = np.minimum(np.searchsorted(features, f), len(features) - 1)
    return np.where(features[at] == f, at, len(features))


def hits(f: list[np.ndarray], s: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, column) of every chosen feature, by sentence."""
    cols, rows = [], []
    for x in f:
        c = columns(x, features)
        at = np.flatnonzero(c < len(features))
        cols.append(c[at])
        rows.append(s[at])
    row, col = np.concatenate(rows), np.concatenate(cols)
    order = np.argsort(row, kind="stable")
    return row[order], col[order]


def _clean_counts(shared):
    """How many clean documents of a partition have each candidate that any has."""

    def count(batches):
        features, total = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                f, _, _, w = bags(batch.slice(at, 128).column("text").to_pylist())
                row, col = hits(f, w.text_of(), features)
                total += np.bincount(np.unique(row * len(features) + col) % max(len(features), 1), minlength=len(features))
        col = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(col), pa.array(total[col])], ["col", "n"])

    return count


def chosen(n1: np.ndarray, toxic: float, n0: np.ndarray, clean: float, tested: int) -> np.ndarray:
    """Columns whose share of toxic documents is above the base rate by more than the best of ``tested`` would reach by chance."""
    base, n = toxic / (toxic + clean), n0 + n1
    q = np.clip(n1 / np.maximum(n, 1e-12), 1e-9, 1 - 1e-9)
    gain = np.where(q > base, n * (q * np.log(q / base) + (1 - q) * np.log((1 - q) / (1 - base))), 0.0)
    return np.flatnonzero(gain > np.log(max(tested, 2)) + 5.0)


def _hit(shared):
    def find(batches):
        features = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                t = batch.slice(at, 128)
                f, s, of, _ = bags(t.column("text").to_pylist())
                row, col = hits(f, s, features)
                n = np.bincount(row, minlength=len(of))
                cut, ends = np.searchsorted(of, np.arange(t.num_rows + 1)), np.append(0, np.cumsum(n))
                yield pa.RecordBatch.from_arrays(
                    [t.column("y"), *(pa.array([x.astype("<u4").tobytes() for x in part], pa.binary()) for part in ([col[ends[i] : ends[j]] for i, j in zip(cut, cut[1:])], [n[i:j] for i, j in zip(cut, cut[1:])]))],
                    ["y", "c", "n"],
                )

    return find


def gradient(weight: np.ndarray, y: np.ndarray, f: np.ndarray, n: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of the mean negative log-likelihood of documents (labels ``y``) under the noisy-or of their sentences, by the weights and the offset (last).

    ``count`` has the sentences of each document, ``n`` the features of each sentence, ``f`` those features.
    """
    s, first = np.repeat(np.arange(len(n)), n), np.cumsum(count) - count
    p = sigmoid(weight[-1] + np.bincount(s, weight[f], minlength=len(n)))
    none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first)
    some = np.maximum(-np.expm1(none), 1e-9)
    of_doc = np.where(y > 0, -np.exp(none) / some, 1.0)  # by a sentence's margin, over its score
    g = np.repeat(of_doc, count) * p / len(y)
    grad = np.bincount(f, g[s], minlength=len(weight)).astype(float)
    grad[-1] += g.sum()
    return grad


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], k: int, epochs: int = 40, batch: int = 512, rate: float = 0.3, decay: float = 1e-6, seed: int = 1) -> np.ndarray:
    """Weights of ``k`` features and the offset from (label, features, features per sentence) of each document, by AdaGrad on the noisy-or likelihood."""
    weight, square = np.full(k + 1, 4.0), np.full(k + 1, 1e-6)  # each was chosen because it marks toxic documents
    toxic = np.mean([y for y, _, _ in examples]) if examples else 0.0
    weight[-1] = np.log(max(toxic, 1e-3) / 100)  # few sentences of few documents
    examples = [x for x in examples if len(x[2])]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for some in np.array_split(order.permutation(len(examples)), max(1, len(examples) // batch)):
            if not len(some):
                continue
            y, f, n = (np.concatenate([np.atleast_1d(examples[d][c]) for d in some]) for c in range(3))
            count = np.array([len(examples[d][2]) for d in some])
            grad = gradient(weight, y, f.astype(np.int64), n, count) + decay * np.append(weight[:-1], 0.0)
            square += grad**2
            weight -= rate * grad / np.sqrt(square)
    return weight


Model = tuple[np.ndarray, np.ndarray]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_rows: int = MOST_ROWS, most_mb: int = MOST_MB) -> Model:
    """(features, weights and offset) from a sample of the labelled rows outside the held-out fold (see ``training_rows``); no other column is read.

    What comes to the driver is bounded by that sample: the different features of its toxic documents, a count per candidate, then
    the places of the features that stand out. No feature that passes the tests is dropped.
    """
    rows = training_rows(docs, labels, label_col, most_rows, most_mb).select("y", "text")
    share, documents_in_all = rows.agg(F.avg((F.col("y") > 0).cast("int")), F.count("*")).first()
    share = share or 0.0
    if not 0 < share < 1:
        return np.zeros(0, np.uint32), np.array([np.log((share + 1e-3) / (1 - share + 1e-3))])
    share_of = docs.sparkSession.sparkContext.broadcast
    toxic = rows.where("y > 0").select("text").mapInArrow(_toxic_features, "f binary, g string").collect()
    clean = documents_in_all - len(toxic)
    features, n1, documents, tested = candidates([(r.g, np.frombuffer(bytes(r.f), "<u4")) for r in toxic], share)
    del toxic
    counts = rows.where("y <= 0").select("text").mapInArrow(_clean_counts(share_of(features)), "col long, n long").groupBy("col").agg(F.sum("n").alias("n")).collect()
    n0 = np.zeros(len(features), np.int64)
    for r in counts:
        n0[r.col] = r.n
    features = features[chosen(n1, documents, n0, clean, tested)]
    found = rows.mapInArrow(_hit(share_of(features)), "y int, c binary, n binary").collect()
    found = sorted((int(r.y > 0), bytes(r.c), bytes(r.n)) for r in found)  # the same order for every partitioning
    return features, fit([(y, np.frombuffer(c, "<u4"), np.frombuffer(n, "<u4").astype(np.int64)) for y, c, n in found], len(features))


def sentence_scores(texts: list[str | None], model: Model):
    """Score of each sentence, sentence of each word, text of each sentence, and the words."""
    features, weight = model
    f, s, of, w = bags(texts)
    row, col = hits(f, s, features)
    return sigmoid(weight[-1] + np.bincount(row, weight[col], minlength=len(of))), s, of, w


def document_scores(p: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """Noisy-or; a text without sentences has 0."""
    return -np.expm1(np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=texts))


_OFFENDING = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _scored(shared, least: float):
    def score(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                t = batch.slice(at, 256)
                texts = t.column("text").to_pylist()
                p, s, of, w = sentence_scores(texts, model)
                found = [[] for _ in texts]
                first = np.searchsorted(s, np.arange(len(of) + 1))
                for k in np.flatnonzero(p >= least).tolist():
                    d, data = int(of[k]), (texts[of[k]] or "").encode()
                    i, j = int(w.starts[first[k]] - w.offsets[d]), int(w.ends[first[k + 1] - 1] - w.offsets[d])
                    before = len(data[:i].decode())
                    found[d].append({"start": before, "end": before + len(data[i:j].decode()), "score": float(p[k])})
                yield pa.RecordBatch.from_arrays([t.column("row"), pa.array(document_scores(p, of, len(texts))), pa.array(found, _OFFENDING)], ["row", "score", "offending"])

    return score


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Columns ``keep``, ``score`` (0 to 1), and the ``offending`` sentences of score ``least`` or more as character spans.

    A null text, or one without words, has score 0. Repeated rows are each scored; an empty table gives an empty result. Columns not in ``keep`` are not read.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample
    made = rows.mapInArrow(_scored(shared, least), f"row {rows.schema['row'].dataType.simpleString()}, score double, offending array<struct<start:int,end:int,score:double>>")
    return made.select("row.*", "score", "offending")


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_mb: int = MOST_MB) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.5 or more) and offending sentences of each document.

    Learned from at most about ``most_rows`` labelled rows and ``most_mb`` MB of their texts. Null and empty texts have score 0; a null id counts as held out.
    Repeated rows are each scored; without labels of both classes all sentences score alike; an empty table gives an empty result; other columns are not read.
    """
    found = score(docs, train(docs, labels, most_rows=most_rows, most_mb=most_mb), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
