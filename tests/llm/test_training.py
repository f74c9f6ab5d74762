"""The fitted parts against plain versions: noisy-or gradient, log-count ratios, dual coordinate steps, sampling bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import labelled, quality_classifier, toxicity


def noisy_or_loss(weight, docs):
    """Mean negative log-likelihood, in plain loops over (label, sentences of features)."""
    total = 0.0
    for y, sentences in docs:
        none = math.prod(1 - 1 / (1 + math.exp(-(weight[-1] + sum(weight[k] for k in s)))) for s in sentences)
        total -= math.log(1 - none) if y else math.log(none)
    return total / len(docs)


def packed(docs):
    y = np.array([float(y) for y, _ in docs])
    f = np.array([k for _, d in docs for s in d for k in s], np.int64)
    n = np.array([len(s) for _, d in docs for s in d])
    return y, f, n, np.array([len(d) for _, d in docs])


def bags_of(r, n):
    return [(r.randrange(2), [[r.randrange(5) for _ in range(r.randrange(4))] for _ in range(r.randrange(1, 5))]) for _ in range(n)]


def test_gradient_is_that_of_the_noisy_or_likelihood():
    r = random.Random(3)
    docs, weight = bags_of(r, 40), np.array([r.uniform(-2, 2) for _ in range(6)])
    got = toxicity.gradient(weight, *packed(docs))
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        assert got[k] == pytest.approx((noisy_or_loss(weight + step, docs) - noisy_or_loss(weight - step, docs)) / 2e-6, abs=1e-6)


def test_fit_lowers_the_loss_to_its_least():
    r = random.Random(4)
    docs = [(int(any(0 in s for s in d)), d) for _, d in bags_of(r, 300)]
    docs = [(y if r.random() < 0.9 else 1 - y, d) for y, d in docs]
    examples = [(y, np.array([k for s in d for k in s], np.int64), np.array([len(s) for s in d])) for y, d in docs]
    weight = toxicity.fit(examples, 5, epochs=5000)
    assert np.abs(toxicity.gradient(weight, *packed(docs))).max() < 0.01
    for _ in range(50):
        other = weight + np.array([r.gauss(0, 1) for _ in range(6)])
        assert noisy_or_loss(weight, docs) < noisy_or_loss(other, docs)


def plain_examples(n=60, features=12):
    r = random.Random(6)
    out = []
    for _ in range(n):
        y = r.randrange(2)
        f = sorted({r.randrange(features) for _ in range(4)} | ({1} if y and r.random() < 0.7 else set()))
        out.append((y, f))
    return out


def plain_ratio(examples):
    seen = {k for _, f in examples for k in f}
    count = {y: {k: 1 + sum(k in f for z, f in examples if z == y) for k in seen} for y in (0, 1)}
    total = {y: sum(count[y].values()) for y in (0, 1)}
    return {k: math.log(count[1][k] / total[1]) - math.log(count[0][k] / total[0]) for k in seen}


def test_log_count_ratios():
    examples = plain_examples()
    ratio = quality_classifier.log_count_ratio([(y, np.array(f, np.uint32)) for y, f in examples])
    expected = plain_ratio(examples)
    assert np.count_nonzero(ratio) <= len(expected)
    for k, x in expected.items():
        assert ratio[k] == pytest.approx(x)


def test_dual_coordinate_descent():
    examples, cost = plain_examples(), 1.0
    ratio = plain_ratio(examples)
    rows = []
    for y, f in examples:
        length = math.sqrt(sum(ratio[k] ** 2 for k in f)) or 1e-9
        rows.append((1.0 if y else -1.0, {k: ratio[k] / length for k in f} | {-1: 1.0}))
    # exact steps in a plain order until nothing moves: the one solution of the dual, up to its weights
    alpha, w = [0.0] * len(rows), {}
    for _ in range(4000):
        for i, (s, x) in enumerate(rows):
            grad = s * sum(w.get(k, 0.0) * v for k, v in x.items()) - 1
            new = min(max(alpha[i] - grad / sum(v * v for v in x.values()), 0.0), cost)
            for k, v in x.items():
                w[k] = w.get(k, 0.0) + (new - alpha[i]) * s * v
            alpha[i] = new
    got = quality_classifier.descend([(y, np.array(f, np.uint32)) for y, f in examples], quality_classifier.log_count_ratio([(y, np.array(f, np.uint32)) for y, f in examples]), cost, epochs=4000, tolerance=1e-9)
    for k, x in w.items():
        assert got[k] == pytest.approx(x, abs=1e-4)


def test_a_long_sentence_of_one_word_is_learned_from(spark):
    r = random.Random(1)
    docs, labels = [], []
    for k in range(300):
        bad = k % 5 == 0
        text = " ".join(f"w{r.randrange(300)}" for _ in range(30)) + ". " + ("you vile thing." if bad else "fine.")
        docs.append((k, text + (" vile" * 100_000 if k == 5 else "")))
        labels.append((k, int(bad)))
    d, x = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {row.doc_id: row.predicted for row in toxicity.toxicity(d, x).collect()}
    assert all(got[k] == y for k, y in labels)


def test_features_are_not_capped():
    features = np.arange(3000, dtype=np.uint32)
    found, n1, n, tested = toxicity.candidates([(str(k), features) for k in range(40)], 0.1)
    assert len(found) == tested == 3000 and n == 40
    assert len(toxicity.chosen(n1, n, np.zeros(3000), 360, tested)) == 3000


@pytest.mark.parametrize("found", [0, 5, 20_000, 10**6, 10**11, 10**14])
def test_the_threshold_draws_what_is_wanted(found):
    bound = labelled.threshold(20_000, found)
    assert bound == 1 << 62 if found <= 20_000 else abs(bound / 2**62 * found - 20_000) < 1


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text"))
    docs = docs.unionByName(spark.range(4000, 4004).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long "), 100_000).alias("text")))
    labels = docs.select("doc_id", F.lit(1).alias("y0"))
    assert 800 < labelled.training_rows(docs, labels, "y0", 1000).count() < 1200
    rows = labelled.training_rows(docs, labels, "y0", 10**6, most_mb=1)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0.8 * 2**20 < size < 1.2 * 2**20 and rows.where("id >= 4000").isEmpty()
