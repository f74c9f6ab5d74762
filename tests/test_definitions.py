"""Small cases by hand, and plain versions, of operators whose definition is easily missed."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import boxes as B
from tesserae.operators import detection, naming, neighbours, numbering, records


def plain_unique(names):
    used, out = set(), []
    for base in names:
        name, k = base, 1
        while name.lower() in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name.lower())
        out.append(name)
    return out


@pytest.mark.parametrize("names", [["a", "a", "a_1"], ["a_1", "a", "a"], ["A", "a", "a_1", "A_1", "a_1_1", "a"], ["x", "y", "x"]])
def test_unique_names_by_hand(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    assert [r.unique_name for r in naming.unique_names(df, "name", ["i"]).orderBy("i").collect()] == plain_unique(names)


def test_unique_names_match_the_loop(spark):
    r = random.Random(3)
    names = [r.choice(["a", "A", "b", "c_d"]) + r.choice(["", "", "_1", "_2", "_1_1", "_12", "_x"]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(names)), "i long, name string").repartition(7)
    got = [x.unique_name for x in naming.unique_names(df, "name", ["i"]).orderBy("i").collect()]
    assert got == plain_unique(names) and len({x.lower() for x in got}) == len(got)


def test_clean_filename_composes(spark):
    names = ["café", unicodedata.normalize("NFD", "café"), unicodedata.normalize("NFD", "Ệx"), "q́a", "K.png", "..a b.", "...", "", "á̧", "漢字 x", "ño", "x̸"]

    def plain(name):
        return re.sub(r"[^A-Za-z0-9._-]+", "_", unicodedata.normalize("NFC", name)).strip("._") or "untitled"

    df = spark.createDataFrame([(x,) for x in names], "t string")
    assert [r.c for r in df.select(naming.clean_filename(F.col("t")).alias("c")).collect()] == [plain(x) for x in names]


def plain_zoom(x, y, w, h, width, height, area, share):
    def shift(at, size, new, most):
        s = (new - size) / 2
        if at - s + new > most:
            s = at + new - most
        return min(at, s)

    nw, nh = min(w + max(0.2 * w, 16), width), min(h + max(0.2 * h, 16), height)
    if (full := area / (nw * nh)) > share:
        nw, nh = min(nw * math.sqrt(full / share), width), min(nh * math.sqrt(full / share), height)
    return x - shift(x, w, nw, width), y - shift(y, h, nh, height), nw, nh


def test_zoomed_boxes(spark):
    r = random.Random(1)
    rows = [(float(r.randrange(90)), float(r.randrange(70)), float(r.randrange(1, 60)), float(r.randrange(1, 60)), float(r.randrange(1, 2000))) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, w double, h double, a double")
    for share in (0.25, 0.05):
        got = df.select(*(c.alias(n) for c, n in zip(B.zoomed(*(F.col(c) for c in "xywh"), 120, 100, F.col("a"), share), "xywh"))).collect()
        for row, g in zip(rows, got):
            assert list(g) == pytest.approx(plain_zoom(*row[:4], 120, 100, row[4], share))


def test_images_in_messages(spark):
    cases = [('"text"', 0), ("null", 0), (None, 0), ("no json", 0), ("[]", 0), ('{"type": "image"}', 0), ('[{"type": "image"}, {"type": "text"}, "image", 3, null, {"type": "image", "x": [{"type": "image"}]}]', 2), ('[{"type": 1}, {"type": "image_url"}]', 0)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string")
    assert [r.n for r in df.select(records.images_in(F.col("c")).alias("n")).collect()] == [n for _, n in cases]


def test_best_truth(spark):
    rows = [(1, "a", 0, 0.5), (1, "b", 1, 0.7), (1, "c", 2, 0.7), (2, "a", 0, None), (2, "b", 1, 0.9), (3, "a", 0, 1.0), (3, "b", 1, None), (3, "c", 2, None), (4, "a", 0, 0.0), (4, "b", 1, 0.0)]
    got = {r.image: r.truth for r in detection.best_truth(spark.createDataFrame(rows, "image long, truth string, place int, f1 double")).collect()}
    assert got == {1: "b", 2: "a", 3: "c", 4: "a"}


def test_counted_f1(spark):
    pairs = spark.createDataFrame([("x", 2, 3), ("y", 0, 0), ("z", 1, 0)], "key string, gt long, dt long")
    matches = spark.createDataFrame([("x", 0.8), ("x", 0.5)], "key string, weight double")
    got = {r.key: (r.tps, r.fps, r.fns) for r in detection.counted_f1(pairs, matches, [0.5, 0.75, 0.9]).collect()}
    assert got == {"x": ([2, 1, 0], [1, 2, 3], [0, 1, 2]), "y": ([0] * 3, [0] * 3, [0] * 3), "z": ([0] * 3, [0] * 3, [1] * 3)}


def plain_voc(hits, npos):
    """(area, eleven points) of hits in score order."""
    tp, rec, prec = 0, [], []
    for k, h in enumerate(hits, 1):
        tp += h
        rec.append(tp / npos)
        prec.append(tp / k)
    eleven = sum(max([p for r, p in zip(rec, prec) if r >= t], default=0) for t in np.arange(0.0, 1.1, 0.1)) / 11
    area = sum(max(prec[k:]) * (rec[k] - (rec[k - 1] if k else 0)) for k in range(len(rec)))
    return area, eleven


def test_voc_precision(spark):
    r = random.Random(2)
    rows, expected = [], {}
    for c in range(6):
        scored = sorted(((round(r.random(), 2), i) for i in range(30 * c)), key=lambda x: (-x[0], x[1]))
        hits = [r.random() < 0.4 for _ in scored]
        rows += [(c, i, 0, s, h, True) for (s, i), h in zip(scored, hits)] + [(c, 1000, 0, 0.99, True, False)]
        npos = sum(hits) + c + 1
        expected[c] = (npos, *plain_voc(hits, npos))
    hits = spark.createDataFrame(rows, "category long, image long, n long, score double, hit boolean, counts boolean")
    positives = spark.createDataFrame([(c, x[0]) for c, x in expected.items()] + [(9, 0)], "category long, npos long")
    got = {x.category: x for x in detection.voc_precision(hits, positives, ["category"], bins=10).collect()}
    for c, (_, area, eleven) in expected.items():
        assert (got[c].ap, got[c].ap11) == pytest.approx((area, eleven))
    assert (got[9].ap, got[9].ap11) == (0.0, 0.0)


def test_numbers_over_ranges(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", None]), r.randrange(100), k) for k in range(500)]
    df = spark.createDataFrame(rows, "c string, x long, id long").repartition(5)
    order = lambda t: (t[1], t[2])
    got = {x.id: x.rn for x in numbering.numbered_rows(df, ["x", "id"]).collect()}
    assert got == {t[2]: k for k, t in enumerate(sorted(rows, key=order), 1)}
    got = {x.id: x.rn for x in numbering.numbered_rows(df, ["x", "id"], by=["c"]).collect()}
    for c in ("hot", "a", "b", None):
        assert [got[t[2]] for t in sorted((t for t in rows if t[0] == c), key=order)] == list(range(1, 1 + sum(t[0] == c for t in rows)))


@pytest.mark.parametrize("side", [1000, 17])
def test_neighbours_in_cells(spark, side):
    r = np.random.default_rng(5)
    v = r.integers(-2, 3, (60, 3)).astype(float)
    v[7] = v[3]
    v[9] = 0
    df = spark.createDataFrame([(k, int(k % 4), x.tolist()) for k, x in enumerate(v)] + [(99, 1, None)], "id long, label long, v array<double>")
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(norm > 0, norm, 1)
    dot = np.round(u @ u.T, 9)
    got = {}
    for x in neighbours.nearest(df, "id", "v", "label", 5, side=side).orderBy("q_id", "k").collect():
        got.setdefault(x.q_id, []).append(x.i_id)
    assert got == {q: sorted((i for i in range(60) if i != q), key=lambda i: (-dot[q, i], i))[:5] for q in range(60)}
    means = {(x.q_id, x.i_label): x.m for x in neighbours.mean_distances(df, "id", "v", "label", side=side).collect()}
    for q in range(0, 60, 7):
        for c in range(4):
            d = [math.sqrt(max(2 - 2 * dot[q, i], 0)) for i in range(60) if i != q and i % 4 == c]
            assert means[q, c] == pytest.approx(sum(d) / len(d))
