"""Detection metrics, matches and rotated boxes against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import boxes as B
from tesserae.operators import dedup, metrics
from tesserae.operators import detection as T
from tesserae.operators.assignment import matched


def best_total(weights, n, m):
    """Heaviest one-to-one pairs of a small table of weights, by trying all."""
    rows, cols = (range(n), range(m)) if n <= m else (range(m), range(n))
    at = (lambda i, j: weights.get((i, j), 0.0)) if n <= m else (lambda i, j: weights.get((j, i), 0.0))
    return max((sorted(at(i, p[k]) for k, i in enumerate(rows)) for p in itertools.permutations(cols, len(rows))), key=sum, default=[])


def test_hits_in_score_order_take_the_best_that_is_left(spark):
    gt = spark.createDataFrame([(1, "a", 1, 100.0), (1, "a", 2, 5000.0)], "image long, category string, n long, area double")
    dt = spark.createDataFrame([(1, "a", 1, 0.9, 100.0), (1, "a", 2, 0.8, 100.0), (1, "a", 3, 0.7, 9000.0), (2, "a", 1, 0.6, 100.0)], "image long, category string, n long, score double, area double")
    p = spark.createDataFrame([(1, "a", 1, 1, 0.9), (1, "a", 1, 2, 0.8), (1, "a", 2, 2, 0.6)], "image long, category string, g long, d long, iou double")
    get = lambda t, area=T.ANY_AREA, most=9: {(r.image, r.n): (r.hit, r.counts) for r in T.score_order_hits(gt, dt, p, [t], most, area).collect()}
    assert get(0.5) == {(1, 1): (True, True), (1, 2): (True, True), (1, 3): (False, True), (2, 1): (False, True)}
    assert get(0.7)[1, 2] == (False, True)  # what it would match best is taken
    small = get(0.5, (0.0, 1000.0))
    assert small[1, 2] == (True, False) and small[1, 3] == (False, False)  # ground truth, then a detection, out of the range of areas
    assert set(get(0.5, most=1)) == {(1, 1), (2, 1)}
    npos = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 0), ("c", 0.5, 3)], "category string, threshold double, npos long")
    r = {x.category: (x.ap, x.ar) for x in T.interpolated_precision(T.score_order_hits(gt, dt, p, [0.5], 9), npos, ["category", "threshold"]).collect()}
    assert r["a"] == pytest.approx((1.0, 1.0)) and r["b"] == (-1.0, -1.0) and r["c"] == (0.0, 0.0)


def test_running_hits_cross_bins(spark):
    rnd = random.Random(3)
    rows = [(i, 1, round(rnd.random(), 1), rnd.random() < 0.5) for i in range(60)]
    got = T.running_hits(spark.createDataFrame(rows, "image long, n long, score double, hit boolean").withColumn("c", F.lit(1)), ["c"], bins=7).collect()
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    expected = {r[0]: (sum(x[3] for x in order[: k + 1]), k + 1) for k, r in enumerate(order)}
    assert {r.image: (r.tp, r.k) for r in got} == expected


def test_image_level_f1_by_hand(spark):
    rnd = random.Random(5)
    images, pairs, exp = [], [], {"tp": 0, "fp": 0, "fn": 0, "pfp": 0, "local": [], "il": [0, 0, 0, 0]}
    for i in range(25):
        n, m = rnd.randint(0, 3), rnd.randint(0, 3)
        w = {(a, b): rnd.random() for a in range(n) for b in range(m)}
        images.append((i, n, m))
        pairs += [(i, a, b, x) for (a, b), x in w.items()]
        tp = sum(x >= 0.5 for x in best_total(w, n, m))
        exp["tp"] += tp
        exp["fp"] += m - tp
        exp["fn"] += n - tp
        exp["pfp"] += (m - tp) if n else 0
        exp["il"][0 if n and m else 1 if m else 2 if n else 3] += 1
        if n and m:
            p, r = tp / (m + 1e-4), tp / (n + 1e-4)
            exp["local"].append(2 * p * r / (p + r + 1e-4))
    d = spark.createDataFrame(pairs, "image long, g long, d long, weight double")
    r = T.image_level_f1(spark.createDataFrame(images, "image long, gt long, dt long"), matched(d, "image", "g", "d", "weight"), [0.5]).first()
    assert (r.tp, r.fp, r.fn) == (exp["tp"], exp["fp"], exp["fn"])
    assert [r.il_tp, r.il_fp, r.il_fn, r.il_tn] == exp["il"]
    assert r.positive_macro_f1 == pytest.approx(sum(exp["local"]) / len(exp["local"]))
    p, c = exp["tp"] / (exp["tp"] + exp["pfp"] + 1e-4), exp["tp"] / (exp["tp"] + exp["fn"] + 1e-4)
    a, b, e, n = exp["il"]
    mcc = (a * n - b * e) / (math.sqrt((a + b) * (a + e) * (n + b) * (n + e)) + 1e-6)
    assert r.cgf1 == pytest.approx(2 * p * c / (p + c + 1e-4) * mcc)


def test_least_cost_pairs_by_trying_all(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(6):
        n, m = rnd.randint(1, 3), rnd.randint(1, 4)
        box = lambda: [round(rnd.random() * 0.5, 3) for _ in range(2)] + [round(0.1 + rnd.random() * 0.4, 3) for _ in range(2)]
        g, d = [box() for _ in range(n)], [box() for _ in range(m)]
        rows += [(i, a, b, *g[a], *d[b], rnd.random()) for a in range(n) for b in range(m)]
    cols = "image long, g long, d long, gx double, gy double, gw double, gh double, dx double, dy double, dw double, dh double, prob double"

    def cost(r):
        _, _, _, x, y, w, h, u, v, k, q, p = r
        l1 = abs(x + w / 2 - u - k / 2) + abs(y + h / 2 - v - q / 2) + abs(w - k) + abs(h - q)
        i = max(min(x + w, u + k) - max(x, u), 0) * max(min(y + h, v + q) - max(y, v), 0)
        hull = (max(x + w, u + k) - min(x, u)) * (max(y + h, v + q) - min(y, v))
        union = w * h + k * q - i
        return l1 - p - (i / union - (hull - union) / hull)

    got = {r.image: (r.c, r.n) for r in T.least_cost_pairs(spark.createDataFrame(rows, cols), "prob").groupBy("image").agg(F.sum("cost").alias("c"), F.count("*").alias("n")).collect()}
    for i in range(6):
        mine = {(r[1], r[2]): 20 - cost(r) for r in rows if r[0] == i}
        n, m = (1 + max(k[j] for k in mine) for j in (0, 1))
        best = best_total(mine, n, m)
        assert got[i] == (pytest.approx(20 * len(best) - sum(best)), min(n, m))


def test_roc_of_classes_by_pairs(spark):
    rnd = random.Random(8)
    items = [(rnd.randint(0, 2), [round(rnd.random(), 1) for _ in range(3)]) for _ in range(40)]
    df = spark.createDataFrame([(y, k, s[k]) for y, s in items for k in range(3)], "y int, k int, s double")
    half = lambda a, b: 1.0 if a > b else 0.5 if a == b else 0.0

    def auc(k, rest):
        both = [half(s[k], t[k]) for y, s in items if y == k for z, t in items if z in rest]
        return sum(both) / len(both)

    r = metrics.roc_auc_classes(df, "y", "k", "s").first()
    assert r.ovo == pytest.approx(sum(auc(k, {j}) for k in range(3) for j in range(3) if j != k) / 6)
    assert r.ovr == pytest.approx(sum(auc(k, {0, 1, 2} - {k}) for k in range(3)) / 3)
    assert metrics.roc_auc_classes(df.where("y = 1"), "y", "k", "s").first().ovo is None


def test_rotated_overlap_by_counting_points(spark):
    rnd = random.Random(9)
    boxes = [(rnd.uniform(3, 7), rnd.uniform(3, 7), rnd.uniform(1, 5), rnd.uniform(1, 5), rnd.uniform(-200, 200)) for _ in range(24)]
    rows = [(k, *boxes[k], *boxes[k + 1]) for k in range(0, 24, 2)] + [(99, 1.0, 1.0, 1.0, 1.0, 30.0, 9.0, 9.0, 1.0, 1.0, 0.0)]
    names = [f"{p}{c}" for p in "ab" for c in ("x", "y", "w", "h", "t")]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names))
    poly = [B.corners(*(F.col(f"{p}{c}") for c in ("x", "y", "w", "h", "t"))) for p in "ab"]
    got = {r.k: r.i for r in df.select("k", B.convex_overlap(*poly).alias("i")).collect()}

    def inside(b, x, y):
        c, s = math.cos(math.radians(b[4])), math.sin(math.radians(b[4]))
        u, v = x - b[0], y - b[1]
        return abs(u * c - v * s) <= b[2] / 2 and abs(u * s + v * c) <= b[3] / 2

    for k, *v in rows:
        step = 0.05
        seen = sum(inside(v[:5], (i + 0.5) * step, (j + 0.5) * step) and inside(v[5:], (i + 0.5) * step, (j + 0.5) * step) for i in range(240) for j in range(240)) * step * step
        assert got[k] == pytest.approx(seen, abs=0.15)
    assert got[99] == 0


def test_greedy_near_duplicates_equal_a_plain_loop(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(63) for _ in range(6)]
    hashes = [b ^ sum(1 << rnd.randrange(63) for _ in range(rnd.randint(0, 3))) for b in base for _ in range(12)] + [7, 7, 7]
    rnd.shuffle(hashes)
    kept = []
    for i, h in enumerate(hashes):
        if all((h ^ hashes[k]).bit_count() > 3 for k in kept):
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    assert sorted(r.id for r in dedup.near_kept(df, "id", "h", 3).collect()) == kept
    assert dedup.near_kept(df.limit(0), "id", "h", 3).count() == 0


def _boxes(rnd, n):
    return [[round(rnd.random() * 0.5, 3), round(rnd.random() * 0.5, 3), round(0.1 + rnd.random() * 0.4, 3), round(0.1 + rnd.random() * 0.4, 3)] for _ in range(n)]


_PAIR_COLUMNS = "image long, g long, d long, gx double, gy double, gw double, gh double, dx double, dy double, dw double, dh double, prob double"


def _overlaps(r):
    _, _, _, x, y, w, h, u, v, k, q, _ = r
    i = max(min(x + w, u + k) - max(x, u), 0) * max(min(y + h, v + q) - max(y, v), 0)
    hull = (max(x + w, u + k) - min(x, u)) * (max(y + h, v + q) - min(y, v))
    union = w * h + k * q - i
    return i / union, i / union - (hull - union) / hull


@pytest.mark.parametrize("by_overlap,repeats", [(False, 1), (True, 1), (False, 2)])
def test_focal_and_repeated_matches_by_trying_all(spark, by_overlap, repeats):
    rnd, rows = random.Random(17), []
    for i in range(5):
        g, d = _boxes(rnd, rnd.randint(1, 2)), _boxes(rnd, rnd.randint(1, 4))
        probs = [rnd.choice([0.0, 1.0, rnd.random()]) for _ in d]
        rows += [(i, a, b, *g[a], *d[b], probs[b]) for a in range(len(g)) for b in range(len(d))]

    def cost(r):
        _, _, _, x, y, w, h, u, v, k, q, p = r
        giou = _overlaps(r)[1]
        p = p * (giou + 1) / 2 if by_overlap else p
        focal = 0.75 * p**2 * math.log(1 - p + 1e-8) - 0.25 * (1 - p) ** 2 * math.log(p + 1e-8)
        return abs(x + w / 2 - u - k / 2) + abs(y + h / 2 - v - q / 2) + abs(w - k) + abs(h - q) + focal - giou

    found = T.least_cost_pairs(spark.createDataFrame(rows, _PAIR_COLUMNS), "prob", focal=(0.25, 2.0), by_overlap=by_overlap, repeats=repeats).collect()
    assert len({(r.image, r.d) for r in found}) == len(found)  # a prediction has one target
    for i in range(5):
        mine = {(r[1] * repeats + c, r[2]): 50 - cost(r) for r in rows if r[0] == i for c in range(repeats)}
        n, m = (1 + max(k[j] for k in mine) for j in (0, 1))
        best = best_total(mine, n, m)
        got = [r.cost for r in found if r.image == i]
        assert len(got) == min(n, m) and sum(got) == pytest.approx(50 * len(best) - sum(best))
    with pytest.raises(ValueError):
        T.least_cost_pairs(spark.createDataFrame(rows, _PAIR_COLUMNS), "prob", repeats=0)


@pytest.mark.parametrize("top", [1, 3])
def test_one_to_many_pairs_by_quantiles(spark, top):
    import numpy as np

    rnd, rows = random.Random(23), []
    for i, n in enumerate([1, 2, 3, 4, 9, 12]):
        g, d = _boxes(rnd, 3), _boxes(rnd, n)
        d[-1] = d[0]  # ties
        probs = [rnd.random() for _ in d]
        probs[-1] = probs[0]
        rows += [(i, a, b, *g[a], *d[b], probs[b]) for a in range(3) for b in range(n)]
    want = set()
    for i, a in {(r[0], r[1]) for r in rows}:
        mine = [(r[2], 0.3 * r[11] + 0.7 * _overlaps(r)[0]) for r in rows if r[:2] == (i, a)]
        n = len(mine)
        cut = np.quantile([s for _, s in mine], 1 - top / n) if n >= top else -1
        want |= {(i, a, d) for d, s in mine if s > cut and s > 0.2}
    found = T.one_to_many_pairs(spark.createDataFrame(rows, _PAIR_COLUMNS), "prob", threshold=0.2, top=top).collect()
    assert {(r.image, r.g, r.d) for r in found} == want and len(want) > 3
    empty = spark.createDataFrame([], _PAIR_COLUMNS)
    assert T.one_to_many_pairs(empty, "prob").count() == 0 and T.least_cost_pairs(empty, "prob").count() == 0
