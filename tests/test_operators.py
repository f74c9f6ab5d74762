"""Hand-computed cases of the operators, and invariants that no repartitioning may break."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import boxes as B
from tesserae.operators import dedup, metrics, naming, split
from tesserae.operators.assignment import assign, matched

BOX = "array<struct<s:double,n:long,x:long,y:long,w:long,h:long>>"


def test_metrics_of_six_rows(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (0, 0), (1, 2), (2, 2)], "y int, p int")
    r = metrics.classification(df, "y", "p").first()
    assert r.accuracy == pytest.approx(4 / 6) and r.balanced_accuracy == pytest.approx(2 / 3) and r.kappa_quadratic == pytest.approx(0.75)


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first().auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first().auc is None


def test_iou_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 0, 10, 10), (0, 0, 0, 0, 0, 0, 0, 0)], "ax int, ay int, aw int, ah int, bx int, `by` int, bw int, bh int")
    assert [r[0] for r in df.select(B.iou("a", "b")).collect()] == pytest.approx([1 / 3, 0.0])


def test_greedy_suppression_is_not_one_pass(spark):
    items = [(-0.9, 1, 0, 0, 10, 10), (-0.8, 2, 0, 2, 10, 10), (-0.7, 3, 0, 4, 10, 10)]  # 1-2 and 2-3 overlap, 1-3 less
    df = spark.createDataFrame([(items,)], f"items {BOX}")
    assert [x.n for x in df.select(B.suppressed(F.col("items"), 0.5, False)).first()[0]] == [1, 3]
    equal = spark.createDataFrame([([(-0.9, 1, 0, 0, 10, 10), (-0.8, 2, 5, 0, 10, 10)],)], f"items {BOX}")
    third = 50 / 150
    assert [len(equal.select(B.suppressed(F.col("items"), third, inc)).first()[0]) for inc in (False, True)] == [2, 1]


def test_names(spark):
    df = spark.createDataFrame([("..a b.",), ("...",), ("ok-1.png",)], "n string")
    assert [r[0] for r in df.select(naming.clean_filename(F.col("n"))).collect()] == ["a_b", "untitled", "ok-1.png"]


def test_near_duplicates_kept_greedily(spark):
    ids = spark.createDataFrame([(1, 0), (2, 3), (3, 15)], "id long, h long")
    pairs = dedup.hamming_pairs(ids, "id", "h", 2)
    assert sorted((r.a, r.b, r.distance) for r in pairs.collect()) == [(1, 2, 2), (2, 3, 2)]
    kept = dedup.greedy_kept(pairs, ids.select("id"))
    assert sorted(r.id for r in kept.collect()) == [1, 3]


def test_hamming_pairs_match_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.integers(-(2**63), 2**63, 40)
    hashes = [int(x) for b in base for x in (b, b ^ (1 << int(r.integers(63))), b ^ 0b10101)]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    expected = {(i, j) for i, j in itertools.combinations(range(len(hashes)), 2) if ((hashes[i] ^ hashes[j]) % 2**64).bit_count() <= 4}
    got = [(x.a, x.b) for x in dedup.hamming_pairs(df, "id", "h", 4).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_unknown_classes_overshoot(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 4)], "label string, n long")
    target = spark.range(1).select(F.lit(6).alias("target"))
    kept = [r.label for r in split.unknown_classes(counts, target, 1).collect()]
    sizes = dict(a=5, b=3, c=4)
    assert sum(sizes[k] for k in kept) >= 6 > sum(sizes[k] for k in kept) - min(sizes[k] for k in kept) or len(kept) == 3


def test_split_is_a_partition_and_ignores_partitioning(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("string").alias("label"))
    a, b = (split.ratio_split(d, "id", "label", 0.1, 0.2, 0.1, 3) for d in (df, df.repartition(9)))
    assert a.count() == 400 == a.select("id").distinct().count()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 2), (2, 5), (5, 5)):
        cost = r.random((n, m))
        rows, cols = assign(cost)
        assert len(set(rows)) == len(set(cols)) == min(n, m)
        short, long_ = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(short[i, p[i]] for i in range(len(short))) for p in itertools.permutations(range(long_), len(short)))
        assert cost[rows, cols].sum() == pytest.approx(best)


def test_matching_per_group(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.6), (1, 2, 2, 0.9), (2, 5, 5, 0.1)], "g long, l long, r long, w double")
    assert sorted((x.g, x.l, x.r) for x in matched(df, "g", "l", "r", "w").collect()) == [(1, 1, 1), (1, 2, 2), (2, 5, 5)]


def test_a_perfect_track_has_full_hota(spark):
    from tesserae.operators.tracking import ALPHAS, hota

    gt = spark.createDataFrame([("s", f, 1) for f in range(5)], "seq string, frame long, g long")
    dt = gt.withColumnRenamed("g", "d")
    pairs = gt.join(dt, ["seq", "frame"]).withColumn("sim", F.lit(1.0))
    rows = hota(pairs, gt, dt).collect()
    assert len(rows) == len(ALPHAS) and all(r.DetA == r.AssA == r.HOTA == r.LocA == 1.0 for r in rows)
    half = hota(pairs.where("frame < 2"), gt, dt).first()
    assert half.tp == 2 and half.DetA == pytest.approx(2 / 8) and half.AssA == pytest.approx(2 / 8)


def test_frechet_distance_equals_its_formula(spark):
    from tesserae.operators.fid import frechet

    r = np.random.default_rng(5)
    a, b = r.normal(size=(40, 4)), r.normal(1, 2, size=(30, 4))
    ma, mb, ca, cb = a.mean(axis=0), b.mean(axis=0), np.cov(a.T), np.cov(b.T)
    expected = ((ma - mb) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * np.sqrt(np.linalg.eigvals(ca @ cb).real).sum()
    x, y = (spark.createDataFrame([(v.tolist(),) for v in m], "v array<double>") for m in (a, b))
    for parts in (1, 23):
        assert frechet(x.repartition(parts), y.repartition(parts), "v").first().distance == pytest.approx(expected, abs=1e-5)
    assert frechet(x.limit(1), y, "v").first().distance is None


def test_best_matches_reach_the_best_total(spark):
    r = np.random.default_rng(7)
    w = r.random((4, 3, 4))
    df = spark.createDataFrame([(g, i, j, float(w[g, i, j])) for g in range(4) for i in range(3) for j in range(4)], "g long, l long, r long, w double")
    got = {x.g: x.total for x in matched(df, "g", "l", "r", "w").groupBy("g").agg(F.sum("w").alias("total")).collect()}
    assert got == {g: pytest.approx(max(sum(w[g, i, p[i]] for i in range(3)) for p in itertools.permutations(range(4), 3))) for g in range(4)}
