"""Decisions over tracks against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import tracking as T
from tesserae.operators import video as V
from tesserae.operators.assignment import assign
from tesserae.streaming.tracks import early_removal_stream


def log(rnd, videos=3, frames=30, tracks=9):
    m, u = set(), set()
    for v in range(videos):
        for t in range(tracks):
            begin = rnd.randrange(frames - 5)
            for f in range(begin, min(frames, begin + rnd.randint(3, 20))):
                (m.add((v, f, rnd.randrange(3), t)) if rnd.random() < 0.7 else u.add((v, f, t)))
    return sorted(m), sorted(u)


def frames_of(spark, m, u):
    return spark.createDataFrame(m, "video long, frame long, det long, track long"), spark.createDataFrame(u, "video long, frame long, track long")


def plain_removals(m, u, delay, misses, doubles):
    first = {}
    for v, f, t in sorted([(v, f, t) for v, f, _, t in m] + u, key=lambda x: x[1]):
        first.setdefault((v, t), f)
    gone, miss, pair = {}, defaultdict(int), defaultdict(int)
    for f in range(100):
        for v, g, t in u:
            if g == f:
                miss[v, t] += 1
                if miss[v, t] == misses and f < first[v, t] + delay:
                    gone.setdefault((v, t), (first[v, t], f, "unmatched"))
        for v, d in sorted({(x[0], x[2]) for x in m if x[1] == f}):
            ts = [x[3] for x in m if x[:3] == (v, f, d)]
            lead = min(ts, key=lambda t: (first[v, t], t))
            for t in ts:
                if t != lead:
                    pair[v, lead, t] += 1
                    if pair[v, lead, t] == doubles and f < first[v, t] + delay:
                        gone.setdefault((v, t), (first[v, t], f, "duplicate"))
    return gone


def test_early_removals_equal_a_plain_loop_and_the_stream(spark, tmp_path):
    m, u = log(random.Random(2))
    expected = plain_removals(m, u, 12, 3, 2)
    assert {c for _, _, c in expected.values()} == {"unmatched", "duplicate"}
    plain = lambda rows: {(r.video, r.track): (r.first, r.removed_at, r.cause) for r in rows}
    assert plain(V.early_removals(*frames_of(spark, m, u), 12, 3, 2).collect()) == expected
    rows = [(v, f, t, d) for v, f, d, t in m] + [(v, f, t, None) for v, f, t in u]
    parts = [[r for r in rows if r[1] // 7 == k] for k in range(5)] + [[(v, -1, 0, None) for v in range(3)]]
    schema = "video long, frame long, track long, det long"
    for k, part in enumerate(parts):
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = early_removal_stream(stream, 12, 3, 2).writeStream.format("memory").queryName("removals").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert plain(spark.table("removals").collect()) == expected


def test_occlusion_hides_the_later_one(spark):
    rows = [(1, 1, 2, 0.9, 5, 3), (2, 1, 2, 0.9, 5, -1), (3, 1, 2, 0.1, 5, 3), (4, 1, 2, 0.9, 3, 5), (5, 1, 2, 0.9, 4, 4)]
    p = spark.createDataFrame(rows, "image long, i long, j long, iou double, oi long, oj long")
    assert sorted((r.image, r.n) for r in V.occluded(p, 0.5).collect()) == [(1, 1), (4, 2)]
    back = sorted((r.image, r.n) for r in V.occluded(p, 0.5, reverse=True).collect())
    assert (1, 2) in back and (4, 1) in back


def test_suppressed_track_suppresses_none(spark):
    box = lambda t, x: [(1, t, f, x, 0, 10, 10) for f in range(3)]
    fr = spark.createDataFrame(box(1, 0) + box(2, 2) + box(3, 4) + box(4, 50), "video long, track long, frame long, x long, y long, w long, h long")
    sc = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (1, 4, 0.1), (1, 5, 0.99)], "video long, track long, score double")
    assert sorted(r.track for r in V.suppressed_tracks(fr, sc, 0.5).collect()) == [1, 3, 4]


def test_open_labels(spark):
    key = "image long, category string"
    dets = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "b", 4), (3, "a", 5), (3, "a", 6)], f"{key}, n long")
    truth = spark.createDataFrame([(1, "a", 9), (3, "a", 9)], f"{key}, n long")
    p = spark.createDataFrame([(1, "a", 9, 1, 0.6), (1, "a", 9, 2, 0.4), (3, "a", 9, 5, 0.9), (3, "a", 9, 6, 0.7)], f"{key}, g long, d long, iou double")
    negative, partial = spark.createDataFrame([(2, "b")], key), spark.createDataFrame([(3, "a")], key)
    left = sorted(r.n for r in V.without_unlabelled(dets, truth, p, negative, partial).collect())
    assert left == [1, 2, 4, 5]  # 3: class unknown there; 6: unmatched where labels are not complete


def plain_teta(gt, dt, sims, overlap, exhaustive):
    """By definition, one class after the other; alphas above 0, where no match is arbitrary."""
    out, wrong = {}, defaultdict(int)
    for cls in sorted({c for *_, c in gt}):
        for a in T.TETA_ALPHAS[1:]:
            tp = fn = fp = c_tp = c_fn = off = 0
            assoc = 0.0
            for seq in sorted({x[0] for x in gt + dt}):
                g = [x for x in gt if x[0] == seq and x[3] == cls]
                frames = sorted({x[1] for x in gt + dt if x[0] == seq})
                sim = lambda f, i, j: sims[seq, f, i, j]  # noqa: E731, B023
                at = lambda f: [x[2] for x in g if x[1] == f]  # noqa: E731, B023
                near = {f: {x[2] for x in dt if x[:2] == (seq, f) and any(sim(f, i, x[2]) >= overlap for i in at(f))} for f in frames}
                used = set().union(*near.values()) if near else set()
                d = [x for x in dt if x[0] == seq and x[2] in used]
                ng, nd, both, pair = defaultdict(int), defaultdict(int), defaultdict(float), defaultdict(int)
                for x in g:
                    ng[x[2]] += 1
                for x in d:
                    nd[x[2]] += 1
                tables = {}
                for f in frames:
                    rows, cols = at(f), [x[2] for x in d if x[1] == f]
                    s = np.array([[sim(f, i, j) for j in cols] for i in rows]).reshape(len(rows), len(cols))
                    tables[f] = rows, cols, s
                    for i, r in enumerate(rows):
                        for j, c in enumerate(cols):
                            if s[i, j] > 0:
                                both[r, c] += s[i, j] / (s[i].sum() + s[:, j].sum() - s[i, j])
                for f in frames:
                    rows, cols, s = tables[f]
                    if exhaustive:
                        off += len({x[2] for x in dt if x[:2] == (seq, f) and x[3] == cls} - near[f])
                    if not rows:
                        continue
                    w = np.array([[both[r, c] / (ng[r] + nd[c] - both[r, c]) * s[i, j] for j, c in enumerate(cols)] for i, r in enumerate(rows)]).reshape(s.shape)
                    hits = [(rows[i], cols[j]) for i, j in zip(*assign(-w)) if s[i, j] >= a] if cols else []
                    tp += len(hits)
                    fn += len(rows) - len(hits)
                    fp += len(near[f] - {c for _, c in hits})
                    for r, c in hits:
                        pair[r, c] += 1
                        kind = next(x[3] for x in d if x[1:3] == (f, c))
                        if a >= 0.5:
                            c_tp, c_fn = c_tp + (kind == cls), c_fn + (kind != cls)
                            wrong[kind, a] += kind != cls
                assoc += sum(n * n / (ng[r] + nd[c] - n) for (r, c), n in pair.items())
            out[cls, a] = tp, fn, fp, assoc / max(1, tp), c_tp, c_fn, off
    result = {}
    for (cls, a), (tp, fn, fp, assoc, *_) in out.items():
        acc = [x[4] / max(1, x[4] + x[5] + wrong[cls, b] + x[6]) for (c, b), x in out.items() if c == cls and b >= 0.5]
        loc, k = tp / max(1, tp + fn + fp), sum(acc) / len(acc)
        result[cls, a] = tp, fn, fp, loc, assoc, k, (loc + assoc + k) / 3
    return result


@pytest.mark.parametrize("exhaustive", [False, True])
def test_teta_by_definition(spark, exhaustive):
    rnd = random.Random(12)
    gt = [(s, f, i, "ab"[i % 2]) for s in range(2) for f in range(6) for i in range(3) if rnd.random() < 0.8]
    dt = [(s, f, i, rnd.choice("ab")) for s in range(2) for f in range(7) for i in range(4) if rnd.random() < 0.8]
    sims = {(s, f, i, j): (rnd.uniform(0.3, 1) if i == j else rnd.uniform(0.01, 0.6)) for s, f, i, _ in gt for t, e, j, _ in dt if (s, f) == (t, e)}
    p = spark.createDataFrame([(*k, x) for k, x in sims.items()], "seq long, frame long, g long, d long, sim double")
    g, d = spark.createDataFrame(gt, "seq long, frame long, g long, category string"), spark.createDataFrame(dt, "seq long, frame long, d long, category string")
    got = {(r.cls, r.alpha): (r.tp, r.fn, r.fp, r.LocA, r.AssocA, r.ClsA, r.TETA) for r in T.teta(p, g, d, exhaustive=exhaustive).where(F.col("alpha") > 0).collect()}
    expected = plain_teta(gt, dt, sims, 0.5, exhaustive)
    assert set(got) == set(expected)
    for k, v in expected.items():
        assert got[k] == pytest.approx(v), k
