import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import cases
from tesserae.llm.components import connected_components
from tesserae.llm.golay import codewords
from tesserae.llm.simhash import _CUTS, _ORDERED, _finer, _keys, _links, fingerprint, keep_first, linked, near_duplicates


def plain_fingerprint(text, k=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, bits=4):
    f = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: (f[i], min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i in range(len(rows))}


def test_matches_brute_force(spark):
    rows = list(enumerate(cases.texts()))
    assert [fingerprint(t, 4) for _, t in rows] == [plain_fingerprint(t) for _, t in rows]
    got = {r.id: (r.fp % 2**64, r.component_id) for r in near_duplicates(cases.documents(spark)).collect()}
    assert got == plain_components(rows)


def test_near_copies(spark):
    r, rows = random.Random(5), []
    for k in range(60):
        w = cases.words(500, k % 12, 400).split()
        for _ in range(k // 12):
            w[r.randrange(len(w))] = f"new{r.random()}"
        rows.append((k, " ".join(w)))
    got = {x.id: (x.fp % 2**64, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)
    assert any(c != k for k, (_, c) in got.items())


@pytest.mark.parametrize("third", [False, True])
def test_keys_find_every_pair_within_four_bits(third):
    r = np.random.default_rng(3)
    a = r.integers(0, 2**64, 1000, dtype=np.uint64)
    b = a.copy()
    for k in range(4):
        flip = (np.arange(len(a)) % 5) > k
        b[flip] ^= np.uint64(1) << r.integers(0, 64, flip.sum(), dtype=np.uint64)
    ka, ra = _keys(a.view(np.int64), third)
    kb, rb = _keys(b.view(np.int64), third)
    partner = np.array([0, 2, 1])
    mine = set(zip(ka.tolist(), ra.tolist()))
    met = {int(row) for key, row in zip(kb.tolist(), rb.tolist()) if ((key >> 2 << 2) | int(partner[key & 3]), row) in mine}
    assert met == set(range(len(a)))


def test_codewords():
    x = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    index, valid = codewords(x)
    assert set(valid.sum(axis=1).tolist()) == {1, 6}
    for flips in range(3):
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << np.random.default_rng(flips).integers(0, 23, len(x))
        other, ok = codewords(y)
        for i in range(len(x)):
            assert set(index[i][valid[i]]) & set(other[i][ok[i]])


def test_links_over_every_bit():
    f = np.array([0, *(1 << k for k in range(63)), -(2**63)], np.int64)  # each one bit from the first
    key, row = _keys(f)
    a, b = linked(key >> 2, (key & 3).astype(np.int8), f[row], 1)
    assert len(a) == 64


def test_forest_of_a_large_group_is_small():
    f = np.arange(512).astype(np.int64)
    a, b = linked(np.zeros(512, np.int64), np.zeros(512, np.int8), f, 4)
    assert len(a) == 511


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, 3), (3, 7), (5, 5), (None, 4), (9, 8), (8, 140)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {7: 3, 9: 8} | {k: 8 for k in range(100, 141)}


def kept_by_brute_force(rows):
    """Rows (id, text) that stay: of each group of linked fingerprints the first by id (null last); repeats of a row are one."""
    numbered = list(enumerate(sorted(set(rows), key=str)))
    groups = plain_components([(k, t) for k, (_, t) in numbered])
    by = {}
    for k, row in numbered:
        by.setdefault(groups[k][1], []).append(row)
    return [{r for r in g if r[0] is None or r[0] == min((x[0] for x in g if x[0] is not None))} if any(x[0] is not None for x in g) else set(g) for g in by.values()]


def test_keep_first_is_by_row(spark):
    t, u, v = cases.words(60, 1), cases.words(70, 2), cases.words(50, 3)
    rows = [(2, t), (5, t), (5, u), (9, u + " " + v), (9, v), (2, t), (None, t), (None, None), (None, "  "), (None, cases.words(40, 9)), (7, ""), (8, v + " "), (5, v)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "row": F.lit("x"), "rn": F.lit(2), "k_id": F.lit(3), "tie": F.lit(4), "m": F.create_map(F.lit("a"), F.lit("b"))})
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    expected = kept_by_brute_force(rows)
    assert len(got) == len(expected)
    for group in expected:
        assert sum(x in group for x in got) == 1
    assert {(2, t), (5, u), (9, u + " " + v)} < set(got) and (5, t) not in got and (None, t) not in got


def test_large_keys_are_split_without_loss():
    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 1)[0]
    f = np.unique(np.concatenate([base ^ (np.int64(1) << r.integers(0, 63, 40)) ^ (np.int64(1) << r.integers(0, 63, 40)) for _ in range(5)]))
    for kind, ((a, _), (at, width)) in enumerate(zip(_ORDERED, [_CUTS[a] for a, _ in _ORDERED])):
        exact = np.uint64(((1 << width) - 1) << at)
        own = ((f.view(np.uint64) & ~exact) | (np.uint64(base) & exact)).view(np.int64)
        met = {}
        for sub, _, x in _finer(kind << 34, np.zeros(len(own), np.int8), own):
            for k, y in zip(sub.tolist(), x.tolist()):
                met.setdefault(k, set()).add(y)
        near = {(x, y) for x in own.tolist() for y in own.tolist() if x < y and ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
        assert near and all(any({x, y} <= g for g in met.values()) for x, y in near)


def test_small_bound_gives_the_same_groups(spark):
    r, rows = random.Random(5), []
    for k in range(80):
        w = cases.words(500, k % 8, 400).split()
        for _ in range(k // 12):
            w[r.randrange(len(w))] = f"new{r.random()}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.id: (x.fp % 2**64, x.component_id) for x in near_duplicates(docs, most=2).collect()} == plain_components(rows)


def test_keys_that_span_batches(monkeypatch):
    monkeypatch.setattr("tesserae.llm.simhash._ENTRIES_AT_ONCE", 5)
    r = np.random.default_rng(4)
    key = np.sort(np.concatenate([np.full(30, 7), np.full(9, 8), r.integers(9, 20, 40), np.full(25, 50)])).astype(np.int64)
    f = r.integers(0, 4, len(key)) + 1000 * key
    role = np.zeros(len(key), np.int8)
    for most in (None, 8, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 4]) for x in (key, role, f)], ["key", "role", "fp"]) for i in range(0, len(key), 4)]
        out = pa.Table.from_batches(list(_links(64, most)(iter(batches))))
        linked_rows = out.filter(pa.compute.is_null(out["role"]))
        again = out.filter(pa.compute.is_valid(out["role"]))
        assert again.num_rows == (0 if most != 8 else 15 * (30 + 9 + 25 + sum(n for n in np.bincount(key[(key > 8) & (key < 50)]) if n > 8)))
        if most != 8:
            assert linked_rows.num_rows == sum(len(np.unique(f[key == k])) - 1 for k in np.unique(key))


def test_empty(spark):
    assert near_duplicates(cases.empty(spark)).count() == 0
    assert keep_first(cases.empty(spark)).count() == 0
