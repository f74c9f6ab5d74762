import re

import numpy as np
import pytest

from tests.llm import cases
from tesserae.llm.substring_dedup import COVERS, dedup_substrings
from tesserae.llm.words import Words, mix


def brute(rows, window):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        drop = set()
        for i in range(len(w) - window + 1):
            t = tuple(w[i : i + window])
            if t in seen:
                drop.update(range(i, i + window))
            seen.add(t)
        out[doc] = len(w), len(drop), " ".join(x for k, x in enumerate(w) if k not in drop)
    return out


@pytest.mark.parametrize("chunk_bytes_mb,period", [(8, 13), (8, 7)])
def test_matches_brute_force(spark, chunk_bytes_mb, period):
    docs = cases.documents(spark)
    got = {r.id: (r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(docs, period=period, chunk_mb=chunk_bytes_mb).collect()}
    assert got == brute(list(enumerate(cases.texts())), 20)


def test_many_chunks(spark, monkeypatch):
    rows = [(k, cases.words(200, k % 40) + " " + cases.words(30, k % 7)) for k in range(300)]
    docs = spark.createDataFrame([(k, t + " pad" * 9000) for k, t in rows], "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(docs, chunk_mb=1).collect()}
    assert got == brute([(k, t + " pad" * 9000) for k, t in rows], 20)


def test_empty_null_ids_and_repeats(spark):
    assert dedup_substrings(cases.empty(spark)).count() == 0
    text = cases.words(50, 1)
    docs = spark.createDataFrame([(None, text), (3, text), (3, text), (4, text)], "doc_id long, text string")
    got = sorted(((-1 if r.id is None else r.id), r.n_removed) for r in dedup_substrings(docs).collect())
    assert got == [(-1, 0), (3, 50), (3, 50), (4, 50)]  # the null id comes first
    docs = spark.createDataFrame([(3, text), (3, text), (4, text)], "doc_id long, text string")
    assert sorted((r.id, r.n_removed) for r in dedup_substrings(docs).collect()) == [(3, 0), (3, 0), (4, 50)]


def test_covers_align_any_two_positions():
    for period, cover in COVERS.items():
        for i in range(period):
            for j in range(period):
                assert any((i + k) % period in cover and (j + k) % period in cover for k in range(period))


def test_hashes_depend_on_content_alone():
    a, b = Words([b"x yy zzz", b"yy zzz"]), Words([b"zzz\tyy  zzz"])
    assert a.hashes()[1:3].tolist() == a.hashes()[3:].tolist()
    assert a.windows(2)[1] == a.windows(2)[3] == b.windows(2)[1]
    assert len(np.unique(mix(np.arange(1000, dtype=np.uint64)))) == 1000


def test_rows_without_an_id_are_dealt_by_text(spark):
    texts = [cases.words(60, k) + " " + cases.words(30, k % 5) for k in range(60)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = dedup_substrings(docs, chunk_mb=0.002, bucket_mb=0.004)
    assert got.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).filter(lambda n: n).count() > 3
    mine = sorted((r.n_words, r.n_removed, r.kept_text) for r in got.collect())
    one = sorted((r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(docs).collect())
    assert mine == one


def test_few_buckets_and_many_chunks_agree(spark):
    rows = [(k, cases.words(200, k % 40) + " " + cases.words(30, k % 7)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(docs, chunk_mb=0.002, bucket_mb=0.05).collect()}
    assert got == brute(rows, 20)
