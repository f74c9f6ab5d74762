"""Exact removal of repeated word windows by difference-cover anchors.

A word position is an anchor if its number in its text, modulo ``period``, is in a perfect difference set. For any two
positions there is an offset below the period that brings both to anchors, so two equal windows of ``window`` words share
an aligned anchor of ``window - period + 1`` words. Only 4 of 13 anchors are hashed and exchanged; an anchor that occurs once
in the corpus is dropped, and only windows over shared anchors are extended to their full width and compared.

Texts are dealt to chunks by a hash of id and text. A chunk asks about each different anchor (or window) once, in one block
per bucket, so a passage that a third of all documents share is one entry a chunk. Buckets answer a bit per
entry. No pairs are made, and nothing is gathered beyond a chunk or a bucket, both of bounded bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.words import U, Words

#: Perfect difference sets by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

_LOCATED = np.dtype([("lo", "<u8"), ("hi", "<u4"), ("id", "<i8"), ("start", "<i4")])
_NULL_ID = -(2**63)
_CHUNKS_A_TASK = 16


def _anchors(w: Words, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors among all words, and their hashes."""
    width = window - period + 1
    ok = w.inside(width)
    chosen = np.zeros(period, bool)
    chosen[list(COVERS[period])] = True
    at = np.flatnonzero(ok & chosen[w.place()[: len(ok)] % period])
    return at, w.windows(width)[at]


def _split(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the 40 bits that tell entries of a bucket apart: a larger corpus has more buckets, so as few clash by chance."""
    return ((h >> U(40)) % U(buckets)).astype(np.int64), h & U((1 << 40) - 1)


def _anchor_entries(h: np.ndarray, buckets: int):
    """Different anchors ordered by bucket and bits; whether each occurs again in the chunk; the entry of each anchor."""
    bucket, bits = _split(h, buckets)
    key = (bucket.astype(U) << U(40)) | bits
    entries, entry_of, n = np.unique(key, return_inverse=True, return_counts=True)
    return entries, n > 1, entry_of


def _blocks(bucket: np.ndarray):
    """Runs of equal, ascending bucket numbers: (bucket, from, to)."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *cuts.tolist(), len(bucket)]
    return [(int(bucket[s]), s, e) for s, e in zip(edges, edges[1:]) if e > s]


def _five(bits: np.ndarray) -> bytes:
    return bits.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _texts(t: pa.Table) -> list[bytes | None]:
    return t["text"].cast(pa.binary()).to_pylist()


_ASK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("entries", pa.binary())])
_ANSWER = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])
_ASK_SQL, _ANSWER_SQL = "bucket int, chunk long, entries binary", "kind int, chunk long, bucket int, bits binary"


def _ask_anchors(window: int, period: int, buckets: int):
    def ask(t: pa.Table) -> pa.Table:
        chunk = t["chunk"][0].as_py()
        _, h = _anchors(Words(_texts(t)), window, period)
        entries, _, _ = _anchor_entries(h, buckets)
        rows = [(b, chunk, _five(entries[s:e] & U((1 << 40) - 1))) for b, s, e in _blocks((entries >> U(40)).astype(np.int64))]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASK)] if rows else _ASK.empty_table().columns, schema=_ASK)

    return ask


def _answers(t: pa.Table, kind: int, sizes: np.ndarray, flags: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    bits = [np.packbits(flags[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
    return pa.table([pa.array([kind] * len(bits), pa.int32()), t["chunk"].combine_chunks(), t["bucket"].combine_chunks(), pa.array(bits, pa.binary())], schema=_ANSWER)


def _share_anchors(t: pa.Table) -> pa.Table:
    """For each entry of each block of a bucket: does another chunk have it too?"""
    blocks = [_from_five(x) for x in t["entries"].to_pylist()]
    v = np.concatenate(blocks)
    order = np.argsort(v, kind="stable")
    same = v[order[1:]] == v[order[:-1]]
    shared = np.zeros(len(v), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return _answers(t, 0, np.array([len(x) for x in blocks]), shared)


def _unpack(answers: pa.Table, kind: int, sizes: dict[int, int], total: int) -> np.ndarray:
    """The bits for all entries of a chunk, in the order in which it asked."""
    got = {b: x for k, b, x in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "bits"))) if k == kind}
    if sizes.keys() != got.keys():
        raise RuntimeError("a chunk's answers don't match what it asked")
    parts = [np.unpackbits(np.frombuffer(got[b], np.uint8), count=n) for b, n in sizes.items()]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(total, bool)


def _candidates(t: pa.Table, answers: pa.Table, window: int, period: int, buckets: int):
    """Windows over shared anchors, each different content once with its first place, by bucket; and each window's entry."""
    w = Words(_texts(t))
    at, h = _anchors(w, window, period)
    entries, again, entry_of = _anchor_entries(h, buckets)
    sizes = {b: e - s for b, s, e in _blocks((entries >> U(40)).astype(np.int64))}
    shared = (_unpack(answers, 0, sizes, len(entries)) | again)[entry_of]
    whole = w.inside(window)
    mark = np.zeros(len(whole) + 1, np.int32)  # a shared anchor at a extends to windows that start at a - period + 1 to a
    hot = at[shared]
    place = w.place()
    np.add.at(mark, np.minimum(hot - np.minimum(place[hot], period - 1), len(whole)), 1)
    np.add.at(mark, np.minimum(hot + 1, len(whole)), -1)
    starts = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & whole)
    lo, hi = w.windows(window, 0)[starts], w.windows(window, 1)[starts]
    ids = np.array([_NULL_ID if x is None else x for x in t["id"].to_pylist()], np.int64)
    found = np.empty(len(starts), _LOCATED)
    found["lo"], found["hi"], found["id"], found["start"] = lo, (hi & U(0xFFFFFFFF)).astype(np.uint32), ids[w.text_of()[starts]], place[starts]
    bucket = (hi >> U(40)).astype(np.int64) % buckets
    order = np.lexsort((found["start"], found["id"], found["hi"], found["lo"], bucket))
    found, bucket = found[order], bucket[order]
    new = np.ones(len(found), bool)
    new[1:] = (found["lo"][1:] != found["lo"][:-1]) | (found["hi"][1:] != found["hi"][:-1])
    entry = np.cumsum(new) - 1
    return w, starts[order], found, entry, found[new], bucket[new]


def _ask_windows(window: int, period: int, buckets: int):
    def ask(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _ASK.empty_table()
        chunk = t["chunk"][0].as_py()
        *_, entries, bucket = _candidates(t, answers, window, period, buckets)
        rows = [(b, chunk, entries[s:e].tobytes()) for b, s, e in _blocks(bucket)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASK)] if rows else _ASK.empty_table().columns, schema=_ASK)

    return ask


def _first_windows(t: pa.Table) -> pa.Table:
    """For each entry of each block of a bucket: does its content start earlier in another chunk?"""
    blocks = [np.frombuffer(x, _LOCATED) for x in t["entries"].to_pylist()]
    v = np.concatenate(blocks)
    order = np.lexsort((v["start"], v["id"], v["hi"], v["lo"]))
    s = v[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["lo"][1:] != s["lo"][:-1]) | (s["hi"][1:] != s["hi"][:-1])
    first = s[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.empty(len(v), bool)
    later[order] = (s["id"] != first["id"]) | (s["start"] != first["start"])
    return _answers(t, 1, np.array([len(x) for x in blocks]), later)


_DONE = pa.schema([("id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _finish(window: int, period: int, buckets: int):
    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _DONE.empty_table()
        w, starts, found, entry, entries, bucket = _candidates(t, answers, window, period, buckets)
        elsewhere = _unpack(answers, 1, {b: e - s for b, s, e in _blocks(bucket)}, len(entries))[entry] if len(entries) else np.zeros(0, bool)
        own = entries[entry]
        gone = elsewhere | (found["id"] != own["id"]) | (found["start"] != own["start"])
        mark = np.zeros(len(w.starts) + 1, np.int32)
        np.add.at(mark, starts[gone], 1)
        np.add.at(mark, starts[gone] + window, -1)
        drop = np.cumsum(mark[:-1]) > 0
        kept, spans, removed = [], [], []
        for d in range(len(w.count)):
            s, e = w.first[d], w.first[d + 1]
            x = drop[s:e]
            removed.append(int(x.sum()))
            words = w.buf[w.offsets[d] : w.offsets[d + 1] - 1].split()
            if removed[-1]:
                edges = np.flatnonzero(np.diff(x.astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"start": i, "end": j} for i, j in zip(edges[::2], edges[1::2])])
                words = [words[k] for k in np.flatnonzero(~x).tolist()]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        cols = [t["id"].combine_chunks(), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(w.count), pa.array(removed, pa.int64()), pa.array(spans, _DONE.field("removed").type)]
        return pa.table(cols, schema=_DONE)

    return finish


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, period: int = 13, chunk_mb: float = 8, bucket_mb: float = 16) -> DataFrame:
    """Remove every word under a window of ``window`` words whose words also start earlier in the corpus.

    Earlier: in a text of smaller id, or in the same text. Windows are judged on the input. Returns a row per input row: ``id``,
    ``kept_text`` (kept words joined by a space), ``n_words``, ``n_removed`` and ``removed`` (spans of word numbers).

    A null text has no words. A null id sorts before all others. Rows that repeat an id count as one document: a window
    at the same place in each is one place, so exact repeats of a row don't remove each other. Texts of fewer words than a
    window lose nothing. ``chunk_mb`` and ``bucket_mb`` are text per chunk and per bucket, what a Python worker holds at a time. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    if period not in COVERS or period > window:
        raise ValueError(f"period: one of {sorted(COVERS)}, and not over the window")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, math.ceil(size / (chunk_mb * 2**20)))
    buckets = min(chunks, max(tasks, math.ceil(size / (bucket_mb * 2**20))))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks))).repartition(max(min(chunks, tasks), math.ceil(chunks / _CHUNKS_A_TASK)), "chunk")
    shared = dealt.groupBy("chunk").applyInArrow(_ask_anchors(window, period, buckets), _ASK_SQL).groupBy("bucket").applyInArrow(_share_anchors, _ANSWER_SQL)
    asked = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_ask_windows(window, period, buckets), _ASK_SQL)
    later = asked.groupBy("bucket").applyInArrow(_first_windows, _ANSWER_SQL)
    return (
        dealt.groupBy("chunk")
        .cogroup(shared.unionByName(later).groupBy("chunk"))
        .applyInArrow(_finish(window, period, buckets), "id long, kept_text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>")
    )
