"""SimHash near-dedup: Golay-code fuzzy keys of fingerprint segments, pigeonhole over the segments, join and verify.

A 64-bit fingerprint is cut into three segments. If two differ in 4 bits at most, their differences over the segments
are, in ascending order, (0, any), with a second of at most 2, or else (1, 1, at most 2). So two kinds of keys find every pair:
an exact segment with a Golay index of another one (indices meet within 2 bits), and the indices of two segments that
differ in one bit each: there the nearest indices of one fingerprint meet the near ones of the other, and both parities differ.

Fingerprints are made unique first, so copies never meet. The entries of a key are compared in place, and a task gives back
a spanning forest of the links that it verified, not its pairs; components are then found by distributed star steps. Entries come
sorted by key, so a task holds some keys at a time; a key of many entries is split into finer ones by bands of its open bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.components import connected_components
from tesserae.llm.golay import codewords
from tesserae.llm.shared import checkpointed
from tesserae.llm.words import mix

MAX_BITS = 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CUTS = ((0, 22), (22, 21), (43, 21))  # lowest bit and width of each segment
_ORDERED = [(a, b) for a in range(3) for b in range(3) if a != b]
_PAIRS = [(0, 1), (0, 2), (1, 2)]
_KEY = ["k_id", "k_text", "k_none"]
_KEYS_PER_TASK = 2_000_000
_ENTRIES_AT_ONCE = 1_000_000  # of whole keys that are compared together
_LARGE_KEY = 20_000  # entries of a key from which it is split into finer keys
_BANDS = 6
_MANY = 1 << 25  # fingerprints from which chance meetings cost more than longer keys
_STEP = 8192


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit k is 1 if more than half of the shingles' hashes have it; 0 without words."""
    data = b" ".join((text or "").encode().translate(_LOWER).split())
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(gaps) < shingle:
        return xxhash.xxh64_intdigest(data, 42)
    ones, n = np.zeros(64, np.int64), len(gaps) + 2 - shingle
    hashed = xxhash.xxh64_intdigest
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)][shingle - 1 :]
    for at in range(0, n, _STEP):
        h = np.array([hashed(data[i:j], 42) for i, j in zip(starts[at : at + _STEP], ends[at : at + _STEP])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                t = batch.slice(at, 1024)
                f = np.array([fingerprint(x, shingle) for x in t.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([t.column("id"), t.column("t"), pa.array(f)], ["id", "t", "fp"])

    return make


def _keys(f: np.ndarray, third: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints, and the row of each. Bits 0-1: the role; 0 meets 0, and 1 meets 2.

    With ``third``, keys of two segments that differ in a bit each also have an index of the third one, which differs in two
    bits at most: five times the keys, and a hundredth of the chance meetings. No link is lost either way.
    """
    u = f.view(np.uint64)
    segment = [((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in _CUTS]
    near = [codewords(x) for x in segment]
    odd = [np.bitwise_count(x).astype(np.int64) & 1 for x in segment]
    row = np.arange(len(f))
    keys, rows = [], []

    def add(key, valid):
        key, valid = np.broadcast_arrays(key, valid)
        keys.append(key[valid])
        rows.append(np.broadcast_to(row.reshape(-1, *[1] * (key.ndim - 1)), key.shape)[valid])

    for kind, (a, b) in enumerate(_ORDERED):
        index, valid = near[b]
        add((kind << 36) | (segment[a][:, None] << 14) | (index << 2), valid)
    for kind, (a, b) in enumerate(_PAIRS, len(_ORDERED)):
        (ia, va), (ib, vb), (ic, vc) = near[a], near[b], near[3 - a - b]
        if not third:
            ic, vc = np.zeros((len(f), 1), np.int64), np.ones((len(f), 1), bool)
        own = (kind << 36) | (odd[a] << 27) | (odd[b] << 26) | (ia[:, 0] << 14) | (ib[:, 0] << 2) | 1
        add(own[:, None] | (ic << 42), vc)
        other = (kind << 36) | ((1 - odd[a]) << 27) | ((1 - odd[b]) << 26)
        near_two = other[:, None, None] | (ia[:, :, None] << 14) | (ib[:, None, :] << 2) | 2
        add(near_two[..., None] | (ic[:, None, None, :] << 42), (va[:, :, None] & vb[:, None, :])[..., None] & vc[:, None, None, :])
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(third: bool):
    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                f = batch.slice(at, 1024).column("fp").to_numpy()
                key, row = _keys(f, third)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 2), pa.array((key & 3).astype(np.int8)), pa.array(f[row])], ["key", "role", "fp"])

    return make


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each points to a lower or equal node, roots to themselves) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (down := label[label]).tobytes() != label.tobytes():
            label = down


def linked(key: np.ndarray, role: np.ndarray, f: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints that share a key, whose roles meet and that differ in ``bits`` at most."""
    order = np.lexsort((role, key))
    key, role, f = key[order], role[order], f[order]
    nodes, node = np.unique(f, return_inverse=True)
    label = np.arange(len(nodes))
    at, lag = np.flatnonzero(key[1:] == key[:-1]), 1
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    while len(at):
        if lag & (lag - 1) == 0 and lag >= 16:  # groups that are one tree already need no more links
            own = label[node]
            apart = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
            at = at[apart[group[at]]]
        i, j = at, at + lag
        ok = (role[i] + role[j] == 3) | (role[i] + role[j] == 0)
        i, j = i[ok], j[ok]
        ok = label[node[i]] != label[node[j]]  # those already in one tree need no other link
        i, j = i[ok], j[ok]
        ok = np.bitwise_count((f[i] ^ f[j]).view(np.uint64)) <= bits
        label = _united(label, node[i[ok]], node[j[ok]])
        lag += 1
        at = at[at + lag < len(key)]
        at = at[key[at + lag] == key[at]]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _finer(key: int, role: np.ndarray, f: np.ndarray):
    """Sub-keys of the entries of one large key: (sub-key, role, fingerprint). No pair within 4 bits is lost.

    The bits that the key leaves open (outside its exact segment) are cut into 6 bands. A pair that differs in 4 bits at most agrees
    in 2 bands at least, so it meets under those.
    """
    kind = key >> 34 & 15
    at, width = _CUTS[_ORDERED[kind][0]] if kind < len(_ORDERED) else (0, 0)
    open_bits = np.array_split([b for b in range(64) if not at <= b < at + width], _BANDS)
    u = f.view(np.uint64)
    band = [sum(((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(bits)) for bits in open_bits]
    for n, (i, j) in enumerate(combinations(range(_BANDS), 2)):
        sub = mix(mix(mix(np.full(len(f), key << 4 | n, np.int64).view(np.uint64)) + band[i]) + band[j])
        yield sub.view(np.int64), role, f


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("role", pa.int8())])


def _links(bits: int, most: int | None):
    """Links among entries that come in the order of their keys: (a, b, null), groups of whole keys at a time.

    A key of over ``most`` entries is not compared here: its entries are given back under finer keys, as (sub-key, fingerprint, role).
    """

    def spread(key, role, f):
        for sub, r, x in _finer(int(key), role, f):
            yield pa.RecordBatch.from_arrays([pa.array(sub), pa.array(x), pa.array(r)], schema=_FOUND)

    def compared(key, role, f):
        if most is not None:
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            many, small = np.flatnonzero(np.diff(edges) > most), np.ones(len(key), bool)
            for s, e in zip(edges[many].tolist(), edges[many + 1].tolist()):
                yield from spread(key[s], role[s:e], f[s:e])
                small[s:e] = False
            key, role, f = key[small], role[small], f[small]
        a, b = linked(key, role, f, bits)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int8())], schema=_FOUND)

    def find(batches):
        held, n, large = [], 0, None  # ``large``: the key whose entries are no longer held
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("key", "role", "fp")])
            n += batch.num_rows
            if n < _ENTRIES_AT_ONCE:
                continue
            key, role, f = (np.concatenate(x) for x in zip(*held))
            if large is not None and (m := int(np.searchsorted(key, large, "right"))):
                yield from spread(large, role[:m], f[:m])
                key, role, f = key[m:], role[m:], f[m:]
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # that key may go on
            if last:
                yield from compared(key[:last], role[:last], f[:last])
            if most is not None and len(key) - last > most:
                large = key[-1]
                yield from spread(large, role[last:], f[last:])
                held, n = [], 0
            else:
                held, n = [[key[last:], role[last:], f[last:]]], len(key) - last
        if held:
            key, role, f = (np.concatenate(x) for x in zip(*held))
            m = int(np.searchsorted(key, large, "right")) if large is not None else 0
            if m:
                yield from spread(large, role[:m], f[:m])
            if len(key) > m:
                yield from compared(key[m:], role[m:], f[m:])

    return find


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (id, t, fp), and of each different one (fp, first, row, n, root), ``root`` the least fingerprint of its group.

    ``t`` tells texts of an id apart. ``first`` is the smallest id, ``row`` the first row as (no id, id, t).
    """
    if bits > MAX_BITS:
        raise ValueError(f"the segments guarantee links of up to {MAX_BITS} bits")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _content(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    prints = checkpointed(rows.mapInArrow(_fingerprints(shingle), "id long, t long, fp long"))
    row = F.struct(F.isnull("id").alias("none"), "id", "t")
    unique = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("first"), F.min(row).alias("row"), F.count("*").alias("n")))
    n = unique.count()
    third = n > _MANY
    tasks = max(1, n * (493 if third else 119) // _KEYS_PER_TASK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = unique.select("fp").mapInArrow(_keyed(third), "key long, role byte, fp long")
    found = checkpointed(keys.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_links(bits, most), "a long, b long, role byte"))
    links, large = found.where("role IS NULL").select("a", "b"), found.where("role IS NOT NULL")
    if not large.isEmpty():
        finer = large.select(F.col("a").alias("key"), "role", F.col("b").alias("fp")).repartition(tasks, "key").sortWithinPartitions("key")
        links = links.unionByName(finer.mapInArrow(_links(bits, None), "a long, b long, role byte").select("a", "b"))
    roots = connected_components(links)
    return prints, unique.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _content(text) -> Column:
    return F.xxhash64(F.isnull(text), text)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = MAX_BITS, most: int = _LARGE_KEY) -> DataFrame:
    """Groups of texts whose SimHash fingerprints are linked, directly or through others, by at most ``bits`` differing bits.

    Returns a row per input row: ``id``, ``fp`` (64 bits as a long), ``component_id`` (smallest id of the group). Words are
    runs of other than space and \\t-\\r, with A-Z lower-cased; a text of fewer words than a shingle is one shingle; one without
    words, null included, has fingerprint 0. Null ids don't count as the smallest: a group of null ids alone has a null component. Rows that
    repeat an id each get a row. An empty table gives an empty result. Other columns are not read, whatever their names.
    Keys of over ``most`` fingerprints are split into finer ones, which lose no link.
    """
    prints, member = _groups(docs, id_col, text_col, shingle, bits, most)
    first = member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"), F.sum("n").alias("copies"))
    groups = member.join(first.where("prints > 1 OR copies > 1"), "root").select("fp", "component_id")
    return prints.join(groups, "fp", "left").select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = MAX_BITS) -> DataFrame:
    """The first row of each group of near-duplicate rows, with all columns: that of the smallest id (null ids last), of its texts that of the least hash.

    Groups are of rows, not of ids: rows that share an id but not their text are judged one by one, and no group loses its last row. Of rows
    equal in id and text one stays, by the least hash of their other columns (maps left out). An empty table gives an empty result.
    """
    _, member = _groups(docs, id_col, text_col, shingle, bits, _LARGE_KEY)
    first = member.groupBy("root").agg(F.min("row").alias("row"))
    # Two numbers that tell rows apart, both never null; without an id both are of the text.
    key = [F.coalesce(F.col("row.id"), F.hash(F.col("row.t")).cast("long")), F.col("row.t"), F.col("row.none")]
    first = first.select(*(k.alias(c) for k, c in zip(key, _KEY)))
    id_, t = F.col(f"`{id_col}`").cast("long"), _content(F.col(f"`{text_col}`"))
    own = [F.coalesce(id_, F.hash(t).cast("long")), t, F.isnull(id_)]
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*plain).alias("tie"), *(k.alias(c) for k, c in zip(own, _KEY)))
    kept = rows.join(first, _KEY, "left_semi")
    return kept.withColumn("rn", F.row_number().over(Window.partitionBy(*_KEY).orderBy("tie"))).where("rn = 1").select("row.*")
