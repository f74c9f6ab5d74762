"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the test items, one scan of each text.

Texts are normalised byte by byte (A-Z lower-cased; ASCII other than letters and digits becomes a space), so an offset in
the normalised text is one in the original; its words are then scanned, and a match is a range of word numbers.
Each different word of the items is two characters of an alphabet of about the square root of their number, so the automaton has two nodes a
word and few edges at its root. Its size is known from the number of windows; windows beyond ``automaton_mb`` go to further automata, each scanning in a pass of its own.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import checkpointed

_NODE = 44  # bytes of memory a node, measured
_PIECE = 1024  # windows of an item in a piece
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> bytes:
    """As many bytes as the text's UTF-8: words of lower-case letters, digits and non-ASCII bytes between spaces."""
    return (text or "").encode().translate(_WORD)


def windows(text: str | None, width: int) -> list[bytes]:
    """Every run of ``width`` words of an item, or all its words if it has fewer, joined by spaces; none if it has none."""
    w = normalised(text).split()
    return [b" ".join(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)] if w else []


@dataclass(frozen=True)
class Automaton:
    """Windows of items as strings of two characters a word: ``found`` numbers them, ``width`` and ``items`` tell the words and items of each."""

    code: dict[bytes, str]
    found: ahocorasick.Automaton
    width: list[int]
    items: list[tuple[str] | set[str]]


_built: dict[str, Automaton] = {}


def built(pieces: list[tuple[str, str]], width: int) -> Automaton:
    """The automaton of the windows of (item, words) pieces. First characters of words are unlike second ones, so no match begins within a word."""
    words = sorted({w for _, text in pieces for w in text.encode().split(b" ")})
    base = math.isqrt(len(words)) + 1
    code = {w: chr(1 + k // base) + chr(1 + base + k % base) for k, w in enumerate(words)}
    found, widths, items = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], []
    for item, text in pieces:
        coded = "".join([code[w] for w in text.encode().split(b" ")])
        for i in range(0, max(len(coded) - 2 * width, 0) + 1, 2):
            p = coded[i : i + 2 * width]
            if (k := found.get(p, -1)) < 0:
                found.add_word(p, len(items))
                widths.append(len(p) // 2)
                items.append((item,))
            elif item not in items[k]:
                items[k] = items[k] if isinstance(items[k], set) else set(items[k])
                items[k].add(item)
    if items:
        found.make_automaton()
    return Automaton(code, found, widths, items)


def _automaton(key: str, shared, width: int) -> Automaton:
    """The last built automaton is kept by the worker."""
    if key not in _built:
        _built.clear()
        _built[key] = built(shared.value, width)
    return _built[key]


def _marks(text: str | None, a: Automaton):
    """(words, word spans under windows, items): spans as half-open ranges of word numbers, merged."""
    w = normalised(text).split()
    if not a.items or not w:
        return len(w), [], set()
    code = a.code
    hits = list(a.found.iter("".join([code.get(x, "\0\0") for x in w])))
    return len(w), _merged(((end + 1) // 2 - a.width[k], (end + 1) // 2) for end, k in hits), {x for k in {k for _, k in hits} for x in a.items[k]}


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of word numbers as spans of characters of the original text."""
    data = text.encode()
    word = np.frombuffer(data.translate(_WORD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    chars = np.cumsum(np.append((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, True)) - 1  # byte to character
    return [(int(chars[edges[2 * s]]), int(chars[edges[2 * e - 1]])) for s, e in spans]


_SPANS = "array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _pieces(width: int):
    """(item, words, windows): each item's words in pieces of ``_PIECE`` windows, which overlap, so that the pieces have the item's windows."""

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                w = normalised(text).split()
                n = max(len(w) - width, 0) + 1
                rows = [(item, b" ".join(w[i : i + _PIECE + width - 1]).decode(), min(_PIECE, n - i)) for i in range(0, n, _PIECE)] if w else []
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at : at + 64])], ["item", "words", "windows"])

    return cut


def _scan(key: str, shared, width: int):
    def scan(batches):
        automaton = _automaton(key, shared, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                t = batch.slice(at, 512)
                n, hits, spans, items = [], [], [], []
                for text, old_spans, old_items in zip(t.column("text").to_pylist(), t.column("spans").to_pylist(), t.column("found").to_pylist()):
                    words, s, i = _marks(text, automaton)
                    if old_spans:
                        s = _merged([*s, *((x["start"], x["end"]) for x in old_spans)])
                    n.append(words)
                    hits.append(sum(y - x for x, y in s))
                    spans.append([{"start": x, "end": y} for x, y in s])
                    items.append(sorted(i | set(old_items or ())))
                yield pa.RecordBatch.from_arrays([t.column("row"), t.column("text"), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))], ["row", "text", "n_words", "n_hit", "spans", "found"])

    return scan


def _located(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            t = batch.slice(at, 512)
            spans = [[{"start": x, "end": y} for x, y in _places(text, [(z["start"], z["end"]) for z in s])] if s else [] for text, s in zip(t.column("text").to_pylist(), t.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column("row"), t.column("n_words"), t.column("n_hit"), t.column("found"), t.column("spans"), pa.array(spans, _SPAN)], ["row", "n_words", "n_hit", "found", "word_spans", "spans"])


RESULTS = ["n_words", "n_hit", "items", "word_spans", "spans"]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, automaton_mb: float = 256) -> DataFrame:
    """Where windows of ``width`` consecutive item words occur in each text.

    Returns, per input row, the columns ``keep`` of it and ``n_words``, ``n_hit`` (words under a window), ``items``
    (items with occurring windows, sorted as strings), ``word_spans`` and ``spans`` (of words, and of characters in the original text).
    A kept column of such a name comes back as ``doc_`` and its name.

    An item with fewer words than a window is one window; one without words has none. Null texts have no words. Items whose
    id is null are left out; rows that repeat an item id add windows to that item. Repeated documents are each scanned. An empty
    benchmark hits nothing; an empty table gives an empty result. Columns not in ``keep`` are not read, whatever their names.

    ``automaton_mb`` bounds the automaton of a Python worker: windows beyond it go to further automata, one pass over the texts each.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    pieces = checkpointed(items.mapInArrow(_pieces(width), "item string, words string, windows long"))
    size = (pieces.agg(F.sum("windows")).first()[0] or 0) * 2 * width * _NODE
    parts = max(1, math.ceil(size / (automaton_mb * 2**20)))
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text_col).alias("text")).withColumns({"spans": F.lit(None).cast(_SPANS), "found": F.lit(None).cast("array<string>")})
    kind = found.schema["row"].dataType.simpleString()
    for part in range(parts):  # one, unless the items are beyond an automaton's bound
        own = pieces if parts == 1 else pieces.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([(r["item"], r["words"]) for r in own.collect()])
        found = found.select("row", "text", "spans", "found").mapInArrow(_scan(uuid.uuid4().hex, shared, width), f"row {kind}, text string, n_words long, n_hit long, spans {_SPANS}, found array<string>")
        if part + 1 < parts:
            found = checkpointed(found)
    found = found.mapInArrow(_located, f"row {kind}, n_words long, n_hit long, found array<string>, word_spans {_SPANS}, spans {_SPANS}")
    return found.select(*(F.col(f"row.`{c}`").alias(f"doc_{c}" if c in RESULTS else c) for c in keep), "n_words", "n_hit", F.col("found").alias("items"), "word_spans", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 8) -> DataFrame:
    """Documents with passages of fewer than two items, those passages cut out of the text and ``n_chars`` counted anew; other columns and documents as they are."""
    found = scan(docs.select(F.struct("*").alias("doc"), "text"), benchmark, ["doc"], width=width).where(F.size("items") < 2)
    text = F.col("doc.text")
    parts = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["end"])),
        F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.length(text))),
        lambda a, b: F.substring(text, a + 1, b - a),
    )
    cut = found.withColumn("cut", F.when(F.size("spans") > 0, F.array_join(parts, "")).otherwise(text))
    changed = {"text": F.col("cut"), "n_chars": F.when(F.size("spans") > 0, F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("cut")}
    return cut.select(*(changed[c].alias(c) if c in changed else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], width: int = 8):
    """The plain definition, for tests: {doc: (n_words, n_hit, sorted items, sha256)}."""
    of: dict[tuple, set[str]] = {}
    for item, t in items:
        for p in windows(t, width) if item is not None else []:
            of.setdefault(tuple(p.split(b" ")), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w = normalised(text).split()
        hit, found = set(), set()
        for n in {len(p) for p in of}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in of:
                    hit.update(range(i, i + n))
                    found |= of[p]
        names = sorted(found)
        out[doc] = len(w), len(hit), names, hashlib.sha256(",".join(names).encode()).hexdigest()
    return out
