"""Token ids as Arrow stream files of fixed-size lists, written in ascending document order and read back.

Documents are range-partitioned and sorted by id; each partition is a shard. A shard has two Arrow streams: ``NNNNN.arrows``
holds batches of ``ids`` and ``mask``, fixed-size lists of ``length`` values that follow each other in the batch's
buffer, so a sequence of any number is a slice without a copy; ``NNNNN.index.arrows`` holds (doc_id, start, n_tokens)
with starts in the shard. Only the last sequence of a shard is padded, under a false mask. Ids take 16 bits if the vocabulary allows.

A shard file appears under its name when it is whole, and a repeated attempt of its task replaces it by the same bytes.
"""

from __future__ import annotations

import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import Replacing, filesystem, new_folder

_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r"[^\S \n]")
_CACHED = 600_000  # words; a worker starts anew beyond it


def _loose(t: str) -> bool:
    """White space other than single spaces and line ends between visible characters."""
    return "  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[0] in " \n" or t[-1] in " \n" or _ODD.search(t) is not None


_loaded: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """``tokenizers`` ids of whole texts, each different word encoded once while it stays in the cache.

    Byte-level BPE never merges across a space before a visible character, nor across a single line end between two. So where a
    text has no other white space, its ids are those of its words, each with the space before it, and of the line ends. Other
    texts are cut at such spaces alone.

    With ``added``, as the plain call of the library does, the string of an added token in a text is that token's one id, and the text is cut there
    before its words are; without it, the string of a special token is ordinary text.
    """

    def __init__(self, path: str, added: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # with ``added``, no piece holds their strings
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        found = self.tokenizer.get_added_tokens_decoder() if added else {}
        if any(x.lstrip or x.rstrip or x.single_word or x.normalized or re.search(r"\s", x.content) for x in found.values()):
            raise ValueError("added tokens that strip, are normalized, are single words or hold white space")
        self.added = {x.content: np.array([k], self.dtype).tobytes() for k, x in found.items()}
        self.at_added = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})")
        self.line = self._ids("\n")
        self.spaced = np.array([(self.tokenizer.id_to_token(k) or "").startswith("Ġ") for k in range(size)])
        self.first: dict[str, bytes] = {}  # words at the start of a line
        self.next: dict[str, bytes] = {}  # words after a space
        self.loose: dict[str, bytes] = {}  # pieces as they are

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _add(self, cache: dict[str, bytes], words: set[str], between: str) -> None:
        """Encode new words in one go, ``between`` before each, and cut the ids where it begins; one by one if the cuts aren't as many."""
        new = list(words.difference(cache))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([between + between.join(some)], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.spaced[ids] if between == " " else ids == np.frombuffer(self.line, self.dtype)[0])
            if len(starts) != len(some):
                cache.update((p, self._ids(between + p) if between == " " else self._ids(p)) for p in some)
                continue
            data, k = ids.tobytes(), self.dtype.itemsize
            skip = 0 if between == " " else k
            edges = [*(starts * k).tolist(), len(data)]
            cache.update((p, data[i + skip : j]) for p, i, j in zip(some, edges, edges[1:]))

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``, and the id ``end`` after them."""
        last = np.array([end], self.dtype).tobytes()
        if not any(t and any(a in t for a in self.added) for t in texts):
            return self._encode(texts, last)
        cuts = [self.at_added.split(t) if t else [t] for t in texts]  # pieces, and between them added tokens
        pieces = iter(self._encode([p for cut in cuts for p in cut[::2]], b""))
        return [b"".join(self.added[p] if k % 2 else next(pieces) for k, p in enumerate(cut)) + last for cut in cuts]

    def _encode(self, texts: list[str | None], last: bytes) -> list[bytes]:
        if len(self.first) + len(self.next) + len(self.loose) > _CACHED:
            for cache in (self.first, self.next, self.loose):
                cache.clear()
        plans, first, after, loose = [], set(), set(), set()
        for t in texts:
            if not t:
                plans.append(None)
            elif _loose(t):
                head, *rest = _CUT.split(t)
                plans.append([head, *(" " + x for x in rest)])
                loose.update(plans[-1])
            else:
                plans.append([x.split(" ") for x in t.split("\n")])
                for x in plans[-1]:
                    first.add(x[0])
                    after.update(x[1:])
        self._add(self.first, first, "\n")
        self._add(self.next, after, " ")
        for p in loose.difference(self.loose):
            self.loose[p] = self._ids(p)
        start, rest, whole = self.first, self.next.__getitem__, self.loose.__getitem__
        return [
            last if plan is None else b"".join(map(whole, plan)) + last if isinstance(plan[0], str) else self.line.join([start[x[0]] + b"".join(map(rest, x[1:])) for x in plan]) + last
            for plan in plans
        ]


def encoder(path: str, added: bool = True) -> Encoder:
    if (path, added) not in _loaded:
        _loaded.clear()
        _loaded[path, added] = Encoder(path, added)
    return _loaded[path, added]


def _schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())])


def _batch(data: bytes, length: int, dtype: np.dtype, schema: pa.Schema) -> pa.RecordBatch:
    ids = np.frombuffer(data, dtype)
    rows = -(-len(ids) // length)
    full = np.zeros(rows * length, dtype)
    full[: len(ids)] = ids
    mask = np.arange(rows * length) < len(ids)
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema)


def _write(folder: str, tokenizer: str, end: int, length: int, sequences: int, added: bool):
    def write(batches):
        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer, added)
        schema, step = _schema(length, enc.dtype), length * enc.dtype.itemsize
        docs = tokens = rows = 0
        waiting = bytearray()
        with Replacing(f"{folder}/{shard:05d}.arrows") as out, Replacing(f"{folder}/{shard:05d}.index.arrows") as index:
            with pa.ipc.new_stream(out, schema) as seqs, pa.ipc.new_stream(index, _INDEX) as starts:
                for batch in batches:
                    for at in range(0, batch.num_rows, 256):
                        t = batch.slice(at, 256)
                        coded = enc.encode(t.column("text").to_pylist(), end)
                        n = np.array([len(c) // enc.dtype.itemsize for c in coded], np.int64)
                        starts.write_batch(pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array(tokens + np.cumsum(n) - n), pa.array(n)], schema=_INDEX))
                        docs, tokens = docs + len(n), tokens + int(n.sum())
                        for c in coded:
                            waiting += c
                            while len(waiting) >= sequences * step:
                                seqs.write_batch(_batch(bytes(waiting[: sequences * step]), length, enc.dtype, schema))
                                rows += sequences
                                del waiting[: sequences * step]
                if waiting:
                    last = _batch(bytes(waiting), length, enc.dtype, schema)
                    rows += last.num_rows
                    seqs.write_batch(last)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, docs, tokens, rows), _MANIFEST)], schema=_MANIFEST)

    return write


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = 0, length: int = 2048, sequences: int = 64, shard_mb: float = 16, most_shards: int = 20_000, added: bool = True):
    """Encode every whole text, add id ``end``, and write the shards. Returns the folder and the manifest.

    Manifest: a row a shard (shard, n_docs, n_tokens, n_sequences), in document order, collected: at most ``most_shards`` rows. Shards
    have about ``shard_mb`` of text, more where that would make too many; a task streams its shard, whatever its size. A null text
    has only the end id. Null ids come first; rows of one id are ordered by a hash of the text, and may be in several shards. An empty table
    gives shards without documents. Other columns are not read, whatever their names. ``added``: strings of added tokens become their ids (see ``Encoder``).
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(most_shards, max(1, math.ceil(size / (shard_mb * 2**20))))
    order = ["doc_id", F.xxhash64("text"), F.isnull("text")]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    manifest = ordered.mapInArrow(_write(folder, tokenizer, end, length, sequences, added), "shard int, n_docs long, n_tokens long, n_sequences long").collect()
    return folder, sorted(manifest)


def sequence(folder: str, shard: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a shard; of a local file, its pages alone are read (ids without a copy).

    Batches but the last have as many sequences and bytes as the first, so the batch's place is computed, not looked for.
    """
    fs, path = filesystem(f"{folder}/{shard:05d}.arrows")
    source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
    schema = pa.ipc.read_schema(pa.ipc.read_message(source))
    try:
        start = source.tell()
        first = pa.ipc.read_message(source)
        rows = pa.ipc.read_record_batch(first, schema).num_rows
        if number < 0:
            raise IndexError(number)
        source.seek(start + number // rows * (source.tell() - start))
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    except (EOFError, OSError, pa.ArrowInvalid) as beyond:
        raise IndexError(number) from beyond
    if (k := number % rows) >= batch.num_rows:
        raise IndexError(number)
    ids, n = batch.column(0), schema.field("ids").type.list_size
    return ids.flatten().to_numpy()[k * n : k * n + n], batch.column(1).slice(k, 1).flatten().to_numpy(zero_copy_only=False)


def _read(folder: str, shards: list[tuple[int, int]]):
    def read(batches):
        for batch in batches:
            for shard, base in (shards[k] for k in batch.column("id").to_pylist()):
                fs, path = filesystem(f"{folder}/{shard:05d}.arrows")
                _, index = filesystem(f"{folder}/{shard:05d}.index.arrows")
                with fs.open_input_stream(path) as a, fs.open_input_stream(index) as b:
                    parts, held, at = pa.ipc.open_stream(a), np.zeros(0, np.uint16), 0  # held: ids from number ``at`` of the shard on
                    for docs in pa.ipc.open_stream(b):
                        out = []
                        for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                            pieces, have = [held], at + len(held)
                            while have < start + n:
                                x = parts.read_next_batch()
                                ids = x.column(0).flatten().to_numpy()
                                mask = x.column(1).flatten()
                                ids = ids if mask.true_count == len(ids) else ids[mask.to_numpy(zero_copy_only=False)]
                                pieces.append(ids)
                                have += len(ids)
                            if len(pieces) > 1:
                                held = np.concatenate(pieces) if len(held) else np.concatenate(pieces[1:])
                            out.append(held[start - at : start - at + n].astype("<u4"))
                            held, at = held[start - at + n :], start + n
                        yield pa.RecordBatch.from_arrays(
                            [docs.column("doc_id"), pa.array(base + np.array(docs.column("start"))), docs.column("n_tokens"), pa.array([zlib.crc32(x) for x in out], pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return read


def read_documents(spark, folder: str, manifest) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and the crc32 of its ids as 32-bit integers."""
    bases, total = [], 0
    for shard, _, n, _ in manifest:
        bases.append((shard, total))
        total += n
    plan = spark.range(0, len(bases), 1, max(1, len(bases)))  # a shard a partition
    return plan.mapInArrow(_read(folder, bases), "doc_id long, start long, n_tokens long, ids_crc32 long")
