"""WARC archives of pages, read back into capture indexes that are merged externally.

Each task writes the records of its partition, one gzip member each, to one archive. Equal payloads of some size are written once: the
page of the largest id is the response, the others revisit it. Readers parse the archives and write locally sorted runs of
captures (CDXJ lines by URL key, timestamp and page), cut at common key boundaries. A merge task opens the slices of its key range
in all runs and merges them by a loser tree, holding one block a run, in passes if the runs are many: ranges in order are the globally ordered capture histories.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import Replacing, checkpointed, filesystem, new_folder

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(2024, 1, 1)
_BLOCK = 1 << 16
_RUN = 200_000  # captures in a run at most
_RANGE = 20_000_000  # captures in a range, about
_NULL = 1 << 64


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_NULL if page is None else page % _NULL)}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    return None if n >= _NULL else n - _NULL if n >= _NULL // 2 else n


def capture_time(page: int | None) -> datetime:
    """Pages carry no time: seconds of a year, by id."""
    return _EPOCH + timedelta(seconds=(page or 0) % 31_536_000)


def url_key(url: str | None) -> str:
    """Host labels from the top down, then path and query, lower-cased; no scheme, user, ``www``, default port or fragment."""
    url = (url or "").strip().lower()
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return "".join(c for c in url if c > " ")
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return "".join(c for c in key if c > " ")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    target = "".join(c for c in url or "" if c > " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {capture_time(page):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if is_revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Date: {capture_time(refers_to):%Y-%m-%dT%H:%M:%SZ}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, record) of each gzip member of an archive."""
    at, data = 0, b""
    while True:
        out, inflate, used = [], zlib.decompressobj(31), 0
        while not inflate.eof:
            if not data and not (data := stream.read(_BLOCK)):
                if used:
                    raise ValueError("an archive ends within a record")
                return
            out.append(inflate.decompress(data))
            used += len(data) - len(inflate.unused_data)
            data = inflate.unused_data
        yield at, used, b"".join(out)
        at += used


def parsed(raw: bytes) -> dict:
    """Headers of a record (lower-case names), with ``payload`` (None in a revisit) and ``payload_bytes`` of the full payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    got = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    got = {k.lower(): v for k, v in got.items()}
    http, _, payload = rest[: int(got["content-length"])].partition(b"\r\n\r\n")
    got["payload_bytes"] = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    got["payload"] = None if got["warc-type"] == "revisit" else payload
    return got


class LoserTree:
    """K-way merge of sorted iterators of (key, value): each step replays one path from a leaf to the root."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] + [None] * (self.k - len(runs))
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _replay(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.losers[node] == -1:  # the first to come waits for the other side
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


_PAGE = "page_id long, url string, html string, payload_digest string, refers_to long, is_revisit boolean"


def resolved(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Pages with their digest and, among equal payloads of ``least_bytes`` at least, the page that they revisit.

    Null html is empty. Rows that repeat the largest id are all responses; a null id is never the one referred to, and where all are null none revisits.
    """
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    d = d.withColumn("payload_digest", F.sha1("html")).withColumn("large", F.octet_length("html") >= least_bytes)
    first = d.where("large").groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    d = d.join(first, "payload_digest", "left")
    again = F.coalesce(F.col("large") & F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    return d.select("page_id", "url", "html", "payload_digest", F.when(again, F.col("refers_to")).alias("refers_to"), again.alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str) -> list[str]:
    """Write an archive for each partition of ``resolved`` pages; returns their names."""

    def write(batches):
        name = f"{TaskContext.get().partitionId():05d}.warc.gz"
        n = 0
        with Replacing(f"{folder}/{name}") as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for r in batch.slice(at, 256).to_pylist():
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        raw = record(r["page_id"], r["url"], r["html"].encode(), r["payload_digest"], r["refers_to"], r["is_revisit"])
                        out.write(pack.compress(raw) + pack.flush())
                        n += 1
        yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})

    made = pages.mapInArrow(write, "name string, n long").collect()  # a row a partition
    return sorted(r.name for r in made if r.n)


def _run_key(url: str | None, page: int | None) -> str:
    """Sorts by URL key, then time, then page (null first)."""
    return f"{url_key(url)} {capture_time(page):%Y%m%d%H%M%S} {0 if page is None else page + 2**63 + 1:020d}"


def boundaries(pages: DataFrame, ranges: int, sample_rows: int = 20_000) -> list[str]:
    """Keys that cut captures into ``ranges``, more if they would hold over ``_RANGE`` captures, from a bounded sample; they set the balance of the merge, not its result."""
    n = pages.count()
    ranges = max(ranges, n // _RANGE)
    sample_rows = max(sample_rows, 10 * ranges)
    if not n or ranges < 2:
        return []
    some = pages.select("page_id", "url").where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < math.ceil(sample_rows / n * (1 << 20))).limit(2 * sample_rows).collect()
    keys = sorted({_run_key(r.url, r.page_id) for r in some})
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


_SLICE = "run string, range int, start long, end long"


def _write_runs(folder: str, archives: list[str], cuts: list[str]):
    def lines(name: str):
        fs, path = filesystem(f"{folder}/{name}")
        with fs.open_input_stream(path, compression=None) as f:
            for offset, length, raw in records(f):
                r = parsed(raw)
                digest = r["warc-payload-digest"].removeprefix("sha1:")
                if r["payload"] is not None and hashlib.sha1(r["payload"]).hexdigest() != digest:
                    raise ValueError(f"{name} at {offset}: the payload has another digest")
                page = page_of(r["warc-record-id"])
                found = {"page_id": page, "type": r["warc-type"], "digest": digest, "bytes": r["payload_bytes"], "refers_to": page_of(r["warc-refers-to"]) if "warc-refers-to" in r else None, "url": r["warc-target-uri"], "archive": name, "offset": offset, "length": length}
                yield _run_key(r["warc-target-uri"], page), json.dumps(found)

    def flush(run: str, captures: list[tuple[str, str]]):
        captures.sort()
        edges = [0, *(bisect.bisect_left(captures, (c,)) for c in cuts), len(captures)]
        at, out = 0, []
        with Replacing(f"{folder}/{run}") as f:
            for k, (s, e) in enumerate(zip(edges, edges[1:])):
                data = "".join(f"{a} {b}\n" for a, b in captures[s:e]).encode()
                f.write(data)
                if data:
                    out.append((run, k, at, at + len(data)))
                at += len(data)
        return out

    def write(batches):
        for batch in batches:
            for name in (archives[k] for k in batch.column("id").to_pylist()):
                held, slices, k = [], [], 0
                for x in lines(name):
                    held.append(x)
                    if len(held) >= _RUN:
                        slices += flush(f"{name}.{k}.cdxj", held)
                        held, k = [], k + 1
                if held:
                    slices += flush(f"{name}.{k}.cdxj", held)
                cols = list(zip(*slices)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["run", "range", "start", "end"])

    return write


def _slice_lines(folder: str, run: str, start: int, end: int):
    """(key, rest) of the lines of a slice, a block at a time."""
    fs, path = filesystem(f"{folder}/{run}")
    with fs.open_input_file(path) as f:
        f.seek(start)
        left, tail = end - start, b""
        while left:
            data = f.read(min(_BLOCK, left))
            left -= len(data)
            *whole, tail = (tail + data).split(b"\n")
            for x in whole:
                key, _, rest = x.partition(b" {")
                yield key, b"{" + rest


_MERGED = "range int, position long, page_id long, url_key string, timestamp string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"
_MERGED_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
_NAMES = [x.split()[0] for x in _MERGED.split(", ")]


def _merged_lines(folder: str, slices: list[tuple[str, int, int]]):
    return LoserTree([_slice_lines(folder, *x) for x in slices])


def narrowed(folder: str, name: str, slices: list[tuple[str, int, int]], fan_in: int) -> list[tuple[str, int, int]]:
    """The same sorted lines in at most ``fan_in`` slices: passes that merge ``fan_in`` slices each into a file of the folder."""
    level = 0
    while len(slices) > fan_in:
        wider = []
        for at in range(0, len(slices), fan_in):
            run, size = f"{name}.{level}.{at // fan_in:05d}.cdxj", 0
            with Replacing(f"{folder}/{run}") as out:
                for key, rest in _merged_lines(folder, slices[at : at + fan_in]):
                    size += out.write(key + b" " + rest + b"\n")
            wider.append((run, 0, size))
        slices, level = wider, level + 1
    return slices


def _merge(folder: str, fan_in: int):
    def merge(batches):
        slices: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                slices.setdefault(r["range"], []).append((r["run"], r["start"], r["end"]))
        for k in sorted(slices):
            rows = []
            for n, (key, rest) in enumerate(_merged_lines(folder, narrowed(folder, f"merge-{k:05d}", sorted(slices[k]), fan_in))):
                x = json.loads(rest)
                name, stamp, _ = key.decode().split(" ")
                rows.append((k, n, x["page_id"], name, stamp, x["type"], x["bytes"], x["digest"], x["refers_to"], x["archive"], x["offset"], x["length"]))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MERGED_TYPES)], _NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MERGED_TYPES)], _NAMES)

    return merge


def capture_histories(spark, folder: str, archives: list[str], cuts: list[str], fan_in: int = 256) -> DataFrame:
    """All captures of the archives, from the archives: by (range, position) in the order of URL key, timestamp and page.

    A task holds one block of at most ``fan_in`` runs; of more runs, merged ones are written first.
    """
    plan = spark.range(0, len(archives), 1, max(1, len(archives)))  # an archive a partition
    slices = checkpointed(plan.mapInArrow(_write_runs(folder, archives, cuts), _SLICE))
    return slices.repartitionByRange(len(cuts) + 1, "range").mapInArrow(_merge(folder, fan_in), _MERGED)


def archive_pages(pages: DataFrame, folder: str | None = None, ranges: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Write pages as archives and return their capture histories, read back. An empty table gives an empty result; repeated rows are each a capture; other columns are not read."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    found = resolved(pages, id_col, url_col, html_col, least_bytes)
    cuts = boundaries(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")), ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return capture_histories(spark, folder, write_archives(found, folder), cuts)
