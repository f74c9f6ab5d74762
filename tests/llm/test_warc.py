import gzip
import hashlib
import io
import random

from tesserae.llm.warc import LoserTree, _slice_lines, archive_pages, boundaries, capture_histories, narrowed, page_of, parsed, record, record_id, records, resolved, url_key, write_archives


def expected(rows, least=1000):
    best = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if len(b) >= least and page is not None:
            best[b] = max(best.get(b, page), page)
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        to = best.get(b) if best.get(b) != page else None
        out.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    return out


def key(r):
    return tuple((x is None, x) if x is not None else (True, 0) for x in r)


def rows():
    big, r = "é<p>" * 400, random.Random(1)
    return [(k, f"http://h{k % 5}.Example.com:80/a?b={k % 3}#f", big + str(k % 4) if k % 2 else "x" * (k % 1200)) for k in range(60)] + [(None, None, None), (None, "http://a/", big + "1"), (-5, "ftp://b", "y" * 1000), (-9, "::bad::[", "y" * 1000), (1 << 40, "", "\r\n\r\nWARC/1.1\r\n" * 100)] + [(7, "http://dup/", big + "3")] + [(r.randrange(10**6), f"u{k}", big) for k in range(20)]


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(5)
    got = archive_pages(df, ranges=3).collect()
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(mine, key=key) == sorted(expected(rows()), key=key)
    ordered = sorted(got, key=lambda r: (r.range, r.position))
    keys = [(r.url_key, r.timestamp) for r in ordered]
    assert keys == sorted(keys) and len({r.range for r in got}) > 1


def test_empty(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_records_are_gzip_members_of_plain_warc():
    a = record(3, "http://x/", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    b = record(4, "http://y/", b"payload", hashlib.sha1(b"payload").hexdigest(), 3, True)
    data = gzip.compress(a) + gzip.compress(b)
    found = list(records(io.BytesIO(data)))
    assert [x[2] for x in found] == [a, b] and found[1][0] == found[0][1] and sum(x[1] for x in found) == len(data)
    assert gzip.decompress(data) == a + b
    assert parsed(a)["payload"] == b"payload" and parsed(b)["payload"] is None and parsed(b)["payload_bytes"] == 7
    assert page_of(parsed(b)["warc-refers-to"]) == 3


def test_ids_and_keys():
    for page in (0, 5, -1, -(2**63), 2**63 - 1, None):
        assert page_of(record_id(page)) == page
    assert url_key("HTTPS://User@www.Example.com:443/A?b#c") == "com,example)/a?b"
    assert url_key(None) == ")/"


def test_loser_tree_merges():
    r = random.Random(4)
    for k in range(9):
        runs = [sorted((r.randrange(50), j) for j in range(r.randrange(30))) for _ in range(k)]
        assert [x[0] for x in LoserTree([iter(x) for x in runs])] == sorted(x[0] for y in runs for x in y)


def test_merging_in_passes(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(9)
    found = resolved(df).repartition(9)
    cuts = boundaries(df, 3)
    folder = f"file://{tmp_path}/w"
    names = write_archives(found, folder)
    assert len(names) == 9
    in_one, in_passes = (sorted(map(tuple, capture_histories(spark, folder, names, cuts, fan_in=n).collect()), key=str) for n in (256, 2))
    assert in_one == in_passes and list(tmp_path.glob("w/merge-*.2.*"))


def test_narrowed(tmp_path):
    r, slices, lines = random.Random(2), [], []
    for k in range(23):
        own = sorted(f"k{r.randrange(40):03d} {k:03d}{j:03d}" for j in range(r.randrange(9)))
        data = "".join(f"{x} {{}}\n" for x in own).encode()
        (tmp_path / f"r{k}").write_bytes(b"junk\n" + data)
        slices.append((f"r{k}", 5, 5 + len(data)))
        lines += own
    few = narrowed(f"file://{tmp_path}", "m", slices, 3)
    assert len(few) <= 3
    got = [key.decode() for key, _ in LoserTree([_slice_lines(f"file://{tmp_path}", *x) for x in few])]
    assert got == sorted(lines)
