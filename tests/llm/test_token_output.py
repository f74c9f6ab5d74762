import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from tesserae.llm.token_output import Encoder, read_documents, sequence, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def plain(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def expected(texts):
    out, start = {}, 0
    for k, x in enumerate(texts):
        ids = plain(x)
        out[k] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    return out


def test_round_trip_is_exact(spark):
    folder, manifest = write_tokens(cases.documents(spark).repartition(3), PATH, length=64, sequences=8, shard_mb=16)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_documents(spark, folder, manifest).collect()}
    assert got == expected(cases.texts())


def test_shards_and_random_access(spark):
    folder, manifest = write_tokens(cases.documents(spark), PATH, length=16, sequences=4, shard_mb=0.05)
    assert len(manifest) > 2
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_documents(spark, folder, manifest).collect()}
    assert got == expected(cases.texts())
    everything = [i for t in cases.texts() for i in plain(t)]
    for shard, _, tokens, rows in manifest:
        parts = [sequence(folder, shard, k) for k in range(rows)]
        assert all(len(i) == len(x) == 16 for i, x in parts)
        ids = [i for ids, mask in parts for i in ids[mask].tolist()]
        assert len(ids) == tokens and ids == everything[:tokens]
        everything = everything[tokens:]
        for beyond in (-1, rows, rows + 3, rows + 400):
            with pytest.raises(IndexError):
                sequence(folder, shard, beyond)
    assert not everything


def test_rows_of_one_id_and_of_none(spark):
    rows = [(k, cases.words(300, n)) for n in range(20) for k in (None, 7)] + [(None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder, manifest = write_tokens(docs, PATH, shard_mb=0.01)
    assert len(manifest) > 4 and max(n for _, n, _, _ in manifest) < 20  # a shard holds but a part of the rows of an id
    got = sorted(read_documents(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]
    crc = sorted(zlib.crc32(np.array(plain(t), "<u4").tobytes()) for _, t in rows)
    assert sorted(r.ids_crc32 for r in got) == crc
    assert len(write_tokens(docs, PATH, shard_mb=0.01, most_shards=3)[1]) == 3


@pytest.mark.parametrize("added", [True, False])
def test_pieces_encode_as_whole_texts(added):
    whole, enc = Tokenizer.from_file(PATH), Encoder(PATH, added)
    whole.encode_special_tokens = not added
    texts = ["  lead", "a  b", "a \n b", "a\n b\n\n c", "x ' y's 's", "tab\t c", "nbsp  x", "end ", "end  ", " ", "", "\x1c x \x1cy", "a  b", "emoji 👩‍👩‍👧 ok", *(t or "" for t in cases.texts())]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts, 7)] == [[*e.ids, 7] for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_empty(spark):
    folder, manifest = write_tokens(cases.empty(spark), PATH)
    assert read_documents(spark, folder, manifest).count() == 0
