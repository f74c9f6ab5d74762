"""Texts that hold the strings of added tokens, against the plain call of the tokenizer."""

import zlib

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from tests.llm import cases
from tesserae.llm import queries
from tesserae.llm.token_output import Encoder

PATH, END = corpus_pipeline.TOKENIZER, "<|endoftext|>"
TEXTS = [f"a{END}b", f"a {END} b", END, END * 3, f"{END}\n{END} b\nq", f" {END}  c ", f"\n{END} \n b", f"x<|endoftext|{END}|>", "plain text", f"one\ntwo{END}three  four\n\n", "", None]


def plain():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_added_tokens_are_their_ids():
    ids, enc, texts = plain(), Encoder(PATH, added=True), [*TEXTS, *cases.texts()]
    assert ids(TEXTS[0]) == [64, 50256, 65]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts, 7)] == [[*ids(x), 7] for x in texts]


def test_query_and_last_stage_equal_the_plain_call(spark, tmp_path):
    ids, start, expected = plain(), 0, {}
    for k, x in enumerate(TEXTS):
        one = [*ids(x), 0]
        expected[k] = start, len(one), zlib.crc32(np.array(one, "<u4").tobytes())
        start += len(one)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op3_token_output(spark, str(tmp_path)), corpus_pipeline.tokens(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.collect()} == expected
