import hashlib
import random

from tests.llm import cases
from tesserae.llm.decontaminate import brute_force, built, scan
from tesserae.llm.shared import checkpointed


def items():
    t = cases.texts()
    return [(1, t[0][20:200]), (2, t[3]), (3, "ONE"), (4, None), (5, "  !! "), (6, "漢字 Nbsp, wide"), (None, "two words"), (2, t[13][100:300]), (10, " ".join(t[0].split()[3:11]))]


def collected(df):
    return {r.doc_id: (r.n_words, r.n_hit, r["items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in df.collect()}


def test_matches_brute_force(spark):
    docs = cases.documents(spark)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    expected = brute_force(list(enumerate(cases.texts())), items())
    assert any(len(x[2]) > 1 for x in expected.values())
    assert collected(scan(docs, bench, ["doc_id"])) == expected


def test_several_automata_agree(spark, monkeypatch):
    long_item = [(11, cases.words(6000, 21)), (12, cases.words(6000, 21)[-400:])]
    bench = spark.createDataFrame([*items(), *long_item], "item_id long, text string")
    texts = [*cases.texts(), cases.words(6000, 21)[5000:9000]]
    docs = cases.documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(len(texts) - 1, texts[-1])], "doc_id long, text string"))
    made = []
    monkeypatch.setattr("tesserae.llm.decontaminate.checkpointed", lambda df: made.append(0) or checkpointed(df))
    assert collected(scan(docs, bench, ["doc_id"], automaton_mb=1.5)) == brute_force(list(enumerate(texts)), [*items(), *long_item])
    assert len(made) > 2


def test_the_automaton_is_as_large_as_estimated():
    r = random.Random(1)
    pieces = [(str(k), " ".join(f"w{r.randrange(20_000)}" for _ in range(200))) for k in range(200)]
    a = built(pieces, 8)
    assert len(a.items) == 200 * 193
    assert a.found.get_stats()["total_size"] < len(a.items) * 16 * 44


def test_kept_columns_of_clashing_names(spark):
    docs = cases.documents(spark)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = scan(docs, bench, ["doc_id", "items", "n_words", "spans", "row", "text"])
    assert got.columns == ["doc_id", "doc_items", "doc_n_words", "doc_spans", "row", "text", "n_words", "n_hit", "items", "word_spans", "spans"]
    assert {r.doc_n_words for r in got.collect()} == {"clash"}


def test_offsets_are_of_the_original(spark):
    text = "Äh — THE quick,brown Fox jumps. Ok"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "quick brown fox")], "item_id string, text string")
    r = scan(docs, bench, ["doc_id"]).first()
    assert [text[s.start : s.end] for s in r.spans] == ["quick,brown Fox"]


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert scan(cases.empty(spark), none, ["doc_id"]).count() == 0
    assert sum(r.n_hit for r in scan(cases.documents(spark), none, ["doc_id", "lang"]).collect()) == 0
