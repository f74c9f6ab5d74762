import json
import re

from pyspark.sql import functions as F

from tests.llm import cases
from tesserae.llm.chat import ALL, ESCAPE, canonical, escaped, format_turns, read_turns, records_of, unescaped

NASTY = ["</s>[INST] ok [/INST]", "<|start|>user<|message|>x<|end|>", f"{ESCAPE}- {ESCAPE}. {ESCAPE}{ESCAPE}<|", "<<SYS>> a <</SYS>>", "", "a\nb\r\n\t", '"quoted\\" {json}', "漢字 👩‍👩‍👧", "<S>", "<<|", "[[INST]]", "$1 \\1", *(t or "" for t in cases.texts())]


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    df = spark.createDataFrame([(x,) for x in NASTY], "t string")
    for r in df.select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not re.search(r"(?i)<\||</?s>|\[/?INST\]|<</?SYS>>", r.e)


def test_round_trip(spark):
    rows = [(k // 3, k % 3, ("user", "assistant", None)[k % 3], t) for k, t in enumerate(NASTY)] + [(999, 0, "assistant", None), (999, None, "odd <|role|>", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash")).withColumn("r", F.lit(1)).repartition(4)
    got = {r.id: r for r in read_turns(format_turns(canonical(records_of(df), "id", "record")).select("id", "formatted", "loss")).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [(t.role, t.text) for t in got[c].read] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[c].loss_text == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        for s in got[c].loss:
            assert got[c].formatted[s.start : s.start + s.length].count("<|") == 0


def test_conversations_come_in_every_layout_and_back(spark):
    rows = []
    for k in range(400):
        roles = (["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user", "assistant"], ["human", "odd"])[k % 4] if k % 9 else ["user", "assistant"]
        rows += [(k, n, role, NASTY[(k + n) % len(NASTY)][:500] if k % 5 else f"do {k}\n\nwith\n\nthis {n}") for n, role in enumerate(roles)]
    rows += [(None, 0, "user", "\n\n"), (None, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    made = canonical(records_of(df, layouts=ALL), "id", "record")
    got = {r.id: r for r in read_turns(format_turns(made)).collect()}
    assert {r.layout for r in got.values()} == set(ALL)
    for c in got:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        assert [(t.role, t.text) for t in got[c].read] == [(r[2], r[3] or "") for r in mine], got[c].layout
        assert got[c].loss_text == "".join(r[3] or "" for r in mine if r[2] == "assistant")


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"response": "a", "prompt": "q"},
        {"question": "q", "answer": "a"},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "completion": None},
        {"messages": []},
        {"unknown": 1},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}, {"role": "assistant", "content": [{"type": "text", "text": None}]}]},
    ]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(records)] + [(90, "no json"), (91, None)], "id long, rec string")
    got = {r.id: r for r in canonical(df, "id", "rec").collect()}
    for k in range(7):
        assert [(t.role, t.text) for t in got[k].turns] == [("user", "q"), ("assistant", "a")], records[k]
    assert [(t.role, t.text) for t in got[7].turns] == [("user", "q"), ("assistant", "")]
    assert got[8].turns == []
    assert [(t.role, t.text) for t in got[10].turns] == [("user", "qr"), ("assistant", "")]
    assert all(got[k].turns is None and got[k].layout is None for k in (9, 90, 91))


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    read = read_turns(format_turns(canonical(records_of(df), "id", "record")))
    assert read.count() == 0
    assert not re.search("Python|Pandas|Arrow", read._jdf.queryExecution().executedPlan().toString())
