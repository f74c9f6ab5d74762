"""Chat formatting by schema fingerprints, all in DataFrame functions.

A record is JSON text. Its nested field paths, without types, are hashed; the hash selects a declared mapping that makes canonical
turns (role, text) of it. Turns are then marked by control strings, and control strings within texts are escaped:

    <|start|>role<|message|>text<|end|>

An escape is U+241B: each one of a text becomes U+241B and a dot, and one with a hyphen is put after the first
character of each control string, of this template or a common other one. Reading takes the two out again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MESSAGE, END, ESCAPE = "<|start|>", "<|message|>", "<|end|>", "␛"
#: Control strings of common templates, without their first character.
_CONTROL = r"\||/?s>|/?INST\]|</?SYS>>|(?:pad|unk|bos|eos|mask)>|(?:start|end)_of_turn>"
#: Spark's JSON reader takes no string value of more characters, and gives null for a record that holds one.
_LONGEST = 20_000_000
_LONG_TURN, _PIECE = 4_000_000, 1_000_000  # characters of a turn that is written in pieces, and of a piece
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``example`` has the field paths of a layout; ``turns`` is SQL that makes canonical turns of the record ``r``."""

    name: str
    example: object
    turns: str


def _pair(first: str, second: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {first}), named_struct('role', 'assistant', 'text', {second}))"


def _field(name: str) -> str:
    return f"coalesce(get_json_object(r, '$.{name}'), '')"


def _list(field: str, role: str, text: str, roles: str = "x.{role}") -> str:
    return f"transform(from_json(r, '{field} array<struct<`{role}`:string,`{text}`:string>>').{field}, x -> named_struct('role', coalesce({roles.format(role=f'`{role}`')}, ''), 'text', coalesce(x.`{text}`, '')))"


_SHARED = "CASE x.{role} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.{role} END"
_WITH_INPUT = "concat_ws('\n\n', {0}, nullif({1}, ''))".format(_field("instruction"), _field("input"))
_PARTS = "transform(from_json(r, 'messages array<struct<role:string,content:array<struct<type:string,text:string>>>>').messages, x -> named_struct('role', coalesce(x.role, ''), 'text', coalesce(array_join(transform(filter(x.content, p -> p.type = 'text'), p -> p.text), ''), '')))"
LAYOUTS = (
    Layout("messages", {"messages": [{"role": "", "content": ""}]}, _list("messages", "role", "content")),
    Layout("messages of parts", {"messages": [{"role": "", "content": [{"type": "", "text": ""}]}]}, _PARTS),
    Layout("no messages", {"messages": []}, f"cast(array() as {_TURNS})"),
    Layout("conversations", {"conversations": [{"from": "", "value": ""}]}, _list("conversations", "from", "value", _SHARED)),
    Layout("prompt, completion", {"prompt": "", "completion": ""}, _pair(_field("prompt"), _field("completion"))),
    Layout("prompt, response", {"prompt": "", "response": ""}, _pair(_field("prompt"), _field("response"))),
    Layout("question, answer", {"question": "", "answer": ""}, _pair(_field("question"), _field("answer"))),
    Layout("instruction, output", {"instruction": "", "output": ""}, _pair(_field("instruction"), _field("output"))),
    Layout("instruction, input, output", {"instruction": "", "input": "", "output": ""}, _pair(_WITH_INPUT, _field("output"))),
    Layout(
        "system, instruction, output",
        {"system": "", "instruction": "", "output": ""},
        f"array(named_struct('role', 'system', 'text', {_field('system')}), named_struct('role', 'user', 'text', {_field('instruction')}), named_struct('role', 'assistant', 'text', {_field('output')}))",
    ),
)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON record, types of values left out; null if it is no JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.xxhash64(F.regexp_replace(schema, r"(?<=: |ARRAY<)(?!ARRAY<|OBJECT<)[A-Z_]+(\([0-9, ]*\))?", "_"))


def canonical(records: DataFrame, id_col: str, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """``id``, ``layout`` and ``turns`` of each JSON record. A record of no declared layout, or that is no JSON, has null for both.

    Missing or null values are empty texts; of content in parts the texts are joined. Rows that repeat are each mapped. Other columns are not read, whatever their names.
    A record of over 20 million characters that the JSON reader doesn't take is an error, as it can be JSON with a longer string.
    """
    d = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("r"))
    fp = F.when(F.try_parse_json("r").isNotNull(), fingerprint(F.col("r")))
    too_long = F.concat(F.lit("no JSON, or a string of more than 20,000,000 characters, in the record of id "), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    d = d.select("id", "r", fp.alias("fp")).withColumn("fp", F.when(F.col("fp").isNull() & (F.length("r") > _LONGEST), F.raise_error(too_long).cast("long")).otherwise(F.col("fp")))
    known = d.sparkSession.range(1).select(*(fingerprint(F.lit(json.dumps(x.example))) for x in layouts)).first()  # constants
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for fp, x in zip(known, layouts):
        name = F.when(F.col("fp") == fp, F.lit(x.name)).otherwise(name)
        turns = F.when(F.col("fp") == fp, F.expr(x.turns)).otherwise(turns)
    return d.select("id", name.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ".")), rf"(?i)([<\[])(?={_CONTROL})", f"$1{ESCAPE}-")


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "-"), F.lit("")), F.lit(ESCAPE + "."), F.lit(ESCAPE))


def format_turns(chats: DataFrame, trained: str = "assistant") -> DataFrame:
    """``formatted``, and ``loss``: the spans of the texts of role ``trained``, as (turn, start in it, length) and the start in ``formatted``, in characters.

    Chats without turns are an empty text; null turns stay null.
    """
    text = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), escaped(x["role"]).alias("head"), escaped(x["text"]).alias("body")))
    d = chats.withColumn("coded", text)
    parts = F.transform("coded", lambda x: F.struct((x["role"] == trained).alias("on"), F.concat(F.lit(START), x["head"], F.lit(MESSAGE), x["body"], F.lit(END)).alias("part"), (F.length(x["head"]) + len(START) + len(MESSAGE)).alias("at"), F.length(x["body"]).alias("n")))
    d = d.withColumn("coded", parts)
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("turn"), F.array().cast("array<struct<turn:int,start_in_turn:int,length:int,start:int>>").alias("spans"))

    def add(a, x):
        span = F.array(F.struct(a["turn"].alias("turn"), x["at"].alias("start_in_turn"), x["n"].alias("length"), (a["end"] + x["at"]).alias("start")))
        return F.struct((a["end"] + F.length(x["part"])).alias("end"), (a["turn"] + 1).alias("turn"), F.when(x["on"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return d.withColumns({"formatted": F.array_join(F.transform("coded", lambda x: x["part"]), ""), "loss": F.aggregate("coded", zero, add)["spans"]}).drop("coded")


def read_turns(formatted: DataFrame) -> DataFrame:
    """Adds ``read`` (turns, unescaped) and ``loss_text`` (all text under the loss spans, unescaped) from ``formatted`` and ``loss`` alone.

    An empty text has no turns; a null one has null for both. Repeated rows are each read; an empty table gives an empty result.
    """
    d = formatted.withColumn("parts", F.slice(F.split("formatted", START.replace("|", r"\|")), 2, 1 << 30))
    shape = rf"(?s)^(.*?){MESSAGE}(.*){END}$".replace("|", r"\|")
    turns = F.transform("parts", lambda p: F.struct(unescaped(F.regexp_extract(p, shape, 1)).alias("role"), unescaped(F.regexp_extract(p, shape, 2)).alias("text")))
    masked = F.transform("loss", lambda s: F.substring(F.get("parts", s["turn"]), s["start_in_turn"] - len(START) + 1, s["length"]))
    return d.withColumns({"read": turns, "masked": masked}).withColumn("loss_text", unescaped(F.array_join("masked", ""))).drop("parts", "masked")


def _written(name: str) -> tuple[Column, Column]:
    """Of conversations ``m`` (turn, role, content): which of them a layout can hold without loss, and their record in it."""
    roles = F.transform("m", lambda x: x["role"])
    content = [F.get("m", F.lit(k))["content"] for k in range(3)]

    def of(*wanted: str) -> Column:
        return roles == F.array(*(F.lit(x) for x in wanted))

    def fields(**values: Column) -> Column:
        return F.struct(*(v.alias(k) for k, v in values.items()))

    plain = F.forall(roles, lambda x: x.isin("user", "assistant", "system"))
    shared = F.transform("m", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["content"].alias("value")))
    cut = F.instr(content[0], "\n\n")  # an instruction and an input that come together again with that between them
    before, after = F.substring(content[0], F.lit(1), cut - 1), F.substring(content[0], cut + 2, F.length(content[0]))
    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.length(x) / _PIECE).cast("int")), lambda k: fields(type=F.lit("text"), text=F.substring(x, k * _PIECE + 1, F.lit(_PIECE))))
    return {
        "messages": (F.lit(True), fields(messages=F.transform("m", lambda x: fields(role=x["role"], content=x["content"])))),
        "messages of parts": (F.size("m") > 0, fields(messages=F.transform("m", lambda x: fields(role=x["role"], content=pieces(x["content"]))))),
        "conversations": (plain & (F.size("m") > 0), fields(conversations=shared)),
        "prompt, completion": (of("user", "assistant"), fields(prompt=content[0], completion=content[1])),
        "prompt, response": (of("user", "assistant"), fields(prompt=content[0], response=content[1])),
        "question, answer": (of("user", "assistant"), fields(question=content[0], answer=content[1])),
        "instruction, output": (of("user", "assistant"), fields(instruction=content[0], output=content[1])),
        "instruction, input, output": (of("user", "assistant") & (cut > 1) & (F.length(after) > 0), fields(instruction=before, input=after, output=content[1])),
        "system, instruction, output": (of("system", "user", "assistant"), fields(system=content[0], instruction=content[1], output=content[2])),
    }[name]


#: Layouts that conversations can be written in, all but "no messages".
ALL = tuple(x.name for x in LAYOUTS if x.name != "no messages")


def records_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", layouts: tuple[str, ...] = ("messages",)) -> DataFrame:
    """``id`` and a JSON ``record`` of each conversation of turn rows, ordered by turn, ties by role and text; null turns first, null roles and texts empty.

    Of the ``layouts`` that can hold a conversation without loss a hash of its id and texts takes one; "messages" can hold all. A conversation with a turn
    of over 4 million characters is written in parts, as Spark's JSON reader bounds a string. Rows that repeat are each a turn; a null id is a
    conversation like another; an empty table gives an empty result; other columns are not read. A conversation is one row, held whole by a task several times
    over: one of 128 MB or more (Spark's bound of a variant) stops with an error in ``canonical``.
    """
    d = rows.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("content")).alias("m"))
    d = d.groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    fit = F.filter(F.array(*(F.when(_written(x)[0], F.lit(x)) for x in layouts)), lambda x: x.isNotNull())
    fit = F.when(F.exists("m", lambda x: F.length(x["content"]) > _LONG_TURN), F.array(F.lit("messages of parts"))).when(F.size(fit) > 0, fit).otherwise(F.array(F.lit("messages")))
    d = d.select("id", "m", fit.alias("fit")).select("id", "m", F.get("fit", F.pmod(F.xxhash64("id", F.size("m")), F.size("fit")).cast("int")).alias("layout"))
    record = F.when(F.col("layout") == "messages", F.to_json(_written("messages")[1]))
    for x in dict.fromkeys((*layouts, "messages of parts")):
        record = record.when(F.col("layout") == x, F.to_json(_written(x)[1]))
    return d.select("id", record.alias("record"))
