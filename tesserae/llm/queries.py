"""Queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import chat, decontaminate, mixing, quality_classifier, quality_rules, simhash, substring_dedup, token_output, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS n FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM n, unnest(generate_series(1, n - 19)) AS t(i) WHERE n >= 20),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
cov AS (SELECT DISTINCT doc_id, k FROM dup, unnest(generate_series(i, i + 19)) AS t(k)),
pos AS (SELECT doc_id, k, ws[k] AS word FROM n, unnest(generate_series(1, n)) AS t(k)),
kept AS (
  SELECT p.doc_id, count(*) AS c, string_agg(word, ' ' ORDER BY k) AS txt
  FROM pos p ANTI JOIN cov c ON c.doc_id = p.doc_id AND c.k = p.k GROUP BY 1)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM n LEFT JOIN kept ON kept.doc_id = n.doc_id
"""

def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


_OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 7], ' ') AS pat, least(8, len(ws)) AS width
  FROM b, unnest(generate_series(1, greatest(len(ws) - 7, 1))) AS t(i) WHERE len(ws) > 0),
widths AS (SELECT DISTINCT width FROM p),
win AS (SELECT doc_id, i, width, array_to_string(ws[i:i + width - 1], ' ') AS pat FROM w, widths, unnest(generate_series(1, len(ws) - width + 1)) AS t(i) WHERE len(ws) >= width),
hit AS (SELECT doc_id, i, win.width, item_id FROM win JOIN p ON p.pat = win.pat AND p.width = win.width),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(generate_series(i, i + width - 1)) AS t(k) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS txt FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(txt, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN words ON words.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id
"""


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    written = token_output.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_documents(spark, *written)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), keep=["doc_id"])


_OP4 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - 2)) AS x(i) WHERE len(ws) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS r FROM twice, unnest([i, i + 1, i + 2]) AS x(k) GROUP BY 1),
base AS (
  SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols > 0.1 * n_words OR word_chars < 2.5 * n_words OR word_chars > 12 * n_words OR n_dup_lines > 0.3 * n_lines
    OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(t, '[^\p{L}]+', '', 'g'))
    OR length(t) - length(replace(t, '!', '')) > 0.3 * n_words OR length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < 0.5 * word_chars
    OR len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 0.3 * n_lines
    OR len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\s*[-*•]'))) > 0.9 * n_lines AS rejected FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.dimensions(_table(spark, sf_dir, "documents"), ["doc_id"]).drop("row")
    return mixing.mix(docs, mixing.TARGETS).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "selected")


#: A conversation of control strings, besides those of the table.
_OWN = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_OWN).alias("text"))
    turns = chat.canonical(chat.records_of(rows.unionByName(own), layouts=chat.ALL), "id", "record")
    read = chat.read_turns(chat.format_turns(turns).select("id", "formatted", "loss"))
    said = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        F.col("id").alias("conv_id"),
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OP7 = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows),
n AS (
  SELECT *, (SELECT sum(length(x) + length(x) - length(replace(x, '␛', '')) + 2 * len(regexp_extract_all(x, '(?i)(<\||</?s>|\[/?INST\]|<</?SYS>>|<(pad|unk|bos|eos|mask)>|<(start|end)_of_turn>)'))) FROM (VALUES (role), (text)) AS v(x)) AS chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + 27 * count(*) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT h, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best <> page_id THEN best END AS refers_to
FROM p LEFT JOIN m USING (h)
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_output": op3_token_output,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_chat": op7_chat,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
}
_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op2_decontaminate": _OP2, "op4_quality_rules": _OP4, "op7_chat": _OP7, "op8_warc": _OP8}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
