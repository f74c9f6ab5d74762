"""Quality rules as a short-circuit cascade, all in DataFrame functions.

Base figures of each text come first. The rules are then put in the order of rejections per cost, both estimated on a
sample in one job, and evaluated as one conditional: a text that a rule rejects is not seen by the rules after it. A verdict doesn't depend on the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*BASE, "base_failed", "kept"]
#: Characters of work for a character of text, by part of a rule.
_COSTS = {"replace(t": 1.0, "length(t": 0.2, "regexp_replace(t": 7.0, "split(t": 3.0, "rlike": 8.0}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an SQL condition over the text (``t``) and the base figures; null doesn't reject."""

    name: str
    rejects: str


#: Thresholds of published rule sets for web text, on figures of the whole text.
RULES = (
    Rule("symbols", "n_symbols > 0.1 * n_words"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words"),
    Rule("dup_lines", "n_dup_lines > 0.3 * (length(t) - length(replace(t, '\n', '')) + 1)"),
    Rule("shouting", r"2 * length(regexp_replace(t, '[^\\p{Lu}]+', '')) > length(regexp_replace(t, '[^\\p{L}]+', ''))"),
    Rule("exclamations", "length(t) - length(replace(t, '!', '')) > 0.3 * n_words"),
    Rule("letters", r"length(regexp_replace(t, '[^\\p{L}]+', '')) < 0.5 * word_chars"),
    Rule("ellipses", r"size(filter(split(t, '\n'), x -> x rlike '(\\.\\.\\.|…)\\s*$')) > 0.3 * (length(t) - length(replace(t, '\n', '')) + 1)"),
    Rule("bullets", r"size(filter(split(t, '\n'), x -> x rlike '^\\s*[-*•]')) > 0.9 * (length(t) - length(replace(t, '\n', '')) + 1)"),
)


def base_figures(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """Adds ``t`` (the text, null as empty) and the base figures to the columns ``keep``; reads nothing else."""
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    # Each select holds arrays that the next one uses more than once, so that none is computed within a lambda.
    d = df.select(kept, F.coalesce(text, F.lit("")).alias("t"))
    d = d.select("row", "t", F.array_remove(F.split(F.translate("t", _SPACES[1:], " " * 5), " "), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"))
    d = d.select(
        "row",
        "t",
        F.size("w").alias("n"),
        F.array_join("w", "").alias("bare"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    windows = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.select(
        "row",
        "t",
        F.col("n").cast("long").alias("n_words"),
        F.length("bare").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("bare", f"[^{_SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), windows).alias("s"),  # most texts repeat no window
    )
    alike = F.filter("s", lambda x, k: F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False)) | ((k > 0) & F.coalesce(F.get("s", k - 1)["h"] == x["h"], F.lit(False))))
    d = d.select("row", "t", *BASE[:4], F.sort_array(F.transform(alike, lambda x: x["i"])).alias("at"))
    steps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))  # words that a window adds before the next
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    here = F.monotonically_increasing_id() >= 0  # always true, but no filter on the figures moves below it into the lambdas, where it would compute arrays per element
    return d.select("row.*", "t", *BASE[:4], F.when(here, repeated).alias("n_repeat_words"))


def scanned(rule: Rule) -> float:
    """Cost of a rule by its parts: characters of work for a character of text. Base figures are at hand, a replaced literal is one pass, a pattern several, a pattern a line more."""
    return 0.01 + sum(cost * rule.rejects.count(part) for part, cost in _COSTS.items())


def order_rules(figures: DataFrame, rules=RULES) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, cost a text), the most rejections per cost first. ``figures``: a bounded sample, read once.

    Selectivity comes from the sample, and so does cost: the sample's mean text length times the rule's work a character, so that
    it is the same in every run; times of short jobs are not.
    """
    found = figures.agg(F.count("*").alias("n"), F.avg(F.length("t")).alias("chars"), *(F.count_if(F.expr(r.rejects)).alias(f"r{k}") for k, r in enumerate(rules))).first()
    rated = [(r, found[f"r{k}"] / max(found["n"], 1), scanned(r) * (found["chars"] or 1.0)) for k, r in enumerate(rules)]
    return sorted(rated, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def sampled(docs: DataFrame, text_col: str, sample_rows: int, seed: int = 11) -> DataFrame:
    """About ``sample_rows`` texts at most, drawn row by row where they are, so nothing is shuffled."""
    texts, n = docs.select(F.col(text_col).alias("text")), docs.count()
    return texts if n <= sample_rows else texts.where(F.rand(seed) < sample_rows / n)


def apply_rules(docs: DataFrame, keep: list[str], text_col: str = "text", rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """Columns ``keep``, the base figures, ``base_failed`` and ``kept``, for each row.

    base_failed: under 50 words, or over half of the words in 3-word windows that the text repeats. kept: false if so, or if a
    rule rejects the text. About ``sample_rows`` texts set the order of the rules, nothing else. A null text is empty: it fails.
    Repeated rows are each judged. An empty table gives an empty result. Columns not in ``keep`` are not read, whatever their names;
    a kept column named like a result comes back as ``doc_`` and its name.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    sample = base_figures(sampled(docs, text_col, sample_rows), F.col("text"), ["text"]).select("t", *BASE)
    ordered = [r for r, _, _ in order_rules(sample.where(~failed), rules)]
    verdict = F.when(failed, False)
    for r in ordered:
        verdict = verdict.when(F.expr(r.rejects), False)
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"doc_{c}" if c in RESULTS else c) for c in keep)).alias("row"), F.col(text_col).alias("text"))
    d = base_figures(rows, F.col("text"), ["row"])
    names = [f"doc_{c}" if c in RESULTS else c for c in keep]
    return d.select(*(F.col(f"row.`{c}`") for c in names), *BASE, failed.alias("base_failed"), verdict.otherwise(True).alias("kept"))
