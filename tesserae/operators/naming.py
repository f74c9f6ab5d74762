"""File and output names."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a file name may not hold, what it may not begin or end with, and the name of nothing.
OTHERS, ENDS, UNTITLED = r"[^A-Za-z0-9._-]+", r"^[._]+|[._]+$", "untitled"


def _composing() -> str:
    """A pattern of ASCII letters before marks that they compose with to one character."""
    of: dict[str, list[str]] = {}
    for mark in map(chr, range(0x300, 0x370)):
        for letter in string.ascii_letters:
            if len(unicodedata.normalize("NFC", letter + mark)) == 1:
                of.setdefault(letter, []).append(mark)
    marks = lambda m: "".join(f"\\u{ord(x):04x}" for x in m)
    return "|".join(f"{letter}\\p{{M}}*?[{marks(m)}]" for letter, m in of.items())


_COMPOSING = _composing()


def clean_filename(name: Column) -> Column:
    """Runs of other characters become ``_``; dots and underscores at the ends go; nothing left is ``untitled``.

    Names are taken as composed (NFC): a letter goes together with a combining mark that it composes with.
    """
    composed = F.regexp_replace(F.translate(name, "\u212a", "K"), _COMPOSING, "\u00e9")
    kept = F.regexp_replace(composed, OTHERS, "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, ENDS, ""), F.lit("")), F.lit(UNTITLED))


def unique_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """Case-insensitively unique names: in order, each row takes the first of name, name_1, name_2, ... that no row before it has.

    A name clashes only with those that it equals, or that it equals but for numbers at the end. Where all names of such a stem are equal, the k-th repeat gets
    ``_k`` by a window. Where they are not (``a``, ``a``, ``a_1``), the stem's rows are walked in order by a task, which holds the names taken, not the rows.
    """
    low = F.lower(F.col(name))
    d = df.withColumns({"_low": low, "_stem": F.regexp_replace(low, r"(_[0-9]+)+$", "")})
    several = d.groupBy("_stem").agg((F.min("_low") != F.max("_low")).alias("_several"))
    d = d.join(several, "_stem")
    n = F.row_number().over(Window.partitionBy("_low").orderBy(*order)) - 1
    plain = d.where("NOT _several").withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), n.cast("string"))))
    keep = [*df.columns, out]

    def walk(batches):
        stem, used, following = None, set(), {}
        for pdf in batches:
            given = []
            for s, x, base in zip(pdf["_stem"], pdf[name], pdf["_low"]):
                if s != stem:
                    stem, used, following = s, set(), {}
                k = following.get(base, 0)
                while (taken := base if k == 0 else f"{base}_{k}") in used:
                    k += 1
                following[base] = k + 1
                used.add(taken)
                given.append(x if k == 0 else f"{x}_{k}")
            yield pdf.assign(**{out: given})[keep]

    rows = d.where("_several").repartition("_stem").sortWithinPartitions("_stem", *order)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return plain.select(*keep).unionByName(rows.mapInPandas(walk, schema))


def numbered(stem: Column, number: Column, alone: Column, width: int = 2) -> Column:
    """``stem_NN``; without a number where an object is alone. The width is a minimum."""
    return F.when(alone, stem).otherwise(F.concat_ws("_", stem, padded(number, width)))


def padded(number: Column, width) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def without_ansi(text: Column) -> Column:
    """Terminal colour and cursor codes removed."""
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[A-Za-z]", "")
