"""Mixing sources to target weights: iterative proportional fitting of token weights, then a calibrated sample.

Tokens are summed per cell (a value of each dimension). Sweeps of windows over the cells rake their weights until the sums by
each dimension meet its targets; a document of a cell is then drawn with the cell's probability, by a hash of its id and text.
Everything is DataFrame functions. Cells are as many as the dimensions' values allow; while they are under a bound the sweeps run in one
partition, without a shuffle, and beyond it they are dealt by dimension.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.shared import checkpointed

_SMALL = 20_000  # cells in one partition, or in a broadcast
RESULTS = ["weight", "probability", "selected"]
_SEGMENT = 4  # sweeps between checkpoints


def n_tokens(text: Column) -> Column:
    """Words of a text (runs of other than space and \\t-\\r)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def topic(tokens: Column) -> Column:
    """A length band, which stands for the topic where documents have none."""
    return F.when(tokens < 100, "brief").when(tokens < 1000, "article").otherwise("long")


def _targets(cells: DataFrame, dim: str, want: dict[str, float] | float) -> DataFrame:
    """Share of each value of a dimension. A number: observed shares to that power; a dict: given shares. Both made to sum to 1 over values present; absent from a dict: none."""
    seen = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens"))
    if isinstance(want, dict):
        given = cells.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(want)), "map<string,double>")).alias("v", "share"))
        seen = seen.join(given, F.col(dim).eqNullSafe(F.col("v")), "left").select(dim, F.coalesce("share", F.lit(0.0)).alias("raw"))
    else:
        seen = seen.select(dim, F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(float(want)))).otherwise(0.0).alias("raw"))
    total = seen.agg(F.sum("raw").alias("total"))
    return seen.crossJoin(total).select(F.col(dim).alias("v"), (F.col("raw") / F.when(F.col("total") > 0, F.col("total"))).alias("share"))  # total is one row


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | float], tolerance: float = 1e-6, most_sweeps: int = 64) -> DataFrame:
    """Adds ``weight``: shares of cells (with ``tokens``) whose sums by each dimension are its targets, as near to the tokens' shares as can be.

    Targets that cells without tokens make impossible are met as far as raking goes. The last dimension is met last.
    """
    cells = checkpointed(cells)
    count = cells.count()
    if count <= _SMALL:
        cells = cells.coalesce(1)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    d = cells.withColumn("weight", F.col("tokens") / F.lit(float(max(total, 1))))
    for dim, want in targets.items():
        share = _targets(cells, dim, want).withColumnRenamed("v", f"v_{dim}").withColumnRenamed("share", f"share_{dim}")
        d = d.join(F.broadcast(share) if count <= _SMALL else share, F.col(dim).eqNullSafe(F.col(f"v_{dim}")), "left").drop(f"v_{dim}")
    d = checkpointed(d.coalesce(1) if count <= _SMALL else d)
    for _ in range(max(1, most_sweeps // _SEGMENT)):
        if count <= _SMALL:
            d = d.coalesce(1)
        for _ in range(_SEGMENT):
            for dim in targets:
                now = F.sum("weight").over(Window.partitionBy(dim))
                d = d.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"share_{dim}") / now).otherwise(0.0))
        d = checkpointed(d)
        off = [d.groupBy(dim).agg(F.abs(F.sum("weight") - F.first(f"share_{dim}")).alias("off")) for dim in targets]
        worst = off[0].select("off")
        for x in off[1:]:
            worst = worst.unionByName(x.select("off"))
        if (worst.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return d.select(*cells.columns, "weight")


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | float], tokens: str = "tokens", id_col: str = "doc_id", text_col: str = "text", seed: int = 7, target_tokens: int | None = None) -> DataFrame:
    """Adds ``weight`` (its cell's share of tokens), ``probability`` and ``selected`` to documents with their dimensions and ``tokens``.

    Probabilities are in proportion to weight over tokens. Without ``target_tokens`` the cell most in want is kept whole; with it
    they give so many expected tokens, cut at 1. A null value is a value of its own. Documents without tokens have probability 0.
    Repeated rows are drawn alike. An empty table gives an empty result. An input column of one of those names comes back as ``doc_`` and its name.
    """
    dims = list(targets)
    doc = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    cells = rake(docs.groupBy(*(F.col(f"`{x}`") for x in dims)).agg(F.sum(F.col(f"`{tokens}`")).alias("tokens")), targets)
    ratio = cells.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    most = ratio.agg(F.max("ratio")).first()[0] or 1.0
    scale = target_tokens if target_tokens is not None else 1.0 / most
    ratio = checkpointed(ratio.select(F.struct(*dims).alias("cell"), "weight", F.least(F.lit(1.0), F.col("ratio") * scale).alias("probability")))
    on = F.lit(True)
    for x in dims:
        on &= F.col(f"doc.`{x}`").eqNullSafe(F.col(f"cell.`{x}`"))
    joined = doc.join(F.broadcast(ratio) if ratio.count() <= _SMALL else ratio, on, "left")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"doc.`{id_col}`"), F.col(f"doc.`{text_col}`")), 11) / F.lit(float(1 << 53))
    kept = [F.col(f"doc.`{c}`").alias(f"doc_{c}" if c in RESULTS else c) for c in docs.columns]
    return joined.select(*kept, "weight", "probability", ((u < F.col("probability")) & (F.col("probability") > 0)).alias("selected"))


#: Production targets: sources by the square root of their tokens, languages as given, all lengths as they are but for long ones.
TARGETS: dict[str, dict[str, float] | float] = {"source": 0.5, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": 0.8}


def dimensions(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` as a struct ``row``, and what ``mix`` needs of documents (doc_id, text, source, lang)."""
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), "doc_id", "text", "source", "lang", n_tokens(F.col("text")).alias("tokens"))
    return d.withColumn("topic", topic(F.col("tokens")))
