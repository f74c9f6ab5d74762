"""Exact and near duplicates of images, by content hash and by 64-bit perceptual hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.lineage import settled


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row in order of each key: a ranked filter, which Spark limits per group before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def hamming_pairs(df: DataFrame, id_col: str, hash_col: str, most: int, bits: int = 64) -> DataFrame:
    """Pairs a < b whose hashes differ in ``most`` bits at most: (a, b, distance). The output is all pairs, copies included; see ``hamming_links`` for links alone."""
    d = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    links = hamming_links(df, hash_col, most, bits)
    apart = links.join(d.select(F.col("id").alias("x"), F.col("h").alias("ha")), "ha").join(d.select(F.col("id").alias("y"), F.col("h").alias("hb")), "hb")
    near = apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").where("a < b")
    x, y = (d.select(F.col("h"), F.col("id").alias(c)) for c in "ab")
    copies = x.join(y, "h").where("a < b").select("a", "b", F.lit(0).cast("long").alias("distance"))
    return near.unionByName(copies)


def hamming_links(df: DataFrame, hash_col: str, most: int, bits: int = 64) -> DataFrame:
    """Pairs of different hashes, ha < hb, that differ in ``most`` bits at most: (ha, hb, distance). Copies of a hash don't meet.

    The ``bits`` that hashes use are cut into most + 1 bands; a pair agrees in one of them, so an equi-join by band finds all of it. A pair is
    taken in the first band in which it agrees, so nothing has to be made unique afterwards.
    """
    n = most + 1
    edges = [bits * k // n for k in range(n + 1)]
    d = df.select(F.col(hash_col).alias("h")).distinct()
    band = lambda h, k: F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    banded = d.select("h", F.posexplode(F.array(*(band(F.col("h"), k) for k in range(n)))).alias("k", "v"))
    a, b = (banded.select("k", "v", F.col("h").alias(x)) for x in ("ha", "hb"))
    apart = F.col("ha").bitwiseXOR(F.col("hb"))
    earlier = F.lit(False)
    for k in range(n):
        earlier |= (F.col("k") > k) & (band(apart, k) == 0)
    pairs = a.join(b, ["k", "v"]).where("ha < hb").where(F.bit_count(apart) <= most)
    return pairs.where(~earlier).select("ha", "hb", F.bit_count(apart).cast("long").alias("distance"))


def greedy_kept(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Near duplicates dropped greedily in id order: an id goes only if one that was kept before it is near. Returns the rows of ``ids`` (id) that stay.

    ``pairs`` (a, b), a < b. In each round the ids that no other may drop are kept, and what they are near goes, with all its pairs; rounds are as many as
    the longest chain of decisions. No group is gathered: a group of any size is rows of joins. Each round's pairs are checkpointed.
    """
    edges, gone = settled(pairs.select("a", "b")), []
    while not edges.isEmpty():
        free = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = settled(edges.join(free, "a").select("b").distinct())
        gone.append(out)
        edges = settled(edges.join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"))
    for out in gone:
        ids = ids.join(out.select(F.col("b").alias("id")), "id", "left_anti")
    return ids


def near_kept(df: DataFrame, id_col: str, hash_col: str, most: int, bits: int = 64) -> DataFrame:
    """Of rows (id, hash) those that stay when each that differs in ``most`` bits at most from an earlier one that stays is dropped: (id).

    Of equal hashes only the first id can stay, so copies never form pairs.
    """
    first = df.groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"))
    side = lambda x: first.select(F.col("h").alias(f"h{x}"), F.col("id").alias(f"i{x}"))
    links = hamming_links(first, "h", most, bits).join(side("a"), "ha").join(side("b"), "hb")
    return greedy_kept(links.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")), first.select("id"))


def bit_votes(text_words: DataFrame, id_col: str, word_col: str, bits: int = 60) -> DataFrame:
    """A hash of each id of which bit k is 1 if more of its words' md5 hashes have it than not: (id, hash). An id whose word is null has hash 0. One aggregate of ``bits`` sums."""
    hashed = text_words.select(id_col, F.conv(F.substring(F.md5(F.col(word_col).cast("binary")), 1, bits // 4), 16, 10).cast("long").alias("h"))
    votes = [F.sum(F.shiftright("h", k).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"v{k}") for k in range(bits)]
    total = F.lit(0).cast("long")
    for k in range(bits):
        total = total + F.when(F.col(f"v{k}") > 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return hashed.groupBy(id_col).agg(*votes).select(id_col, total.alias("hash"))
