"""Filters of queries and objects, ids over videos, limits by score, class averages, boundaries of masks, runs decoded."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators import masks as M
from tesserae.operators import tracking as T
from tesserae.operators.numbering import numbered_rows
from tesserae.plans.boxes import DET, det
from tesserae.plans.registry import query, table

# A turn stands for a query: some are geometric (have a box), some of these are named so, and some have no outputs.
_FIND = "q AS (SELECT conv_id, turn, turn % 2 = 0 AS has_box, CASE WHEN turn % 3 = 0 THEN 'geometric' ELSE role END AS query_text, length(coalesce(text, '')) % 3 AS outputs FROM conversations)"


def _find(spark, sf):
    text = F.when(F.col("turn") % 3 == 0, "geometric").otherwise(F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") % 2 == 0).alias("has_box"), text.alias("query_text"), (F.length(F.coalesce("text", F.lit(""))) % 3).alias("outputs"))


@query("semantic_queries", f"WITH {_FIND} SELECT conv_id, turn FROM q WHERE NOT has_box")
def semantic_queries(spark, sf):
    """Without the geometric ones."""
    return _find(spark, sf).where("NOT has_box").select("conv_id", "turn")


@query("valid_geometric_queries", f"WITH {_FIND} SELECT conv_id, turn FROM q WHERE NOT (has_box AND query_text = 'geometric' AND outputs = 0)")
def valid_geometric_queries(spark, sf):
    """Without geometric ones whose objects are all gone."""
    return _find(spark, sf).where("NOT (has_box AND query_text = 'geometric' AND outputs = 0)").select("conv_id", "turn")


@query("objects_without_crowds", f"WITH {DET} SELECT image_id, category, count(*) FILTER (WHERE n % 4 <> 0) AS objects FROM det GROUP BY 1, 2")
def objects_without_crowds(spark, sf):
    """Objects of each query that are left without crowds; a query stays, if with none."""
    return det(spark, sf).groupBy("image_id", "category").agg(F.count_if(F.col("n") % 4 != 0).alias("objects"))


@query(
    "unique_track_ids",
    f"""WITH {DET}, a AS (SELECT image_id, n, image_id % 7 AS video, x + 100 * (image_id % 3) AS track FROM det), s AS (SELECT track FROM a GROUP BY 1 HAVING count(DISTINCT video) > 1),
p AS (SELECT track, video, min(struct_pack(i := image_id, n := n)) AS first FROM a WHERE track IN (SELECT track FROM s) GROUP BY 1, 2), r AS (SELECT track, video, row_number() OVER (ORDER BY first) + (SELECT max(track) FROM a) AS fresh FROM p)
SELECT image_id, n, coalesce(fresh, a.track) AS track FROM a LEFT JOIN r ON r.track = a.track AND r.video = a.video""",
)
def unique_track_ids(spark, sf):
    """Tracks of an id that several videos use get new ids beyond the largest, in the order in which they are first seen."""
    d = det(spark, sf).select("image_id", "n", (F.col("image_id") % 7).alias("video"), (F.col("x") + 100 * (F.col("image_id") % 3)).alias("track"))
    return T.unique_track_ids(d, "track", "video", ["image_id", "n"]).select("image_id", "n", "track")


@query("object_cap", f"WITH {DET}, r AS (SELECT image_id, n, kind, count(*) FILTER (WHERE kind = 'F') OVER (PARTITION BY image_id) AS tracks, row_number() OVER (PARTITION BY image_id, kind ORDER BY score DESC, n DESC) AS k FROM det) SELECT image_id, n FROM r WHERE kind = 'O' AND k <= 4 - tracks")
def object_cap(spark, sf):
    """New detections of the highest scores, as many as the tracks of an image leave free of four."""
    w = Window.partitionBy("image_id")
    d = det(spark, sf).withColumn("tracks", F.count_if(F.col("kind") == "F").over(w)).where("kind = 'O'")
    return d.withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), F.desc("n")))).where("k <= 4 - tracks").select("image_id", "n")


@query("tracks_by_confidence", f"WITH {DET} SELECT image_id, string_agg(n, ',' ORDER BY score DESC, n) AS tracks FROM det GROUP BY 1")
def tracks_by_confidence(spark, sf):
    """A stable order: equal scores stay as they came."""
    d = det(spark, sf).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "n"))).alias("l"))
    return d.select("image_id", F.array_join(F.transform("l", lambda e: e["n"].cast("string")), ",").alias("tracks"))


_CLASSES = "c AS (SELECT p_brand AS class, a / 20.0 AS alpha, CAST(sum(CASE WHEN p_brand = 'Brand#11' THEN 0 WHEN p_size % 20 >= a THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p_brand = 'Brand#11' THEN 0 WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN p_brand = 'Brand#11' THEN 0 WHEN p_size % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp FROM part, (VALUES (5), (10), (15)) AS v(a) GROUP BY 1, 2), f AS (SELECT *, tp / greatest(tp + fn + fp, 1) AS DetA, (tp + 1) / (tp + 3.0) AS AssA, 1 - 1 / (tp + 2.0) AS LocA FROM c), h AS (SELECT *, sqrt(DetA * AssA) AS HOTA FROM f)"


def _classes(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("class"), "p_size", F.explode(F.array(F.lit(5), F.lit(10), F.lit(15))).alias("a"))
    some = lambda c: F.sum(F.when((F.col("class") != "Brand#11") & c, 1).otherwise(0))
    c = p.groupBy("class", (F.col("a") / 20).alias("alpha"), "a").agg(some(F.col("p_size") % 20 >= F.col("a")).alias("tp"), some(F.col("p_size") % 3 == 0).alias("fn"), some(F.col("p_size") % 4 == 0).alias("fp")).drop("a")
    tp = F.col("tp")
    f = c.withColumns({"DetA": tp / F.greatest(tp + F.col("fn") + F.col("fp"), F.lit(1)), "AssA": (tp + 1) / (tp + 3.0), "LocA": 1 - 1 / (tp + 2.0)})
    return f.withColumn("HOTA", F.sqrt(F.col("DetA") * F.col("AssA")))


def _rounded(d):
    return d.select(F.round("alpha", 2).alias("alpha"), "tp", "fn", "fp", *(F.round(c, 6).alias(c) for c in ("DetA", "AssA", "LocA", "HOTA")))


_ROUND = "round(alpha, 2) AS alpha, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp"
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("DetA", "AssA", "LocA", "HOTA"))


@query("hota_class_average", f"WITH {_CLASSES} SELECT {_ROUND}, {_MEANS} FROM h GROUP BY 1")
def hota_class_average(spark, sf):
    return _rounded(T.over_classes(_classes(spark, sf), "classes"))


@query("hota_class_average_of_seen", f"WITH {_CLASSES}, s AS (SELECT class FROM h GROUP BY 1 HAVING max(tp + fn + fp) > 0) SELECT {_ROUND}, {_MEANS} FROM h SEMI JOIN s USING (class) GROUP BY 1")
def hota_class_average_of_seen(spark, sf):
    """Classes without any ground truth or detection don't count."""
    return _rounded(T.over_classes(_classes(spark, sf), "classes", ignore_empty=True))


@query("hota_detection_average", f"WITH {_CLASSES}, s AS (SELECT alpha, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(AssA * tp) AS ass, sum(LocA * tp) AS loc FROM h GROUP BY 1), d AS (SELECT *, tp / greatest(tp + fn + fp, 1) AS DetA, CASE WHEN tp > 0 THEN ass / tp ELSE 0 END AS AssA, CASE WHEN tp > 0 THEN loc / tp ELSE 1 END AS LocA FROM s) SELECT {_ROUND}, {_MEANS.replace('avg(HOTA)', 'avg(sqrt(DetA * AssA))')} FROM d GROUP BY 1")
def hota_detection_average(spark, sf):
    return _rounded(T.over_classes(_classes(spark, sf), "detections"))


@query("image_category_chunks_all", "SELECT n_nationkey, t.p_type, count(p_partkey) AS n FROM nation CROSS JOIN (SELECT DISTINCT p_type FROM part) t LEFT JOIN part p ON p.p_type = t.p_type AND p_partkey % 25 = n_nationkey AND p_size > 45 GROUP BY 1, 2")
def image_category_chunks_all(spark, sf):
    """Every image with every category, those that it lacks as negatives with no annotation: two small dimensions."""
    p = table(spark, sf, "part")
    have = p.where("p_size > 45").groupBy((F.col("p_partkey") % 25).alias("n_nationkey"), "p_type").agg(F.count("*").alias("n"))
    every = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey")).crossJoin(p.select("p_type").distinct())
    return every.join(have, ["n_nationkey", "p_type"], "left").na.fill(0, ["n"]).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "p_type", "n")


# The orders of fifty in sequence make an image of 16 by 16 pixels; a line's status tells ground truth from detection.
_MASK = "px AS (SELECT DISTINCT l_orderkey // 50 AS image, l_linestatus AS kind, l_partkey % 16 AS x, l_suppkey % 16 AS y FROM lineitem WHERE l_quantity < 20)"
_BOUNDARY = f"""
{_MASK}, sh AS (SELECT image, kind, x - dx AS x, y - dy AS y, part FROM px, (VALUES (0, 0, 0), (1, 0, 1), (0, 1, 2), (1, 1, 3)) AS v(dx, dy, part) WHERE x >= dx AND y >= dy),
fl AS (SELECT image, kind, x, y, bool_or(part = 0) AS s, bool_or(part = 1) AS e, bool_or(part = 2) AS d, bool_or(part = 3) AS c FROM sh GROUP BY 1, 2, 3, 4),
bd AS (SELECT image, kind, x, y FROM fl WHERE CASE WHEN x = 15 AND y = 15 THEN false WHEN y = 15 THEN s <> e WHEN x = 15 THEN s <> d ELSE s <> e OR s <> d OR s <> c END),
dil AS (SELECT DISTINCT image, kind, x + dx AS x, y + dy AS y FROM bd, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE x + dx BETWEEN 0 AND 15 AND y + dy BETWEEN 0 AND 15),
ct AS (SELECT image, count(*) FILTER (WHERE kind = 'F') AS n_gt, count(*) FILTER (WHERE kind = 'O') AS n_dt FROM bd GROUP BY 1),
mt AS (SELECT b.image, count(*) FILTER (WHERE b.kind = 'F') AS gt, count(*) FILTER (WHERE b.kind = 'O') AS dt FROM bd b JOIN dil d ON b.image = d.image AND b.x = d.x AND b.y = d.y AND b.kind <> d.kind GROUP BY 1),
im AS (SELECT DISTINCT image FROM px),
al AS (SELECT im.image, coalesce(n_gt, 0) AS n_gt, coalesce(n_dt, 0) AS n_dt, coalesce(gt, 0) AS gt, coalesce(dt, 0) AS dt FROM im LEFT JOIN ct USING (image) LEFT JOIN mt USING (image)),
pr AS (SELECT *, CASE WHEN n_dt = 0 THEN 1.0 WHEN n_gt = 0 THEN 0 ELSE dt / CAST(n_dt AS DOUBLE) END AS p, CASE WHEN n_gt = 0 THEN 1.0 WHEN n_dt = 0 THEN 0 ELSE gt / CAST(n_gt AS DOUBLE) END AS r FROM al)
"""


@query("boundary_f_measure", f"WITH {_BOUNDARY} SELECT image, n_gt, n_dt, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f FROM pr")
def boundary_f_measure(spark, sf):
    """Of the boundaries of two masks of an image, within a pixel."""
    l = table(spark, sf, "lineitem").where("l_quantity < 20")  # noqa: E741
    px = l.select(F.floor(F.col("l_orderkey") / 50).alias("image"), F.col("l_linestatus").alias("kind"), (F.col("l_partkey") % 16).alias("x"), (F.col("l_suppkey") % 16).alias("y")).distinct()
    return M.boundary_f(px, "F", "O", 16, 16, 3).select("image", "n_gt", "n_dt", F.round("f", 6).alias("f"))


@query("run_length_decoding", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS value FROM events")
def run_length_decoding(spark, sf):
    """The runs of ``run_length_encoding``, spread out again."""
    from tesserae.plans.boxes import run_length_encoding

    r = run_length_encoding(spark, sf)
    return r.select("user_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("i"), F.col("value").cast("int").alias("value"))


# Overlaps of a box with its partner of the same number, as losses take them.
@query("diagonal_overlaps", f"WITH {DET}, i AS (SELECT a.image_id, a.n, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s, (greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x)) * (greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y)) AS hull FROM det a JOIN det b ON a.image_id = b.image_id AND b.n = a.n + 1) SELECT image_id, n, round(i / CAST(s - i AS DOUBLE), 6) AS iou, round(i / CAST(s - i AS DOUBLE) - (hull - (s - i)) / CAST(hull AS DOUBLE), 6) AS giou FROM i")
def diagonal_overlaps(spark, sf):
    """Of each box and the one after it: an equi-join, not all pairs."""
    from tesserae.functions import boxes as B

    d = det(spark, sf)
    side = lambda p, n: d.select("image_id", n.alias("n"), *(F.col(c).alias(f"{p}{c}") for c in "xywh"))
    j = side("a", F.col("n")).join(side("b", F.col("n") - 1), ["image_id", "n"])
    return j.select("image_id", "n", F.round(B.iou("a", "b"), 6).alias("iou"), F.round(B.giou("a", "b"), 6).alias("giou"))
