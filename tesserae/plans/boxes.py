"""Boxes, pair joins and suppression. A line of an order stands for a box in an image; its status tells ground truth (F) from detections (O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import boxes as B
from tesserae.plans.registry import query, table

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"

#: The same surrogate for both engines: whole-number boxes, a score with four decimals.
DET = f"""
det AS (SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS BIGINT) AS n,
  l_partkey % 80 AS x, l_suppkey % 60 AS y, 5 + CAST(l_quantity AS BIGINT) % 40 AS w, 5 + (l_partkey * 7 + l_linenumber) % 30 AS h,
  round(1 - l_discount - l_tax / 10, 4) AS score, l_returnflag AS category, l_linestatus AS kind FROM lineitem)
"""

_INTER = "(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0))"
_UNION = f"(a.w * a.h + b.w * b.h - {_INTER})"
_IOU = f"({_INTER} / CAST({_UNION} AS DOUBLE))"


def det(spark, sf):
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        rn.cast("long").alias("n"),
        (F.col("l_partkey") % 80).alias("x"),
        (F.col("l_suppkey") % 60).alias("y"),
        (5 + F.col("l_quantity").cast("long") % 40).alias("w"),
        (5 + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 30).alias("h"),
        F.round(1 - F.col("l_discount") - F.col("l_tax") / 10, 4).alias("score"),
        F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("kind"),
    )


def _side(d, p):
    return d.select("image_id", *(F.col(c).alias(f"{p}{c}") for c in d.columns if c != "image_id"))


def pairs(spark, sf):
    """Pairs of boxes of one image, ground truth (g) and detection (d): an equi-join by image, never a global one."""
    d = det(spark, sf)
    return _side(d.where("kind = 'F'"), "g").join(_side(d.where("kind = 'O'"), "d"), "image_id")


_PAIRS = f"SELECT a.image_id, a.n AS gn, b.n AS dn, {{0}} FROM det a JOIN det b USING (image_id) WHERE a.kind = 'F' AND b.kind = 'O'"


@query("pairwise_iou", f"WITH {DET} " + _PAIRS.format(f"round({_IOU}, 6) AS iou, CAST({_UNION} AS BIGINT) AS area"))
def pairwise_iou(spark, sf):
    return pairs(spark, sf).select("image_id", "gn", "dn", F.round(B.iou("g", "d"), 6).alias("iou"), B.union("g", "d").alias("area"))


@query("pairwise_ioa", f"WITH {DET} " + _PAIRS.format(f"round({_INTER} / CAST(b.w * b.h AS DOUBLE), 6) AS ioa, round({_INTER} / CAST(least(a.w * a.h, b.w * b.h) AS DOUBLE), 6) AS iom"))
def pairwise_ioa(spark, sf):
    return pairs(spark, sf).select("image_id", "gn", "dn", F.round(B.ioa("g", "d"), 6).alias("ioa"), F.round(B.iom("g", "d"), 6).alias("iom"))


_HULL = "((greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x)) * (greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y)))"


@query("pairwise_giou", f"WITH {DET} " + _PAIRS.format(f"round({_IOU} - ({_HULL} - {_UNION}) / CAST({_HULL} AS DOUBLE), 6) AS giou"))
def pairwise_giou(spark, sf):
    return pairs(spark, sf).select("image_id", "gn", "dn", F.round(B.giou("g", "d"), 6).alias("giou"))


@query("point_box_distance", f"WITH {DET} " + _PAIRS.format("round(sqrt(power(greatest(a.x - (b.x + b.w / 2.0), (b.x + b.w / 2.0) - (a.x + a.w), 0), 2) + power(greatest(a.y - (b.y + b.h / 2.0), (b.y + b.h / 2.0) - (a.y + a.h), 0), 2)), 6) AS distance"))
def point_box_distance(spark, sf):
    """From the centre of each detection to each ground-truth box."""
    cx, cy = F.col("dx") + F.col("dw") / 2, F.col("dy") + F.col("dh") / 2
    out = lambda lo, n, v: F.greatest(lo - v, v - (lo + n), F.lit(0))
    d = F.sqrt(F.pow(out(F.col("gx"), F.col("gw"), cx), F.lit(2)) + F.pow(out(F.col("gy"), F.col("gh"), cy), F.lit(2)))
    return pairs(spark, sf).select("image_id", "gn", "dn", F.round(d, 6).alias("distance"))


@query("centre_similarity", f"WITH {DET} " + _PAIRS.format("round(greatest(0, 1 - sqrt(power((a.x + a.w / 2.0 - b.x - b.w / 2.0) / 100, 2) + power((a.y + a.h / 2.0 - b.y - b.h / 2.0) / 100, 2)) / 2), 6) AS similarity"))
def centre_similarity(spark, sf):
    dx = (F.col("gx") + F.col("gw") / 2 - F.col("dx") - F.col("dw") / 2) / 100
    dy = (F.col("gy") + F.col("gh") / 2 - F.col("dy") - F.col("dh") / 2) / 100
    return pairs(spark, sf).select("image_id", "gn", "dn", F.round(F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy) / 2), 6).alias("similarity"))


@query("overlapping_pairs_first_two", f"WITH {DET}, p AS (SELECT a.image_id, a.n AS i, b.n AS j, row_number() OVER (PARTITION BY a.image_id, a.n ORDER BY b.n) AS k FROM det a JOIN det b USING (image_id) WHERE a.n < b.n AND {_INTER} > 0) SELECT image_id, i, j FROM p WHERE k <= 2")
def overlapping_pairs_first_two(spark, sf):
    d = det(spark, sf)
    p = _side(d, "a").join(_side(d, "b"), "image_id").where("an < bn").where(B.overlap("a", "b") > 0)
    return p.withColumn("k", F.row_number().over(Window.partitionBy("image_id", "an").orderBy("bn"))).where("k <= 2").select("image_id", F.col("an").alias("i"), F.col("bn").alias("j"))


def _duck_nms(by, op, thr):
    m = {
        "iou": "(i / CAST(k.w * k.h + e.w * e.h - i AS DOUBLE))",
        "iom": "(i / CAST(least(k.w * k.h, e.w * e.h) AS DOUBLE))",
    }[by].replace("i /", "{I} /").replace("- i", "- {I}").replace("{I}", "(greatest(least(k.x + k.w, e.x + e.w) - greatest(k.x, e.x), 0) * greatest(least(k.y + k.h, e.y + e.h) - greatest(k.y, e.y), 0))")
    return f"""
WITH {DET}, lists AS (SELECT image_id, list({{'n': n, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY score DESC, n) AS items FROM det GROUP BY 1),
kept AS (SELECT image_id, list_reduce(list_transform(items, lambda e: [e]), lambda acc, cur: CASE WHEN len(list_filter(acc, lambda k: list_bool_or(list_transform(cur, lambda e: {m} {op} {thr})))) > 0 THEN acc ELSE list_concat(acc, cur) END) AS ks FROM lists)
SELECT image_id, k.n AS n FROM kept, unnest(ks) AS t(k)
"""


def _nms(spark, sf, thr, inclusive, by="iou"):
    item = F.struct((-F.col("score")).alias("s"), "n", "x", "y", "w", "h")
    grouped = det(spark, sf).groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select("image_id", F.explode(B.suppressed(F.col("items"), thr, inclusive, by)).alias("k")).select("image_id", F.col("k.n").alias("n"))


@query("nms_iou", _duck_nms("iou", ">", 0.3))
def nms_iou(spark, sf):
    return _nms(spark, sf, 0.3, False)


@query("nms_frame_inclusive", _duck_nms("iou", ">=", 0.25))
def nms_frame_inclusive(spark, sf):
    return _nms(spark, sf, 0.25, True)


@query("nms_iom", _duck_nms("iom", ">", 0.5))
def nms_iom(spark, sf):
    return _nms(spark, sf, 0.5, False, "iom")


# Filters and scalar geometry.
def _simple(name, where, condition):
    @query(name, f"WITH {DET} SELECT image_id, n, score FROM det WHERE {where}")
    def run(spark, sf):
        return det(spark, sf).where(condition()).select("image_id", "n", "score")


_simple("filter_confidence", "score >= 0.95", lambda: F.col("score") >= 0.95)
_simple("filter_detection_strict", "score > 0.95", lambda: F.col("score") > 0.95)
_simple(
    "filter_not_at_border",
    "(x + w / 2.0) / 120 > 0.025 AND (x + w / 2.0) / 120 < 0.975 AND (y + h / 2.0) / 100 > 0.025 AND (y + h / 2.0) / 100 < 0.975",
    lambda: B.strictly_inside((F.col("x") + F.col("w") / 2) / 120, 0.025) & B.strictly_inside((F.col("y") + F.col("h") / 2) / 100, 0.025),
)
_simple("filter_small_area", "w * h >= 100", lambda: F.col("w") * F.col("h") >= 100)


@query("images_without_tiny_boxes", f"WITH {DET} SELECT DISTINCT image_id FROM det WHERE image_id NOT IN (SELECT image_id FROM det WHERE w < 7 OR h < 7)")
def images_without_tiny_boxes(spark, sf):
    return det(spark, sf).groupBy("image_id").agg(F.bool_or((F.col("w") < 7) | (F.col("h") < 7)).alias("tiny")).where("NOT tiny").select("image_id")


@query("images_with_few_boxes", f"WITH {DET} SELECT image_id, count(*) AS boxes FROM det GROUP BY 1 HAVING count(*) <= 3")
def images_with_few_boxes(spark, sf):
    return det(spark, sf).groupBy("image_id").agg(F.count("*").alias("boxes")).where("boxes <= 3")


@query("positive_split", f"WITH {DET} SELECT image_id, n, category FROM det d WHERE kind = 'O' AND EXISTS (SELECT 1 FROM det g WHERE g.kind = 'F' AND g.image_id = d.image_id AND g.category = d.category)")
def positive_split(spark, sf):
    d = det(spark, sf)
    return d.where("kind = 'O'").join(d.where("kind = 'F'"), ["image_id", "category"], "left_semi").select("image_id", "n", "category")


@query("exhaustive_images", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def exhaustive_images(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").join(o.where("o_orderstatus = 'P'"), "o_custkey", "left_anti").select("o_orderkey")


@query("top_detections_per_image", f"WITH {DET}, r AS (SELECT image_id, n, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, n) AS k FROM det) SELECT image_id, n, score FROM r WHERE k <= 2")
def top_detections_per_image(spark, sf):
    return det(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "n"))).where("k <= 2").select("image_id", "n", "score")


@query("detection_count", f"WITH {DET} SELECT image_id, CAST(count(*) FILTER (WHERE score > 0.9) AS BIGINT) AS found FROM det GROUP BY 1")
def detection_count(spark, sf):
    return det(spark, sf).groupBy("image_id").agg(F.count_if(F.col("score") > 0.9).alias("found"))


@query("box_formats", f"WITH {DET} SELECT image_id, n, x AS x1, y AS y1, x + w AS x2, y + h AS y2, x + w / 2.0 AS cx, y + h / 2.0 AS cy, w * h AS area, least(x + w, 100) AS cx2, least(y + h, 80) AS cy2 FROM det")
def box_formats(spark, sf):
    d = det(spark, sf)
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return d.select("image_id", "n", F.col("x").alias("x1"), F.col("y").alias("y1"), x2.alias("x2"), y2.alias("y2"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), (F.col("w") * F.col("h")).alias("area"), F.least(x2, F.lit(100)).alias("cx2"), F.least(y2, F.lit(80)).alias("cy2"))


@query("normalised_boxes", f"WITH {DET} SELECT image_id, n, round(least(greatest(x / 100.0, 0), 1), 6) AS nx, round(least(greatest(y / 70.0, 0), 1), 6) AS ny, round(least(greatest(w / 40.0, 0), 1), 6) AS nw, round(least(greatest(h / 30.0, 0), 1), 6) AS nh FROM det")
def normalised_boxes(spark, sf):
    clamp = lambda v: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), 6)
    return det(spark, sf).select("image_id", "n", clamp(F.col("x") / 100).alias("nx"), clamp(F.col("y") / 70).alias("ny"), clamp(F.col("w") / 40).alias("nw"), clamp(F.col("h") / 30).alias("nh"))


@query(
    "enlarged_boxes",
    f"WITH {DET}, e AS (SELECT image_id, n, CAST(trunc(w / 0.8) AS BIGINT) AS nw, CAST(trunc(h / 0.8) AS BIGINT) AS nh, x, y, w, h FROM det) "
    "SELECT image_id, n, greatest(0, least(CAST(trunc(x + w / 2.0 - nw / 2.0) AS BIGINT), 120 - nw)) AS ex, greatest(0, least(CAST(trunc(y + h / 2.0 - nh / 2.0) AS BIGINT), 100 - nh)) AS ey, nw AS ew, nh AS eh FROM e",
)
def enlarged_boxes(spark, sf):
    e = B.enlarged(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 0.2, 120, 100)
    return det(spark, sf).select("image_id", "n", *(c.cast("long").alias(a) for c, a in zip(e, ("ex", "ey", "ew", "eh"))))


@query("polygon_area", f"WITH {DET} SELECT image_id, n, abs(x * (y + 3) - (x + w) * y + (x + w) * (y + h) - (x + 2) * (y + 3) + (x + 2) * y - x * (y + h)) / 2.0 AS area FROM det")
def polygon_area(spark, sf):
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    return det(spark, sf).select("image_id", "n", B.shoelace(F.array(x, y, x + w, y + 3, x + 2, y + h)).alias("area"))


@query("tight_box_of_points", f"WITH {DET} SELECT image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM det GROUP BY 1")
def tight_box_of_points(spark, sf):
    return det(spark, sf).groupBy("image_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


@query("translated_polygons", f"WITH {DET} SELECT image_id, n, x + 10 AS bx, y + 20 AS b_y, concat_ws(',', x + 10, y + 20, x + w + 10, y + 20, x + w + 10, y + h + 20) AS polygon FROM det")
def translated_polygons(spark, sf):
    p = F.array(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    moved = F.transform(p, lambda v, i: v + F.when(i % 2 == 0, 10).otherwise(20))
    return det(spark, sf).select("image_id", "n", (F.col("x") + 10).alias("bx"), (F.col("y") + 20).alias("b_y"), F.array_join(moved.cast("array<string>"), ",").alias("polygon"))


@query("resized_short_edge", "SELECT p_partkey, CASE WHEN least(w, h) <= 30 THEN w ELSE CAST(round_even(w * 30.0 / least(w, h), 0) AS BIGINT) END AS nw, CASE WHEN least(w, h) <= 30 THEN h ELSE CAST(round_even(h * 30.0 / least(w, h), 0) AS BIGINT) END AS nh FROM (SELECT p_partkey, CAST(p_size AS BIGINT) + 20 AS w, p_partkey % 50 + 10 AS h FROM part)")
def resized_short_edge(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", (F.col("p_size").cast("long") + 20).alias("w"), (F.col("p_partkey") % 50 + 10).alias("h"))
    s = F.least("w", "h")
    new = lambda c: F.when(s <= 30, F.col(c)).otherwise(F.bround(F.col(c) * 30.0 / s).cast("long"))
    return d.select("p_partkey", new("w").alias("nw"), new("h").alias("nh"))


@query("synthesis_scale", "SELECT p_partkey, round(sqrt(CAST(trunc(90000 * 0.15) AS BIGINT) / CAST(p_size AS DOUBLE)), 6) AS scale, round(least(300.0 / p_size, 300.0 / (p_partkey % 50 + 10)), 6) AS fit FROM part")
def synthesis_scale(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(F.sqrt(F.lit(int(90000 * 0.15)) / F.col("p_size").cast("double")), 6).alias("scale"), F.round(F.least(300.0 / F.col("p_size"), 300.0 / (F.col("p_partkey") % 50 + 10)), 6).alias("fit"))


@query("run_length_encoding", "WITH p AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS on_, lag(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) OVER w AS before, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id, on_, i, sum(CASE WHEN before IS NULL OR before <> on_ THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM p) SELECT user_id, CAST(run AS BIGINT) AS run, CAST(min(on_) AS BIGINT) AS value, min(i) AS start, count(*) AS length FROM r GROUP BY 1, 2")
def run_length_encoding(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf, "events").withColumn("on", F.col("event_type").isin("click", "view").cast("long")).withColumn("new", F.coalesce((F.lag("on").over(w) != F.col("on")).cast("int"), F.lit(1))).withColumn("i", F.row_number().over(w).cast("long"))
    r = p.withColumn("run", F.sum("new").over(Window.partitionBy("user_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("user_id", "run").agg(F.min("on").alias("value"), F.min("i").alias("start"), F.count("*").alias("length"))
