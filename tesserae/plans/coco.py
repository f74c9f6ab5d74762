"""COCO, YOLO and VOC records, id remapping, evaluation of detections, frames and tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import boxes as B
from tesserae.operators import assignment as A
from tesserae.operators.numbering import numbered_rows
from tesserae.plans.boxes import DET, _IOU, det, pairs
from tesserae.plans.matching import best_matching
from tesserae.plans.registry import query, table


@query("coco_annotations", f"WITH {DET} SELECT image_id, count(*) AS n, string_agg(concat('[', x, ',', y, ',', w, ',', h, ']'), ';' ORDER BY n) AS boxes FROM det GROUP BY 1")
def coco_annotations(spark, sf):
    box = F.concat(F.lit("["), F.concat_ws(",", *(F.col(c).cast("string") for c in "xywh")), F.lit("]"))
    d = det(spark, sf).groupBy("image_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("n", box.alias("b")))).alias("x"))
    return d.select("image_id", "n", F.array_join(F.transform("x", lambda e: e["b"]), ";").alias("boxes"))


@query("images_with_annotations", f"WITH {DET}, a AS (SELECT image_id, count(*) AS n, sum(w * h) AS area FROM det WHERE category = 'R' GROUP BY 1) SELECT o_orderkey, coalesce(n, 0) AS n, CAST(coalesce(area, 0) AS BIGINT) AS area FROM orders LEFT JOIN a ON image_id = o_orderkey")
def images_with_annotations(spark, sf):
    a = det(spark, sf).where("category = 'R'").groupBy(F.col("image_id").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).alias("area"))
    return table(spark, sf, "orders").select("o_orderkey").join(a, "o_orderkey", "left").na.fill(0, ["n", "area"])


@query("yolo_lines", f"WITH {DET} SELECT image_id, n, printf('0 %.6f %.6f %.6f %.6f', (x + w / 2.0) / 120, (y + h / 2.0) / 100, w / 120.0, h / 100.0) AS line FROM det")
def yolo_lines(spark, sf):
    x, y, w, h = (F.col(c) for c in "xywh")
    return det(spark, sf).select("image_id", "n", F.format_string("0 %.6f %.6f %.6f %.6f", (x + w / 2) / 120, (y + h / 2) / 100, w / 120, h / 100).alias("line"))


@query("voc_objects", f"WITH {DET} SELECT image_id, n, concat('<object><name>insect</name><bndbox><xmin>', x, '</xmin><ymin>', y, '</ymin><xmax>', x + w, '</xmax><ymax>', y + h, '</ymax></bndbox></object>') AS xml FROM det")
def voc_objects(spark, sf):
    shape = "<object><name>insect</name><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>"
    return det(spark, sf).select("image_id", "n", F.format_string(shape, "x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("xml"))


@query("prediction_dump", f"WITH {DET} SELECT image_id, n, round(x / 7.0, 5) AS rx, round(score / 3.0, 5) AS rs FROM det")
def prediction_dump(spark, sf):
    return det(spark, sf).select("image_id", "n", F.round(F.col("x") / 7, 5).alias("rx"), F.round(F.col("score") / 3, 5).alias("rs"))


@query("distinct_class_names", "SELECT string_agg(p_type, ',' ORDER BY first) AS names FROM (SELECT p_type, min(p_partkey) AS first FROM part GROUP BY 1)")
def distinct_class_names(spark, sf):
    c = table(spark, sf, "part").groupBy("p_type").agg(F.min("p_partkey").alias("first"))
    return c.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "p_type"))), lambda x: x["p_type"]), ",").alias("names"))


@query("reindexed_ids", "WITH z AS (SELECT (SELECT count(*) FROM nation WHERE n_nationkey = 0) AS n0, (SELECT count(*) FROM region WHERE r_regionkey = 0) AS r0) SELECT n_nationkey + CASE WHEN n0 > 0 THEN 1 ELSE 0 END AS nation_id, n_regionkey + CASE WHEN r0 > 0 THEN 1 ELSE 0 END AS region_id, n_name FROM nation, z")
def reindexed_ids(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    zero = lambda d, c: d.agg(F.coalesce(F.max((F.col(c) == 0).cast("int")), F.lit(0)).alias(f"z_{c}"))  # noqa: E731  one row
    d = n.crossJoin(zero(n, "n_nationkey")).crossJoin(zero(r, "r_regionkey"))
    return d.select((F.col("n_nationkey") + F.col("z_n_nationkey")).alias("nation_id"), (F.col("n_regionkey") + F.col("z_r_regionkey")).alias("region_id"), "n_name")


@query("dense_pair_ids", "WITH p AS (SELECT DISTINCT user_id, event_type, event_type = 'error' AS negative FROM events) SELECT user_id, event_type, row_number() OVER (ORDER BY negative, user_id, event_type) AS new_id FROM p")
def dense_pair_ids(spark, sf):
    p = table(spark, sf, "events").select("user_id", "event_type", (F.col("event_type") == "error").alias("negative")).distinct()
    return numbered_rows(p, ["negative", "user_id", "event_type"], "new_id").drop("negative")


@query("first_seen_track_ids", "WITH p AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, event_type, dense_rank() OVER (ORDER BY first) AS track FROM p")
def first_seen_track_ids(spark, sf):
    p = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return numbered_rows(p, ["first"], "track").drop("first")  # an event has one user and type, so no two are equal


@query("contiguous_labels", "SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS label FROM events")
def contiguous_labels(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", (F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")) - 1).cast("long").alias("label"))


@query("ids_in_several_videos", "SELECT l_partkey, count(DISTINCT l_orderkey) AS videos FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def ids_in_several_videos(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("videos")).where("videos > 1")


@query("merged_categories", "SELECT p_partkey, coalesce(new, p_type) AS category FROM part LEFT JOIN (VALUES ('PROMO', 'SALE'), ('ECONOMY', 'STANDARD')) AS m(old, new) ON old = p_type")
def merged_categories(spark, sf):
    merge = F.create_map(*(F.lit(x) for x in ("PROMO", "SALE", "ECONOMY", "STANDARD")))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(merge[F.col("p_type")], "p_type").alias("category"))


@query("filled_from_parent", "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN o_custkey ELSE l_suppkey END AS owner FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def filled_from_parent(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")).alias("own"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return li.join(o, "l_orderkey", "left").select("l_orderkey", "l_partkey", "l_suppkey", F.coalesce("own", "o_custkey").alias("owner"))


@query("image_category_chunks", "SELECT n_nationkey, p_type, count(p_partkey) AS n FROM nation CROSS JOIN (SELECT DISTINCT p_type FROM part) t LEFT JOIN part p USING (p_type) WHERE p_partkey IS NULL OR p_partkey % 25 = n_nationkey GROUP BY 1, 2")
def image_category_chunks(spark, sf):
    """Every image with every category, with the annotations that it has: two small dimensions."""
    p = table(spark, sf, "part")
    have = p.groupBy((F.col("p_partkey") % 25).alias("n_nationkey"), "p_type").agg(F.count("*").alias("n"))
    every = table(spark, sf, "nation").select("n_nationkey").crossJoin(p.select("p_type").distinct())
    return every.join(have, ["n_nationkey", "p_type"], "left").where("n > 0").select("n_nationkey", "p_type", "n")


@query("pruned_messages", "WITH m AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS last FROM conversations GROUP BY 1) SELECT conv_id, turn, role FROM conversations LEFT JOIN m USING (conv_id) WHERE turn < 2 OR turn >= last")
def pruned_messages(spark, sf):
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", last.alias("last")).where("turn < 2 OR turn >= last").drop("last")


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("set_operations", "SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS gt_only, count(*) FILTER (WHERE b AND NOT a) AS dt_only FROM (SELECT l_orderkey, l_returnflag, bool_or(l_linestatus = 'F') AS a, bool_or(l_linestatus = 'O') AS b FROM lineitem GROUP BY 1, 2)")
def set_operations(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.bool_or(F.col("l_linestatus") == "F").alias("a"), F.bool_or(F.col("l_linestatus") == "O").alias("b"))
    return d.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("gt_only"), F.count_if(F.col("b") & ~F.col("a")).alias("dt_only"))


# Frames and tracks: a user's events in time order are a video's frames.
_FR = "fr AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events)"


def _frames(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("f"))


@query("frame_plan", "WITH v AS (SELECT s_suppkey, 24 + s_suppkey % 7 AS fps, 100 + s_suppkey AS total FROM supplier), p AS (SELECT *, CAST(1.0 * fps AS BIGINT) AS a, least(CAST(3.0 * fps AS BIGINT), total) AS b, greatest(1, CAST(trunc(500 * fps / 1000.0) AS BIGINT)) AS step FROM v) SELECT s_suppkey, k AS frame FROM p, unnest(generate_series(a, b - 1, step)) AS t(k) WHERE k < a + 3 * step")
def frame_plan(spark, sf):
    """Frame numbers from second 1 to 3, every 500 ms, three at most."""
    v = table(spark, sf, "supplier").select("s_suppkey", (24 + F.col("s_suppkey") % 7).alias("fps"), (100 + F.col("s_suppkey")).alias("total"))
    p = v.select("s_suppkey", (1.0 * F.col("fps")).cast("long").alias("a"), F.least((3.0 * F.col("fps")).cast("long"), F.col("total")).alias("b"), F.greatest(F.lit(1), (500 * F.col("fps") / 1000).cast("long")).alias("step"))
    return p.where("a < b").select("s_suppkey", F.explode(F.slice(F.sequence(F.col("a"), F.col("b") - 1, F.col("step")), 1, 3)).alias("frame"))


@query("video_duration", "SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 0 ELSE (100 + s_suppkey) * 1000.0 / (s_nationkey % 5 * 6) END AS ms FROM supplier")
def video_duration(spark, sf):
    fps = F.col("s_nationkey") % 5 * 6
    return table(spark, sf, "supplier").select("s_suppkey", F.when(fps > 0, (100 + F.col("s_suppkey")) * 1000.0 / fps).otherwise(0.0).alias("ms"))


@query("strided_frames", f"WITH {_FR}, t AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM fr) SELECT user_id, event_id FROM t WHERE (f - 1) % greatest(1, least(10, CAST(floor((n - 1) / 7.0) AS BIGINT))) = 0 AND (f - 1) / greatest(1, least(10, CAST(floor((n - 1) / 7.0) AS BIGINT))) < 8")
def strided_frames(spark, sf):
    """Eight frames, ten apart or as near as the video's length allows."""
    d = _frames(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    stride = F.greatest(F.lit(1), F.least(F.lit(10), F.floor((F.col("n") - 1) / 7)))
    return d.where(((F.col("f") - 1) % stride == 0) & ((F.col("f") - 1) / stride < 8)).select("user_id", "event_id")


@query("confirmed_tracks", f"WITH {_FR}, m AS (SELECT *, event_type <> 'error' AS hit, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY f) AS island FROM fr), r AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY f) AS run FROM m) SELECT user_id, event_id, max(CASE WHEN run >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY f) = 1 AS confirmed FROM r")
def confirmed_tracks(spark, sf):
    """A track is confirmed by three matches in a row, for good."""
    w = Window.partitionBy("user_id").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    miss = (F.col("event_type") == "error").cast("int")
    r = _frames(spark, sf).withColumn("miss", miss).withColumn("island", F.sum("miss").over(w))
    r = r.withColumn("run", F.sum(1 - F.col("miss")).over(Window.partitionBy("user_id", "island").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)))
    return r.select("user_id", "event_id", (F.max((F.col("run") >= 3).cast("int")).over(w) == 1).alias("confirmed"))


@query("keep_alive_counter", f"WITH {_FR}, l AS (SELECT user_id, list(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END ORDER BY f) AS steps FROM fr GROUP BY 1) SELECT user_id, list_reduce(steps, lambda a, s: greatest(-4, least(8, a + s)), 0) AS counter FROM l")
def keep_alive_counter(spark, sf):
    """A counter of matches and misses that stays within -4 and 8: an ordered fold."""
    step = F.struct("f", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("s"))
    d = _frames(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_list(step)).alias("x"))
    return d.select("user_id", F.aggregate("x", F.lit(0), lambda a, e: F.greatest(F.lit(-4), F.least(F.lit(8), a + e["s"]))).alias("counter"))


@query("look_ahead_status", f"WITH {_FR} SELECT user_id, event_id, coalesce(lead(event_type, 2) OVER w, last_value(event_type) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS later FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY f)")
def look_ahead_status(spark, sf):
    w = Window.partitionBy("user_id").orderBy("f")
    last = F.last("event_type").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return _frames(spark, sf).select("user_id", "event_id", F.coalesce(F.lead("event_type", 2).over(w), last).alias("later"))


@query("nearest_conditioning_frames", f"WITH {_FR}, c AS (SELECT user_id, f FROM fr WHERE event_type = 'purchase') SELECT fr.user_id, fr.event_id, max(c.f) FILTER (WHERE c.f < fr.f) AS before, min(c.f) FILTER (WHERE c.f >= fr.f) AS after FROM fr LEFT JOIN c USING (user_id) GROUP BY 1, 2")
def nearest_conditioning_frames(spark, sf):
    """The as-of frames on both sides, by two running windows instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("f")
    mark = F.when(F.col("event_type") == "purchase", F.col("f"))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return _frames(spark, sf).select("user_id", "event_id", before.alias("before"), after.alias("after"))


_LOADS = "[user_id % 5, 2, user_id % 3, 1]"


@query(
    "least_loaded_worker",
    f"WITH {_FR}, l AS (SELECT user_id, list(event_id ORDER BY f) AS es, {_LOADS} AS start FROM fr GROUP BY 1), g AS (SELECT user_id, list_reduce(list_transform(es, lambda e: {{'loads': CAST([] AS BIGINT[]), 'event': e, 'out': CAST([] AS STRUCT(event BIGINT, worker BIGINT)[])}}), "
    "lambda a, x: {'loads': list_transform(a.loads, lambda v, i: CASE WHEN i = list_position(a.loads, list_min(a.loads)) THEN v + 1 ELSE v END), 'event': x.event, 'out': list_append(a.out, {'event': x.event, 'worker': CAST(list_position(a.loads, list_min(a.loads)) - 1 AS BIGINT)})}, "
    "{'loads': CAST(start AS BIGINT[]), 'event': CAST(0 AS BIGINT), 'out': CAST([] AS STRUCT(event BIGINT, worker BIGINT)[])}) AS r FROM l) SELECT user_id, o.event AS event_id, o.worker AS worker FROM (SELECT user_id, unnest(r.out) AS o FROM g)",
)
def least_loaded_worker(spark, sf):
    """A user's events in order go each to the least loaded worker of four, the first of equal ones, from loads that they have already: an ordered fold."""
    d = _frames(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("f", "event_id"))).alias("x"))
    loads = F.array(F.col("user_id") % 5, F.lit(2).cast("long"), F.col("user_id") % 3, F.lit(1).cast("long"))
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<event_id:bigint,worker:bigint>>").alias("out"))

    def give(acc, e):
        least = F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1
        return F.struct(F.transform(acc["loads"], lambda v, i: F.when(i == least, v + 1).otherwise(v)).alias("loads"), F.concat(acc["out"], F.array(F.struct(e["event_id"].alias("event_id"), least.cast("long").alias("worker")))).alias("out"))

    return d.select("user_id", F.explode(F.aggregate("x", start, give)["out"]).alias("o")).select("user_id", "o.event_id", "o.worker")


@query("delayed_output", f"WITH {_FR}, n AS (SELECT *, max(f) OVER (PARTITION BY user_id) AS last FROM fr) SELECT user_id, event_id, least(f + 3, last) AS emitted_at FROM n")
def delayed_output(spark, sf):
    """The frame at which a buffer of three frames gives each one out; the end flushes it."""
    return _frames(spark, sf).select("user_id", "event_id", F.least(F.col("f") + 3, F.max("f").over(Window.partitionBy("user_id"))).alias("emitted_at"))


# Tracklets: an image's boxes of a category by line are a track's boxes by frame.
_TRK = f"{DET}, g AS (SELECT category, image_id AS fr, n, w * h AS a, x, y, w, h FROM det WHERE kind = 'F'), p AS (SELECT category, image_id AS fr, n, w * h AS a, x, y, w, h FROM det WHERE kind = 'O')"


@query(
    "masklet_iou",
    f"WITH {_TRK}, gs AS (SELECT category, n, sum(a) AS a FROM g GROUP BY 1, 2), ps AS (SELECT category, n, sum(a) AS a FROM p GROUP BY 1, 2), o AS (SELECT g.category, g.n AS gn, p.n AS pn, sum(greatest(least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x), 0) * greatest(least(g.y + g.h, p.y + p.h) - greatest(g.y, p.y), 0)) AS i FROM g JOIN p ON g.category = p.category AND g.fr = p.fr GROUP BY 1, 2, 3) SELECT gs.category, gs.n AS gn, ps.n AS pn, CASE WHEN gs.a + ps.a - coalesce(i, 0) > 0 THEN round(coalesce(i, 0) / CAST(gs.a + ps.a - coalesce(i, 0) AS DOUBLE), 6) ELSE 1 END AS iou FROM gs JOIN ps ON gs.category = ps.category LEFT JOIN o ON o.category = gs.category AND o.gn = gs.n AND o.pn = ps.n",
)
def masklet_iou(spark, sf):
    """All pairs of a ground-truth and a predicted track of a category; without an area on either side the overlap is 1. Frames of one side count by the tracks' areas, so overlaps need only the frames that both have."""
    d = det(spark, sf)
    side = lambda k, p: d.where(F.col("kind") == k).select("category", "image_id", *(F.col(c).alias(f"{p}{c}") for c in "nxywh"))
    g, p = side("F", "g"), side("O", "p")
    both = g.join(p, ["category", "image_id"]).groupBy("category", "gn", "pn").agg(F.sum(B.overlap("g", "p")).alias("i"))
    area = lambda t, c: t.groupBy("category", f"{c}n").agg(F.sum(B.area(c)).alias(f"{c}a"))
    j = area(g, "g").join(area(p, "p"), "category").join(both, ["category", "gn", "pn"], "left")
    i = F.coalesce("i", F.lit(0))
    union = F.col("ga") + F.col("pa") - i
    return j.select("category", "gn", "pn", F.when(union > 0, F.round(i / union.cast("double"), 6)).otherwise(1.0).alias("iou"))


@query("detection_counts", f"WITH {DET} SELECT category, count(*) FILTER (WHERE kind = 'O') AS dets, count(*) FILTER (WHERE kind = 'F') AS gt_dets, count(DISTINCT CASE WHEN kind = 'O' THEN n END) AS ids, count(DISTINCT CASE WHEN kind = 'F' THEN n END) AS gt_ids, count(DISTINCT image_id) AS frames FROM det GROUP BY 1")
def detection_counts(spark, sf):
    d, is_d = det(spark, sf), F.col("kind") == "O"
    return d.groupBy("category").agg(F.count_if(is_d).alias("dets"), F.count_if(~is_d).alias("gt_dets"), F.count_distinct(F.when(is_d, F.col("n"))).alias("ids"), F.count_distinct(F.when(~is_d, F.col("n"))).alias("gt_ids"), F.count_distinct("image_id").alias("frames"))


@query("new_detections", f"WITH {DET}, m AS (SELECT b.image_id, b.n, max({_IOU}) AS best FROM det a JOIN det b USING (image_id) WHERE a.kind = 'F' AND b.kind = 'O' GROUP BY 1, 2) SELECT d.image_id, d.n FROM det d LEFT JOIN m USING (image_id, n) WHERE d.kind = 'O' AND d.score >= 0.9 AND coalesce(best, 0) < 0.1")
def new_detections(spark, sf):
    """Detections of some score that no track overlaps: association in its any-match mode."""
    best = pairs(spark, sf).groupBy("image_id", F.col("dn").alias("n")).agg(F.max(B.iou("g", "d")).alias("best"))
    d = det(spark, sf).where("kind = 'O' AND score >= 0.9")
    return d.join(best, ["image_id", "n"], "left").where(F.coalesce("best", F.lit(0.0)) < 0.1).select("image_id", "n")


@query("best_track_per_detection", f"WITH {DET}, m AS (SELECT b.image_id, b.n, a.n AS track, {_IOU} AS iou FROM det a JOIN det b USING (image_id) WHERE a.kind = 'F' AND b.kind = 'O' AND b.score >= 0.8), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, n ORDER BY iou DESC, track) AS k FROM m WHERE iou >= 0.3) SELECT image_id, n, track FROM r WHERE k = 1")
def best_track_per_detection(spark, sf):
    m = pairs(spark, sf).where("dscore >= 0.8").withColumn("iou", B.iou("g", "d")).where("iou >= 0.3")
    return m.groupBy("image_id", F.col("dn").alias("n")).agg(F.max_by("gn", F.struct("iou", -F.col("gn"))).alias("track"))


def _matches(spark, sf):
    p = pairs(spark, sf).withColumn("iou", B.iou("g", "d")).where("iou > 0")
    return A.matched(p.select("image_id", "gn", "dn", "iou"), "image_id", "gn", "dn", "iou")


_BEST = f"WITH RECURSIVE {DET}, pw AS (SELECT image_id, a.n AS g, b.n AS d, {_IOU} AS w FROM det a JOIN det b USING (image_id) WHERE a.kind = 'F' AND b.kind = 'O' AND {_IOU} > 0), {best_matching('pw', 'image_id')}"


@query("optimal_matches", f"{_BEST} SELECT image_id, round(sum(w), 6) AS total, count(*) AS n FROM best GROUP BY 1")
def optimal_matches(spark, sf):
    """Heaviest one-to-one matching of boxes per image; ties make the pairs, not their total, arbitrary, so the total is given."""
    return _matches(spark, sf).groupBy("image_id").agg(F.round(F.sum("iou"), 6).alias("total"), F.count("*").alias("n"))


@query(
    "detection_f1",
    f"{_BEST}, n AS (SELECT count(*) FILTER (WHERE kind = 'F') AS gt, count(*) FILTER (WHERE kind = 'O') AS dt FROM det), t AS (SELECT threshold, count(*) AS tp FROM best, (VALUES (0.1), (0.25), (0.5), (0.75)) AS v(threshold) WHERE w >= threshold GROUP BY 1), q AS (SELECT CAST(threshold AS DOUBLE) AS threshold, tp, tp / (dt + 1e-4) AS p, tp / (gt + 1e-4) AS r FROM t, n) SELECT threshold, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-4), 6) AS f1 FROM q",
)
def detection_f1(spark, sf):
    """Micro precision, recall and F1 of optimal matches per threshold."""
    tp = A.thresholds(_matches(spark, sf), "iou", [0.1, 0.25, 0.5, 0.75]).groupBy("threshold").agg(F.count("*").alias("tp"))
    n = det(spark, sf).agg(F.count_if(F.col("kind") == "F").alias("gt"), F.count_if(F.col("kind") == "O").alias("dt"))
    p, r = F.col("tp") / (F.col("dt") + 1e-4), F.col("tp") / (F.col("gt") + 1e-4)
    return tp.crossJoin(n).select("threshold", "tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r + 1e-4), 6).alias("f1"))
