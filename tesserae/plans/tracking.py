"""Track metrics: a category is a sequence, an order a frame, a line's number in it an identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import boxes as B
from tesserae.operators import tracking as T
from tesserae.plans.boxes import _INTER, _IOU, _side, DET, det
from tesserae.plans.registry import query


def _inputs(spark, sf):
    d = det(spark, sf).withColumn("seq", F.col("category"))
    g, t = d.where("kind = 'F'"), d.where("kind = 'O'")
    p = _side(g, "g").join(_side(t, "d"), "image_id").where("gseq = dseq")
    pairs = p.select(F.col("gseq").alias("seq"), F.col("image_id").alias("frame"), F.col("gn").alias("g"), F.col("dn").alias("d"), B.iou("g", "d").alias("sim"))
    name = lambda x, a: x.select("seq", F.col("image_id").alias("frame"), F.col("n").alias(a))
    return pairs, name(g, "g"), name(t, "d")


@query("hota")
def hota(spark, sf):
    """Combined over sequences; the matching is a kernel, so no SQL twin."""
    d = T.combined(T.hota(*_inputs(spark, sf)))
    return d.select("alpha", "tp", "fn", "fp", *(F.round(c, 6).alias(c) for c in ("DetA", "AssA", "LocA", "HOTA")))


@query("hota_final")
def hota_final(spark, sf):
    d = T.hota(*_inputs(spark, sf))
    return d.groupBy("seq").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("DetA", "AssA", "LocA", "HOTA", "OWTA")))


@query(
    "identity_alignment",
    f"""
WITH {DET}, s AS (SELECT a.category AS seq, a.image_id AS frame, a.n AS g, b.n AS d, {_IOU} AS sim FROM det a JOIN det b USING (image_id) WHERE a.kind = 'F' AND b.kind = 'O' AND a.category = b.category),
w AS (SELECT seq, g, d, sum(share) AS agreed FROM (SELECT *, sim / (sum(sim) OVER (PARTITION BY seq, frame, g) + sum(sim) OVER (PARTITION BY seq, frame, d) - sim) AS share FROM s WHERE sim > 0) GROUP BY 1, 2, 3),
ng AS (SELECT category AS seq, n AS g, count(*) AS ng FROM det WHERE kind = 'F' GROUP BY 1, 2), nd AS (SELECT category AS seq, n AS d, count(*) AS nd FROM det WHERE kind = 'O' GROUP BY 1, 2)
SELECT seq, g, d, round(agreed / (ng + nd - agreed), 6) AS align FROM w JOIN ng USING (seq, g) JOIN nd USING (seq, d)
""",
)
def identity_alignment(spark, sf):
    pairs, gt, dt = _inputs(spark, sf)
    return T.alignment(pairs.where("sim > 0"), gt, dt).select("seq", "g", "d", F.round("align", 6).alias("align")).distinct()


@query(
    "track_iou_joint_frames",
    f"WITH {DET}, j AS (SELECT a.category, a.n AS g, b.n AS d, {_INTER} AS i, a.w * a.h + b.w * b.h AS s FROM det a JOIN det b USING (image_id, category) WHERE a.kind = 'F' AND b.kind = 'O') SELECT category, g, d, round(sum(i) / CAST(sum(s - i) AS DOUBLE), 6) AS iou FROM j GROUP BY 1, 2, 3",
)
def track_iou_joint_frames(spark, sf):
    """Of two tracks, over the frames that both have: sums of overlap and union."""
    d = det(spark, sf)
    p = _side(d.where("kind = 'F'"), "g").join(_side(d.where("kind = 'O'"), "d"), "image_id").where("gcategory = dcategory")
    return p.groupBy(F.col("gcategory").alias("category"), F.col("gn").alias("g"), F.col("dn").alias("d")).agg(F.round(F.sum(B.overlap("g", "d")) / F.sum(B.union("g", "d")).cast("double"), 6).alias("iou"))


@query("tracks_overlapping_truth", f"WITH {DET}, m AS (SELECT DISTINCT b.image_id, b.n FROM det a JOIN det b USING (image_id, category) WHERE a.kind = 'F' AND b.kind = 'O' AND {_IOU} >= 0.3), o AS (SELECT DISTINCT b.image_id, b.n FROM det a JOIN det b USING (image_id) WHERE a.kind = 'F' AND b.kind = 'O' AND a.category <> b.category AND {_IOU} >= 0.3) SELECT image_id, n FROM m WHERE (image_id, n) NOT IN (SELECT (image_id, n) FROM o)")
def tracks_overlapping_truth(spark, sf):
    """Detections that overlap a ground truth of their class and none of another."""
    d = det(spark, sf)
    p = _side(d.where("kind = 'F'"), "g").join(_side(d.where("kind = 'O'"), "d"), "image_id").where(B.iou("g", "d") >= 0.3)
    same = F.col("gcategory") == F.col("dcategory")
    return p.groupBy("image_id", F.col("dn").alias("n")).agg(F.bool_or(same).alias("own"), F.bool_or(~same).alias("other")).where("own AND NOT other").select("image_id", "n")


@query("local_f1_case_split", f"WITH {DET}, c AS (SELECT image_id, count(*) FILTER (WHERE kind = 'F') AS gt, count(*) FILTER (WHERE kind = 'O') AS dt FROM det GROUP BY 1) SELECT CASE WHEN gt = 0 AND dt = 0 THEN 'tn' WHEN gt = 0 THEN 'fp only' WHEN dt = 0 THEN 'fn only' ELSE 'matched' END AS case_, count(*) AS images, CAST(sum(gt) AS BIGINT) AS gt, CAST(sum(dt) AS BIGINT) AS dt FROM c GROUP BY 1")
def local_f1_case_split(spark, sf):
    c = det(spark, sf).groupBy("image_id").agg(F.count_if(F.col("kind") == "F").alias("gt"), F.count_if(F.col("kind") == "O").alias("dt"))
    case = F.when((F.col("gt") == 0) & (F.col("dt") == 0), "tn").when(F.col("gt") == 0, "fp only").when(F.col("dt") == 0, "fn only").otherwise("matched")
    return c.groupBy(case.alias("case_")).agg(F.count("*").alias("images"), F.sum("gt").alias("gt"), F.sum("dt").alias("dt"))
