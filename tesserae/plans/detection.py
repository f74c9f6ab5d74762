"""Detection metrics in score order, F1 with image-level cases, training matches, several-class ROC, masks of pixels, rotated boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import boxes as B
from tesserae.functions.columns import rounded
from tesserae.operators import assignment as A
from tesserae.operators import dedup as D
from tesserae.operators import detection as T
from tesserae.operators import metrics as M
from tesserae.operators import records as R
from tesserae.plans.boxes import _HULL, _IOU, _UNION, _side, DET, det, pairs
from tesserae.plans.images import _HASHES, _hashes
from tesserae.plans.metrics import _PRED, _pred
from tesserae.plans.matching import best_matching
from tesserae.plans.registry import query, table

#: Boxes of the surrogate are scattered, so overlaps and areas are set lower than in use.
_STEPS = [0.1, 0.2, 0.3, 0.5]
_AREAS = {"all": T.ANY_AREA, "small": (0.0, 600.0)}

_MATCHED = f"""
{DET}, t AS (SELECT unnest({_STEPS}) AS threshold), ar AS (SELECT * FROM (VALUES ('all', 0.0, 1e10), ('small', 0.0, 600.0)) v(area, lo, hi)),
cand AS (SELECT b.image_id, b.category, b.n, area, list({{'off': CASE WHEN a.w * a.h < lo OR a.w * a.h > hi THEN 1 ELSE 0 END, 'iou': {_IOU}, 'g': a.n}} ORDER BY CASE WHEN a.w * a.h < lo OR a.w * a.h > hi THEN 1 ELSE 0 END, {_IOU} DESC, a.n DESC) AS c
  FROM det a JOIN det b USING (image_id, category), ar WHERE a.kind = 'F' AND b.kind = 'O' AND {_IOU} >= 0.1 GROUP BY 1, 2, 3, 4),
d AS (SELECT image_id, category, n, score, w * h AS size, row_number() OVER (PARTITION BY image_id, category ORDER BY score DESC, n) AS k FROM det WHERE kind = 'O'),
s AS (SELECT d.*, area, lo, hi, coalesce(c, []) AS c FROM d CROSS JOIN ar LEFT JOIN cand USING (image_id, category, n, area) WHERE k <= :most),
f AS (SELECT image_id, category, threshold, area, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS score, false AS hit, false AS counts FROM (SELECT DISTINCT image_id, category FROM d), t, ar
  UNION ALL SELECT image_id, category, threshold, area, k, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.g) END, n, score, b IS NOT NULL, CASE WHEN b IS NULL THEN size BETWEEN lo AND hi ELSE b.off = 0 END
    FROM (SELECT f.image_id, f.category, threshold, f.area, s.k, used, s.n, s.score, size, lo, hi, list_filter(c, lambda x: x.iou >= threshold AND NOT list_contains(used, x.g))[1] AS b FROM f JOIN s ON s.image_id = f.image_id AND s.category = f.category AND s.area = f.area AND s.k = f.k + 1)),
np AS (SELECT category, area, count(*) FILTER (WHERE w * h BETWEEN lo AND hi) AS npos FROM det, ar WHERE kind = 'F' GROUP BY 1, 2),
r AS (SELECT category, threshold, area, hit, sum(hit::INT) OVER w AS tp, row_number() OVER w AS k FROM f WHERE counts WINDOW w AS (PARTITION BY category, threshold, area ORDER BY score DESC, image_id, n ROWS UNBOUNDED PRECEDING)),
q AS (SELECT r.*, npos, tp / CAST(k AS DOUBLE) AS p, floor(100 * tp / CAST(npos AS DOUBLE)) AS step FROM r JOIN np USING (category, area) WHERE npos > 0),
tops AS (SELECT category, threshold, area, step, max(p) AS p, max(tp / CAST(npos AS DOUBLE)) AS rec FROM q GROUP BY 1, 2, 3, 4),
e AS (SELECT category, threshold, area, i, max(p) AS p FROM tops, generate_series(0, 100) AS g(i) WHERE step >= i GROUP BY 1, 2, 3, 4),
res AS (SELECT category, threshold, area, npos, CASE WHEN npos > 0 THEN coalesce((SELECT sum(e.p) / 101 FROM e WHERE e.category = np.category AND e.threshold = t.threshold AND e.area = np.area), 0) ELSE -1 END AS ap,
  CASE WHEN npos > 0 THEN coalesce((SELECT max(rec) FROM tops WHERE tops.category = np.category AND tops.threshold = t.threshold AND tops.area = np.area), 0) ELSE -1 END AS ar FROM np, t)
"""


def _precision(spark, sf, most):
    d = det(spark, sf).withColumnRenamed("image_id", "image").withColumn("area", (F.col("w") * F.col("h")).cast("double"))
    gt, dt = d.where("kind = 'F'"), d.where("kind = 'O'")
    p = pairs(spark, sf).where("gcategory = dcategory").select(F.col("image_id").alias("image"), F.col("gcategory").alias("category"), F.col("gn").alias("g"), F.col("dn").alias("d"), B.iou("g", "d").alias("iou"))
    level = F.explode(F.array(*(F.lit(t) for t in _STEPS))).alias("threshold")
    out = None
    for name, area in _AREAS.items():
        npos = gt.groupBy("category").agg(F.count_if(F.col("area").between(*area)).alias("npos")).select("category", "npos", level)
        hits = T.score_order_hits(gt, dt, p, _STEPS, most, area)
        one = T.interpolated_precision(hits, npos, ["category", "threshold"]).withColumn("area", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("coco_average_precision", f"WITH RECURSIVE {_MATCHED.replace(':most', '100')} SELECT category, threshold, area, npos, round(ap, 6) AS ap, round(ar, 6) AS ar FROM res")
def coco_average_precision(spark, sf):
    """By category, threshold and area range; 100 detections an image."""
    return _precision(spark, sf, 100).select("category", "threshold", "area", "npos", F.round("ap", 6).alias("ap"), F.round("ar", 6).alias("ar"))


@query("average_recall", f"WITH RECURSIVE {_MATCHED.replace(':most', '1')} SELECT category, area, round(avg(ar), 6) AS ar FROM res WHERE ar > -1 GROUP BY 1, 2")
def average_recall(spark, sf):
    """Over thresholds, with one detection an image."""
    return _precision(spark, sf, 1).where("ar > -1").groupBy("category", "area").agg(F.round(F.avg("ar"), 6).alias("ar"))


_VOC = f"WITH RECURSIVE {_MATCHED.replace(':most', '100')}, v AS (SELECT category, threshold, hit, tp, k, npos, tp / CAST(npos AS DOUBLE) AS rec, max(p) OVER (PARTITION BY category, threshold ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS env, p FROM q WHERE area = 'all'), every AS (SELECT category, threshold FROM np, t WHERE area = 'all')"


def _voc(spark, sf):
    d = det(spark, sf).withColumnRenamed("image_id", "image").withColumn("area", (F.col("w") * F.col("h")).cast("double"))
    gt = d.where("kind = 'F'")
    p = pairs(spark, sf).where("gcategory = dcategory").select(F.col("image_id").alias("image"), F.col("gcategory").alias("category"), F.col("gn").alias("g"), F.col("dn").alias("d"), B.iou("g", "d").alias("iou"))
    npos = gt.groupBy("category").agg(F.count("*").alias("npos")).select("category", "npos", F.explode(F.array(*(F.lit(t) for t in _STEPS))).alias("threshold"))
    return T.voc_precision(T.score_order_hits(gt, d.where("kind = 'O'"), p, _STEPS, 100), npos, ["category", "threshold"])


@query("average_precision", f"{_VOC} SELECT category, threshold, round(coalesce(sum(env / npos) FILTER (WHERE hit), 0), 6) AS ap FROM every LEFT JOIN v USING (category, threshold) GROUP BY 1, 2")
def average_precision(spark, sf):
    """Area under the precision envelope, by category and threshold."""
    return _voc(spark, sf).select("category", "threshold", F.round("ap", 6).alias("ap"))


@query("eleven_point_ap", f"{_VOC}, x AS (SELECT category, threshold, i, coalesce(max(CASE WHEN rec >= i * CAST(0.1 AS DOUBLE) THEN p END), 0) AS p FROM every LEFT JOIN v USING (category, threshold), generate_series(0, 10) AS g(i) GROUP BY 1, 2, 3) SELECT category, threshold, round(avg(p), 6) AS ap FROM x GROUP BY 1, 2")
def eleven_point_ap(spark, sf):
    """Mean of the best precision at recalls 0, 0.1, ..., 1."""
    return _voc(spark, sf).select("category", "threshold", F.round("ap11", 6).alias("ap"))


@query(
    "ap_by_rarity",
    f"WITH RECURSIVE {_MATCHED.replace(':most', '100')}, b AS (SELECT CASE WHEN 20 * npos < sum(npos) OVER (PARTITION BY threshold) THEN 'rare' WHEN 4 * npos < sum(npos) OVER (PARTITION BY threshold) THEN 'common' ELSE 'frequent' END AS bucket, threshold, ap FROM res WHERE ap > -1), m AS (SELECT threshold, bucket, avg(ap) AS ap FROM b GROUP BY 1, 2) SELECT threshold, bucket, round(ap, 6) AS ap, round(avg(ap) OVER (PARTITION BY threshold), 6) AS mean_of_buckets FROM m",
)
def ap_by_rarity(spark, sf):
    """Average precision of rare, common and frequent classes, and the mean of these: a class here is a category and area range, rare if it has under a twentieth of the ground truth."""
    w = Window.partitionBy("threshold")
    share = F.sum("npos").over(w)
    b = _precision(spark, sf, 100).where("ap > -1").withColumn("bucket", F.when(20 * F.col("npos") < share, "rare").when(4 * F.col("npos") < share, "common").otherwise("frequent"))
    m = b.groupBy("threshold", "bucket").agg(F.avg("ap").alias("ap"))
    return m.select("threshold", "bucket", F.round("ap", 6).alias("ap"), F.round(F.avg("ap").over(w), 6).alias("mean_of_buckets"))


#: Objects of a video (image) and phrase (category); some have none on either side.
_VIDEO_GT, _VIDEO_DT = "kind = 'F' AND n % 5 <> 0", "kind = 'O' AND score >= 0.9"
_IOUS = [k / 100 for k in range(50, 100, 5)]
_AT = {"50": 0, "75": 5}
_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 1 END"


@query(
    "per_video_f1_pivot",
    f"""WITH RECURSIVE {DET}, pw AS (SELECT image_id, category, a.n AS g, b.n AS d, {_IOU} AS w FROM (SELECT * FROM det WHERE {_VIDEO_GT}) a JOIN (SELECT * FROM det WHERE {_VIDEO_DT}) b USING (image_id, category) WHERE {_IOU} > 0),
{best_matching("pw", "image_id, category")}, st AS (SELECT CAST(unnest({_IOUS}) AS DOUBLE) AS t), c AS (SELECT image_id, category, count(*) FILTER (WHERE {_VIDEO_GT}) AS gt, count(*) FILTER (WHERE {_VIDEO_DT}) AS dt FROM det GROUP BY 1, 2),
r AS (SELECT image_id, category, t, any_value(gt) AS gt, any_value(dt) AS dt, count(w) FILTER (WHERE w >= t) AS tp FROM c CROSS JOIN st LEFT JOIN best USING (image_id, category) GROUP BY 1, 2, 3),
x AS (SELECT image_id, category, t, tp, dt - tp AS fp, gt - tp AS fn FROM r), y AS (SELECT *, {_F1} AS f1 FROM x)
SELECT image_id AS video, category AS phrase, {", ".join(f"round(avg({c}), 6) AS {c}_50_95, round(max(CASE WHEN t = 0.5 THEN CAST({c} AS DOUBLE) END), 6) AS {c}_50, round(max(CASE WHEN t = 0.75 THEN CAST({c} AS DOUBLE) END), 6) AS {c}_75" for c in ("tp", "fp", "fn", "f1"))} FROM y GROUP BY 1, 2""",
)
def per_video_f1_pivot(spark, sf):
    """TP, FP, FN and F1 of each video and phrase at overlaps of 0.5, 0.75 and on average over 0.5 to 0.95; F1 is 1 where there is nothing to find and nothing found."""
    key = F.concat_ws("|", "image_id", "category").alias("key")
    d = det(spark, sf).withColumns({"gt": F.expr(_VIDEO_GT), "dt": F.expr(_VIDEO_DT)})
    number = d.groupBy("image_id", "category").agg(F.count_if("gt").alias("gt"), F.count_if("dt").alias("dt")).select("*", key)
    box = lambda flag, p: _side(d.where(flag).drop("gt", "dt"), p)
    p = box("gt", "g").join(box("dt", "d"), "image_id").where("gcategory = dcategory").withColumn("weight", B.iou("g", "d")).where("weight > 0")
    m = A.matched(p.select(F.concat_ws("|", "image_id", "gcategory").alias("key"), "gn", "dn", "weight"), "key", "gn", "dn", "weight")
    r = T.counted_f1(number, m, _IOUS)
    ones = F.transform(F.arrays_zip("tps", "fps", "fns"), lambda e: F.when(2 * e["tps"] + e["fps"] + e["fns"] > 0, 2 * e["tps"] / (2 * e["tps"] + e["fps"] + e["fns"])).otherwise(1.0))
    r = r.withColumn("f1s", ones)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / len(_IOUS)
    out = []
    for c in ("tp", "fp", "fn", "f1"):
        out += [F.round(mean(f"{c}s"), 6).alias(f"{c}_50_95"), *(F.round(F.get(f"{c}s", F.lit(k)).cast("double"), 6).alias(f"{c}_{t}") for t, k in _AT.items())]
    return r.select(F.col("image_id").alias("video"), F.col("category").alias("phrase"), *out)


@query(
    "best_of_several_truths",
    f"""WITH RECURSIVE {DET}, tr AS (SELECT * FROM (VALUES ('A', 0), ('N', 1), ('R', 2)) v(truth, place)), pw AS (SELECT image_id, a.category, a.n AS g, b.n AS d, {_IOU} AS w FROM (SELECT * FROM det WHERE kind = 'F') a JOIN (SELECT * FROM det WHERE {_VIDEO_DT}) b USING (image_id) WHERE {_IOU} > 0),
{best_matching("pw", "image_id, category")}, dts AS (SELECT image_id, count(*) AS dt FROM det WHERE {_VIDEO_DT} GROUP BY 1), gts AS (SELECT image_id, category AS truth, count(*) AS gt FROM det WHERE kind = 'F' GROUP BY 1, 2),
c AS (SELECT o_orderkey AS image_id, tr.truth, place, coalesce(gt, 0) AS gt, coalesce(dt, 0) AS dt FROM orders CROSS JOIN tr LEFT JOIN gts ON gts.image_id = o_orderkey AND gts.truth = tr.truth LEFT JOIN dts ON dts.image_id = o_orderkey),
r AS (SELECT c.image_id, c.truth, place, t, gt, dt, count(w) FILTER (WHERE w >= t) AS tp FROM c CROSS JOIN (SELECT CAST(unnest({_STEPS}) AS DOUBLE) AS t) st LEFT JOIN best ON best.image_id = c.image_id AND best.category = c.truth GROUP BY ALL),
pr AS (SELECT *, tp / (dt + 1e-4) AS p, tp / (gt + 1e-4) AS rc FROM r), m AS (SELECT image_id, truth, place, gt, dt, round(avg(2 * p * rc / (p + rc + 1e-4)), 9) AS f1 FROM pr GROUP BY ALL)
SELECT image_id AS image, CASE WHEN count(*) FILTER (WHERE gt = 0 AND dt = 0) > 0 THEN arg_max(truth, place) FILTER (WHERE gt = 0 AND dt = 0) ELSE arg_max(truth, struct_pack(a := f1, b := -place)) END AS truth FROM m GROUP BY 1""",
)
def best_of_several_truths(spark, sf):
    """The category of an order's boxes stands for the annotator; detections are the same for all of them."""
    d = det(spark, sf)
    found = d.where(_VIDEO_DT)
    truth = F.posexplode(F.array(*(F.lit(x) for x in "ANR"))).alias("place", "truth")
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), truth)
    gts = d.where("kind = 'F'").groupBy("image_id", F.col("category").alias("truth")).agg(F.count("*").alias("gt"))
    number = images.join(gts, ["image_id", "truth"], "left").join(found.groupBy("image_id").agg(F.count("*").alias("dt")), "image_id", "left").na.fill(0, ["gt", "dt"]).withColumn("key", F.concat_ws("|", "image_id", "truth"))
    p = _side(d.where("kind = 'F'"), "g").join(_side(found, "d"), "image_id").withColumn("weight", B.iou("g", "d")).where("weight > 0")
    m = A.matched(p.select(F.concat_ws("|", "image_id", "gcategory").alias("key"), "gn", "dn", "weight"), "key", "gn", "dn", "weight")
    r = T.counted_f1(number, m, _STEPS)

    def local(tp):
        precision, recall = tp / (F.col("dt") + 1e-4), tp / (F.col("gt") + 1e-4)
        return 2 * precision * recall / (precision + recall + 1e-4)

    f1 = F.when((F.col("gt") > 0) | (F.col("dt") > 0), F.round(F.aggregate(F.transform("tps", local), F.lit(0.0), lambda a, v: a + v) / len(_STEPS), 9))
    return T.best_truth(r.select(F.col("image_id").alias("image"), "truth", "place", f1.alias("f1")))


_ZOOM = "SELECT image_id, n, x, y, w, h, w * h - n % 4 AS area, least(w + greatest(0.2 * w, 16), 120) AS gw, least(h + greatest(0.2 * h, 16), 100) AS gh FROM det"


def _zoom_sql(name, share):
    size = f"least(gw * greatest(1, sqrt(area / (gw * gh) / {share})), 120) AS nw, least(gh * greatest(1, sqrt(area / (gw * gh) / {share})), 100) AS nh"
    start = lambda at, n, new, most: f"round({at} - least({at}, CASE WHEN {at} - ({new} - {n}) / 2 + {new} > {most} THEN {at} + {new} - {most} ELSE ({new} - {n}) / 2 END), 4)"
    return f"SELECT image_id, n, '{name}' AS crop, {start('x', 'w', 'nw', 120)} AS cx, {start('y', 'h', 'nh', 100)} AS cy, round(nw, 4) AS cw, round(nh, 4) AS ch FROM (SELECT *, {size} FROM (SELECT * REPLACE (CAST(gw AS DOUBLE) AS gw, CAST(gh AS DOUBLE) AS gh) FROM z))"


@query("zoom_crop", f"WITH {DET}, z AS ({_ZOOM}) {_zoom_sql('zoom', 0.25)} UNION ALL {_zoom_sql('context', 0.05)}")
def zoom_crop(spark, sf):
    """Two crops around each box: one that its mask fills to a quarter at most, one to a twentieth."""
    d, out = det(spark, sf).withColumn("mask", F.col("w") * F.col("h") - F.col("n") % 4), None
    for name, share in (("zoom", 0.25), ("context", 0.05)):
        box = B.zoomed(*(F.col(c) for c in "xywh"), 120, 100, F.col("mask"), share)
        one = d.select("image_id", "n", F.lit(name).alias("crop"), *(F.round(c, 4).alias(a) for c, a in zip(box, ("cx", "cy", "cw", "ch"))))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "otsu_candidate",
    f"WITH {DET}, c AS (SELECT image_id, kind, max(w * h) / 12000.0 AS largest, sum(w * h) / 12000.0 AS total, count(*) AS n FROM det GROUP BY 1, 2), s AS (SELECT image_id, kind, -abs(largest - 0.2) - 0.02 * least(n, 20) - CASE WHEN largest > 0.95 THEN 1 ELSE 0 END - CASE WHEN total > 0.98 THEN 0.5 ELSE 0 END AS score FROM c), p AS (SELECT image_id, max(score) FILTER (WHERE kind = 'F') AS f, max(score) FILTER (WHERE kind = 'O') AS o FROM s GROUP BY 1) SELECT image_id, round(f, 6) AS score, round(o, 6) AS inverse_score, CASE WHEN o IS NOT NULL AND (f IS NULL OR round(o, 9) > round(f, 9)) THEN 'inverse' ELSE 'plain' END AS chosen FROM p",
)
def otsu_candidate(spark, sf):
    """Of the masks of both polarities (box status) those that score higher, plain ones if equal. No masks: no score, which is less than any."""
    largest, total = F.max(F.col("w") * F.col("h")) / 12000, F.sum(F.col("w") * F.col("h")) / 12000
    score = -F.abs(largest - 0.2) - 0.02 * F.least(F.count("*"), F.lit(20)) - F.when(largest > 0.95, 1.0).otherwise(0.0) - F.when(total > 0.98, 0.5).otherwise(0.0)
    s = det(spark, sf).groupBy("image_id", "kind").agg(score.alias("score"))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("score")))
    p = s.groupBy("image_id").agg(of("F").alias("f"), of("O").alias("o"))
    inverse = F.col("o").isNotNull() & (F.col("f").isNull() | (F.round("o", 9) > F.round("f", 9)))
    return p.select("image_id", F.round("f", 6).alias("score"), F.round("o", 6).alias("inverse_score"), F.when(inverse, "inverse").otherwise("plain").alias("chosen"))


_CONTENT = """CASE turn % 4 WHEN 0 THEN to_json(text) WHEN 1 THEN '[{"type": "text", "text": ' || to_json(role) || '}, {"type": "image", "image": "a"}, "image", {"type": "image"}]' WHEN 2 THEN '{"type": "image"}' ELSE '[{"type": "image_url"}, {"kind": "image"}, {"type": "image", "text": "[{}]"}]' END"""


@query(
    "tool_call_images",
    f"WITH m AS (SELECT conv_id, CAST({_CONTENT} AS JSON) AS content FROM conversations) SELECT conv_id, CAST(sum(CASE WHEN json_type(content) = 'ARRAY' THEN len(list_filter(json_extract_string(content, '$[*].type'), lambda x: x = 'image')) ELSE 0 END) AS BIGINT) AS images FROM m GROUP BY 1",
)
def tool_call_images(spark, sf):
    """Images in the messages of a conversation: items of type image, where the content is a list."""
    role = F.to_json(F.struct("role"))
    text = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    role = F.regexp_extract(role, r'^\{"role":(.*)\}$', 1)
    content = (
        F.when(F.col("turn") % 4 == 0, F.coalesce(F.nullif(text, F.lit("")), F.lit("null")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit('[{"type": "text", "text": '), role, F.lit('}, {"type": "image", "image": "a"}, "image", {"type": "image"}]')))
        .when(F.col("turn") % 4 == 2, '{"type": "image"}')
        .otherwise('[{"type": "image_url"}, {"kind": "image"}, {"type": "image", "text": "[{}]"}]')
    )
    return table(spark, sf, "conversations").select("conv_id", R.images_in(content).alias("n")).groupBy("conv_id").agg(F.sum("n").alias("images"))


_IMAGE_LEVEL = f"""WITH RECURSIVE {DET}, k AS (SELECT * FROM det WHERE NOT (kind = 'F' AND image_id % 5 = 0) AND NOT (kind = 'O' AND image_id % 7 = 0)),
pw AS (SELECT image_id, a.n AS g, b.n AS d, {_IOU} AS w FROM k a JOIN k b USING (image_id) WHERE a.kind = 'F' AND b.kind = 'O' AND {_IOU} > 0), {best_matching("pw", "image_id")},
im AS (SELECT o_orderkey AS image_id, count(*) FILTER (WHERE kind = 'F') AS gt, count(*) FILTER (WHERE kind = 'O') AS dt FROM orders LEFT JOIN k ON image_id = o_orderkey GROUP BY 1),
l AS (SELECT im.image_id, gt, dt, t, count(w) FILTER (WHERE w >= t) AS tp, coalesce(sum(w), 0) AS overlap FROM im CROSS JOIN (SELECT CAST(unnest([0.1, 0.25, 0.5]) AS DOUBLE) AS t) LEFT JOIN best USING (image_id) GROUP BY ALL),
q AS (SELECT *, tp / (dt + 1e-4) AS p, tp / (gt + 1e-4) AS r FROM l),
s AS (SELECT t AS threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(dt - tp) AS BIGINT) AS fp, CAST(sum(gt - tp) AS BIGINT) AS fn, sum(CASE WHEN gt > 0 THEN dt - tp ELSE 0 END) AS pfp, avg(CASE WHEN gt > 0 AND dt > 0 THEN 2 * p * r / (p + r + 1e-4) END) AS positive_macro_f1,
  sum(CASE WHEN gt > 0 AND dt > 0 THEN 2 * p * r / (p + r + 1e-4) ELSE 0 END) / count(*) FILTER (WHERE gt > 0) AS macro_f1_all, count(*) FILTER (WHERE gt > 0 AND dt - tp = 0 AND gt - tp = 0) / (count(*) FILTER (WHERE gt > 0) + 1e-9) AS perfect_pos,
  count(*) FILTER (WHERE gt = 0 AND dt = 0) / (count(*) FILTER (WHERE gt = 0) + 1e-9) AS perfect_neg, avg(overlap / least(gt, dt)) FILTER (WHERE gt > 0 AND dt > 0) AS j,
  count(*) FILTER (WHERE gt > 0 AND dt > 0) AS il_tp, count(*) FILTER (WHERE gt = 0 AND dt > 0) AS il_fp, count(*) FILTER (WHERE gt > 0 AND dt = 0) AS il_fn, count(*) FILTER (WHERE gt = 0 AND dt = 0) AS il_tn FROM q GROUP BY 1),
u AS (SELECT *, tp / (tp + fp + 1e-4) AS precision, tp / (tp + fn + 1e-4) AS recall, tp / (tp + pfp + 1e-4) AS pp, il_tp / (il_tp + il_fn + 1e-6) AS il_recall, il_tp / (il_tp + il_fp + 1e-6) AS il_precision, il_fp / (il_fp + il_tn + 1e-6) AS il_fpr FROM s),
v AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-4) AS f1, 2 * pp * recall / (pp + recall + 1e-4) AS positive_micro_f1, 2 * il_precision * il_recall / (il_precision + il_recall + 1e-6) AS il_f1,
  (CAST(il_tp AS DOUBLE) * il_tn - CAST(il_fp AS DOUBLE) * il_fn) / (sqrt(CAST(il_tp + il_fp AS DOUBLE) * (il_tp + il_fn) * (il_tn + il_fp) * (il_tn + il_fn)) + 1e-6) AS il_mcc FROM u)
SELECT threshold, tp, fp, fn, round(positive_macro_f1, 6) AS positive_macro_f1, il_tp, il_fp, il_fn, il_tn, {", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "il_recall", "il_precision", "il_fpr", "f1", "positive_micro_f1", "il_f1", "il_mcc", "macro_f1_all", "perfect_pos", "perfect_neg", "j"))},
  round(positive_micro_f1 * il_mcc, 6) AS cgf1, round(positive_macro_f1 * il_mcc, 6) AS cgf1_macro, round(macro_f1_all * il_mcc, 6) AS cgf1_macro_all FROM v"""


@query("image_level_f1", _IMAGE_LEVEL)
def image_level_f1(spark, sf):
    """Every fifth image has no ground truth here, every seventh no detections."""
    d = det(spark, sf).where("NOT (kind = 'F' AND image_id % 5 = 0) AND NOT (kind = 'O' AND image_id % 7 = 0)")
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image")).join(d.groupBy(F.col("image_id").alias("image")).agg(F.count_if(F.col("kind") == "F").alias("gt"), F.count_if(F.col("kind") == "O").alias("dt")), "image", "left").na.fill(0)
    p = _side(d.where("kind = 'F'"), "g").join(_side(d.where("kind = 'O'"), "d"), "image_id").select(F.col("image_id").alias("image"), "gn", "dn", B.iou("g", "d").alias("weight")).where("weight > 0")
    r = T.image_level_f1(images, A.matched(p, "image", "gn", "dn", "weight"), [0.1, 0.25, 0.5])
    return r.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


# Boxes in shares of an image of 120 by 100; a weight above 0 for every pair makes the heaviest matching the cheapest one of as many pairs as there can be.
_SHARES = f"sh AS (SELECT image_id, n, x / 120.0::DOUBLE AS x, w / 120.0::DOUBLE AS w, y / 100.0::DOUBLE AS y, h / 100.0::DOUBLE AS h, score, category, kind FROM det)"
_TARGETS = f"""{DET}, {_SHARES}, tg AS (
  SELECT image_id, a.n AS g, b.n AS d, CASE WHEN a.category = b.category THEN b.score ELSE (1 - b.score) / 2 END AS prob, {_IOU} AS iou, {_IOU} - ({_HULL} - {_UNION}) / CAST({_HULL} AS DOUBLE) AS giou,
    abs((a.x + a.w / 2) - (b.x + b.w / 2)) + abs((a.y + a.h / 2) - (b.y + b.h / 2)) + abs(a.w - b.w) + abs(a.h - b.h) AS apart
  FROM sh a JOIN sh b USING (image_id) WHERE a.kind = 'F' AND b.kind = 'O')"""


def _targets(spark, sf):
    p = pairs(spark, sf).withColumnsRenamed({"image_id": "image", "gn": "g", "dn": "d"})
    for c, size in (("x", 120.0), ("w", 120.0), ("y", 100.0), ("h", 100.0)):
        p = p.withColumns({f"{s}{c}": F.col(f"{s}{c}") / size for s in "gd"})
    return p.withColumn("prob", F.when(F.col("gcategory") == F.col("dcategory"), F.col("dscore")).otherwise((1 - F.col("dscore")) / 2).cast("double"))


def _costs(cost, copies=1):  # nine digits: costs of seven, which some are, lie on the edge of six, where engines round apart
    pw = f"co AS (SELECT image_id, g * {copies} + k AS g, d, CAST({cost} AS DOUBLE) AS cost FROM tg, generate_series(0, {copies - 1}) AS s(k)), pw AS (SELECT image_id, g, d, 50 - cost AS w FROM co)"
    return f"WITH RECURSIVE {_TARGETS}, {pw}, {best_matching('pw', 'image_id')} SELECT image_id AS image, round(sum(cost), 9) AS cost, count(*) AS n FROM best JOIN co USING (image_id, g, d) GROUP BY 1"


def _summed(matches):
    return matches.groupBy("image").agg(F.round(F.sum("cost"), 9).alias("cost"), F.count("*").alias("n"))


def _focal(p):
    return f"0.75 * pow({p}, 2) * ln(1 - {p} + 1e-8) - 0.25 * pow(1 - {p}, 2) * ln({p} + 1e-8)"


@query("least_cost_matches", _costs("apart - prob - giou"))
def least_cost_matches(spark, sf):
    """Targets of training per image: the cost and number of the cheapest one-to-one matches; ties leave the pairs open, not their cost."""
    return _summed(T.least_cost_pairs(_targets(spark, sf), "prob"))


@query("focal_cost_matches", _costs(f"5 * apart + 2 * ({_focal('CAST(prob AS DOUBLE)')}) - 2 * giou"))
def focal_cost_matches(spark, sf):
    return _summed(T.least_cost_pairs(_targets(spark, sf), "prob", (2.0, 5.0, 2.0), focal=(0.25, 2.0)))


@query("overlap_cost_matches", _costs(f"apart + {_focal('(prob * (giou + 1) / 2)')} - giou"))
def overlap_cost_matches(spark, sf):
    """The focal cost of the probability times the rescaled overlap."""
    return _summed(T.least_cost_pairs(_targets(spark, sf), "prob", focal=(0.25, 2.0), by_overlap=True))


@query("repeated_target_matches", _costs("apart - prob - giou", 2))
def repeated_target_matches(spark, sf):
    """Each target may be taken twice."""
    return _summed(T.least_cost_pairs(_targets(spark, sf), "prob", repeats=2))


@query(
    "one_to_many_matches",
    f"""WITH {_TARGETS}, s AS (SELECT image_id, g, d, 0.3::DOUBLE * prob + 0.7::DOUBLE * iou AS score FROM tg), l AS (SELECT image_id, g, list_sort(list(score)) AS l, count(*) AS n FROM s GROUP BY 1, 2),
p AS (SELECT *, greatest((1 - 2 / n) * (n - 1), 0) AS pos FROM l), q AS (SELECT image_id, g, CASE WHEN n < 2 THEN -1 ELSE l[floor(pos)::INT + 1] + (l[ceil(pos)::INT + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)) END AS cut FROM p)
SELECT image_id AS image, g, d, round(score, 6) AS score FROM s JOIN q USING (image_id, g) WHERE score > cut AND score > 0.25""",
)
def one_to_many_matches(spark, sf):
    """Two predictions a target at most; the twin takes the quantile by its definition."""
    return T.one_to_many_pairs(_targets(spark, sf), "prob", threshold=0.25, top=2).withColumn("score", rounded(F.col("score"), 6))


_SCORES = f"{_PRED}, sc AS (SELECT c_custkey, y, k, ((c_custkey * (k + 3)) % 97 + CASE WHEN y = k THEN 20 ELSE 0 END) / 117.0 AS s FROM pred, generate_series(0, 4) AS g(k))"


@query(
    "roc_auc_classes",
    f"""WITH {_SCORES}, u AS (SELECT a.k, b.y AS j, count(*) AS n, sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS u FROM sc a JOIN sc b ON a.k = b.k AND a.y = a.k AND b.y <> b.k GROUP BY 1, 2)
SELECT round(avg(u / n), 6) AS ovo, (SELECT round(avg(x), 6) FROM (SELECT sum(u) / sum(n) AS x FROM u GROUP BY k)) AS ovr FROM u""",
)
def roc_auc_classes(spark, sf):
    """Over five classes, scored for each."""
    p = _pred(spark, sf).select("c_custkey", "y", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    s = ((F.col("c_custkey") * (F.col("k") + 3)) % 97 + F.when(F.col("y") == F.col("k"), 20).otherwise(0)) / 117.0
    return M.roc_auc_classes(p.withColumn("s", s), "y", "k", "s").select(F.round("ovo", 6).alias("ovo"), F.round("ovr", 6).alias("ovr"))


def _mask_overlaps(px):
    """Masks as sets of pixels: an equi-join by pixel counts what two share. Only masks of one image meet."""
    size = px.groupBy("image", "mask").agg(F.count("*").alias("n"))
    side = lambda d, c: d.withColumnsRenamed({"mask": c, "n": f"n{c}"})
    shared = side(px, "a").join(side(px, "b"), ["image", "x", "y"]).where("a < b").groupBy("image", "a", "b").agg(F.count("*").alias("i"))
    d = shared.join(side(size, "a"), ["image", "a"]).join(side(size, "b"), ["image", "b"])
    i, na, nb = F.col("i"), F.col("na"), F.col("nb")
    return d.select("image", "a", "b", "i", F.round(i / F.greatest(na + nb - i, F.lit(1)), 6).alias("iou"), F.round(B.ratio(i, F.least(na, nb)), 6).alias("iom"))


def _mask_boxes(px):
    return px.groupBy("image", "mask").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("area"))


#: All rows; fifty orders are an image, so images grow with the table.
_ALL_PIXELS = "px AS (SELECT DISTINCT l_orderkey // 50 AS image, l_linenumber AS mask, l_partkey % 16 AS x, l_suppkey % 16 AS y FROM lineitem)"


def _all_pixels(spark, sf):
    image = F.floor(F.col("l_orderkey") / 50).alias("image")
    return table(spark, sf, "lineitem").select(image, F.col("l_linenumber").alias("mask"), (F.col("l_partkey") % 16).alias("x"), (F.col("l_suppkey") % 16).alias("y")).distinct()


@query(
    "mask_overlaps",
    f"WITH {_ALL_PIXELS}, sz AS (SELECT image, mask, count(*) AS n FROM px GROUP BY 1, 2), i AS (SELECT a.image, a.mask AS a, b.mask AS b, count(*) AS i FROM px a JOIN px b USING (image, x, y) WHERE a.mask < b.mask GROUP BY 1, 2, 3) SELECT i.image, a, b, i, round(i / CAST(p.n + q.n - i AS DOUBLE), 6) AS iou, round(i / CAST(least(p.n, q.n) AS DOUBLE), 6) AS iom FROM i JOIN sz p ON p.image = i.image AND p.mask = a JOIN sz q ON q.image = i.image AND q.mask = b",
)
def mask_overlaps(spark, sf):
    return _mask_overlaps(_all_pixels(spark, sf))


@query("mask_boxes", f"WITH {_ALL_PIXELS} SELECT image, mask, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS area FROM px GROUP BY 1, 2")
def mask_boxes(spark, sf):
    """Corners that hold the last pixel in; ``tight_box_of_points`` gives sizes, one more."""
    return _mask_boxes(_all_pixels(spark, sf))


_TURNED = f"{DET}, rb AS (SELECT image_id, n, kind, x + w / 2.0 AS cx, y + h / 2.0 AS cy, w, h, (n * 15 - 120) AS a FROM det)"


def _turned(spark, sf, angle):
    return det(spark, sf).select("image_id", "n", "kind", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), "w", "h", angle.cast("double").alias("a"))


@query("upright_bounds", f"WITH {_TURNED}, b AS (SELECT *, abs(cos(radians(a))) * w + abs(sin(radians(a))) * h AS nw, abs(cos(radians(a))) * h + abs(sin(radians(a))) * w AS nh FROM rb) SELECT image_id, n, round(cx - nw / 2, 5) AS x1, round(cy - nh / 2, 5) AS y1, round(cx + nw / 2, 5) AS x2, round(cy + nh / 2, 5) AS y2 FROM b")
def upright_bounds(spark, sf):
    r = _turned(spark, sf, F.col("n") * 15 - 120)
    b = B.upright_bounds(*(F.col(c) for c in ("cx", "cy", "w", "h", "a")))
    return r.select("image_id", "n", *(F.round(c, 5).alias(name) for c, name in zip(b, ("x1", "y1", "x2", "y2"))))


@query("clipped_level_boxes", f"WITH {DET}, r AS (SELECT image_id, n, x + w / 2.0 AS cx, y + h / 2.0 AS cy, w, h, n % 3 = 0 AS level FROM det), b AS (SELECT *, least(cx - w / 2.0, 90) AS x1, least(cx + w / 2.0, 90) AS x2, least(cy - h / 2.0, 70) AS y1, least(cy + h / 2.0, 70) AS y2 FROM r) SELECT image_id, n, CASE WHEN level THEN (x1 + x2) / 2 ELSE cx END AS cx, CASE WHEN level THEN (y1 + y2) / 2 ELSE cy END AS cy, CASE WHEN level THEN x2 - x1 ELSE w END AS w, CASE WHEN level THEN y2 - y1 ELSE h END AS h FROM b")
def clipped_level_boxes(spark, sf):
    """A box is level at a multiple of a full turn; others keep their size."""
    r = _turned(spark, sf, F.when(F.col("n") % 3 == 0, 360).otherwise(F.col("n") * 15 + 5))
    b = B.clipped_if_level(*(F.col(c) for c in ("cx", "cy", "w", "h", "a")), 90, 70)
    return r.select("image_id", "n", *(c.alias(name) for c, name in zip(b, ("cx", "cy", "w", "h"))))


def _rotated_iou(spark, sf, angle):
    r = _turned(spark, sf, angle)
    r = r.select("image_id", "n", "kind", (F.col("w") * F.col("h")).alias("area"), B.corners(*(F.col(c) for c in ("cx", "cy", "w", "h", "a"))).alias("p"))
    both = _side(r.where("kind = 'F'"), "g").join(_side(r.where("kind = 'O'"), "d"), "image_id").withColumn("i", B.convex_overlap(F.col("gp"), F.col("dp")))
    return both.select("image_id", "gn", "dn", F.round(F.round(F.col("i") / (F.col("garea") + F.col("darea") - F.col("i")), 9), 6).alias("iou"))


_QUARTER = f"WITH {DET}, q AS (SELECT image_id, n, kind, CASE WHEN n % 2 = 1 THEN h ELSE w END AS w, CASE WHEN n % 2 = 1 THEN w ELSE h END AS h, x + w / 2.0 AS cx, y + h / 2.0 AS cy FROM det), det2 AS (SELECT image_id, n, kind, cx - w / 2.0 AS x, cy - h / 2.0 AS y, w, h FROM q) SELECT image_id, a.n AS gn, b.n AS dn, round(round({_IOU}, 9), 6) AS iou FROM det2 a JOIN det2 b USING (image_id) WHERE a.kind = 'F' AND b.kind = 'O'"


@query("rotated_iou_quarter_turns", _QUARTER)
def rotated_iou_quarter_turns(spark, sf):
    """By quarter turns the boxes are upright again, so plain overlap is the twin."""
    return _rotated_iou(spark, sf, F.col("n") * 90)


@query("rotated_iou")
def rotated_iou(spark, sf):
    """At any angle; a test holds it against counted points."""
    return _rotated_iou(spark, sf, F.col("n") * 15 - 120)


@query(
    "near_dedup_greedy",
    f"""WITH RECURSIVE {_HASHES}, fs AS (SELECT doc_id, hash, row_number() OVER (ORDER BY doc_id) AS k FROM prints),
near AS (SELECT b.k, list(a.doc_id) AS before FROM fs a JOIN fs b ON a.k < b.k WHERE bit_count(xor(a.hash, b.hash)) <= 5 GROUP BY 1),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT f.k + 1, CASE WHEN list_has_any(kept, coalesce(before, [])) THEN kept ELSE list_append(kept, doc_id) END FROM f JOIN fs ON fs.k = f.k + 1 LEFT JOIN near ON near.k = fs.k)
SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM f ORDER BY k DESC LIMIT 1)""",
)
def near_dedup_greedy(spark, sf):
    return D.near_kept(_hashes(spark, sf), "doc_id", "hash", 5, bits=60).select(F.col("id").alias("doc_id"))
