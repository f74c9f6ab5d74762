"""Conversions between track and image records, query filters, further metrics and scalar operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import boxes as B
from tesserae.functions.keys import order_key
from tesserae.operators.tracking import track_annotations
from tesserae.plans.boxes import _INTER, DET, _side, det
from tesserae.plans.registry import query, table

def _annotations(boxes):
    """Per video and track the boxes by frame, numbered; an object is absent in every fourth image."""
    d = boxes.select(F.col("category").alias("video"), F.col("n").alias("track"), F.col("image_id").alias("image"), (F.col("image_id") % 4 != 0).alias("present"), "x", (F.col("w") * F.col("h")).alias("area"))
    return track_annotations(d).select(F.col("id").cast("long").alias("id"), "video", "track", F.col("frame").cast("long").alias("frame"), "x", "area")


@query(
    "tracklets_to_annotations",
    f"WITH {DET}, f AS (SELECT category AS video, n AS track, image_id, row_number() OVER (PARTITION BY category, n ORDER BY image_id) AS frame, x, w * h AS area FROM det) SELECT row_number() OVER (ORDER BY video, track, frame) AS id, video, track, frame, x, area FROM f WHERE image_id % 4 <> 0",
)
def tracklets_to_annotations(spark, sf):
    return _annotations(det(spark, sf))


@query("area_fallback", f"WITH {DET} SELECT image_id, n, CASE WHEN coalesce(a, 0) <= 0 THEN w * h ELSE a END AS area FROM (SELECT *, CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN 0 ELSE w * h - 1 END AS a FROM det) t WHERE NOT (x = 0 AND y = 0)")
def area_fallback(spark, sf):
    a = F.when(F.col("n") % 3 == 1, 0).when(F.col("n") % 3 == 2, F.col("w") * F.col("h") - 1)
    return det(spark, sf).where("NOT (x = 0 AND y = 0)").select("image_id", "n", F.when(F.coalesce(a, F.lit(0)) <= 0, F.col("w") * F.col("h")).otherwise(a).alias("area"))


@query("results_with_ids", f"WITH {DET} SELECT image_id, n, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, n) AS rank, w * h AS area, concat_ws(',', x, y, x, y + h, x + w, y + h, x + w, y) AS polygon FROM det")
def results_with_ids(spark, sf):
    p = F.array("x", "y", "x", F.col("y") + F.col("h"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.col("x") + F.col("w"), "y")
    return det(spark, sf).select("image_id", "n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "n")).cast("long").alias("rank"), (F.col("w") * F.col("h")).alias("area"), F.array_join(p.cast("array<string>"), ",").alias("polygon"))


@query("unknown_prediction_images", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def unknown_prediction_images(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey").distinct().join(o, "l_orderkey", "left_anti")


@query("tracklet_iou", f"WITH {DET}, j AS (SELECT a.category, a.n AS g, b.n AS d, {_INTER} AS i, a.w * a.h + b.w * b.h AS s FROM det a JOIN det b USING (image_id, category) WHERE a.n < b.n) SELECT category, g, d, count(*) AS frames, round(sum(i) / CAST(sum(s - i) AS DOUBLE), 6) AS iou FROM j GROUP BY 1, 2, 3")
def tracklet_iou(spark, sf):
    d = det(spark, sf)
    p = _side(d, "g").join(_side(d, "d"), "image_id").where("gcategory = dcategory AND gn < dn")
    return p.groupBy(F.col("gcategory").alias("category"), F.col("gn").alias("g"), F.col("dn").alias("d")).agg(F.count("*").alias("frames"), F.round(F.sum(B.overlap("g", "d")) / F.sum(B.union("g", "d")).cast("double"), 6).alias("iou"))


# Queries over objects: a conversation stands for a datapoint, its turns for queries.
@query("capped_queries", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user', md5(concat('9:', CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR))), turn) AS k FROM conversations) SELECT conv_id, turn FROM r WHERE k <= 4")
def capped_queries(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.col("role") == "user", order_key(9, "conv_id", "turn"), "turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("k")).where("k <= 4").drop("k")


@query("renumbered_stages", "SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS stage, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS reverse_stage FROM conversations WHERE role <> 'system'")
def renumbered_stages(spark, sf):
    w = Window.partitionBy("conv_id")
    return table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn", (F.dense_rank().over(w.orderBy("turn")) - 1).cast("long").alias("stage"), (F.dense_rank().over(w.orderBy(F.desc("turn"))) - 1).cast("long").alias("reverse_stage"))


@query("prefixed_text", "SELECT p_partkey, CASE WHEN lower(trim(p_type)) IN ('promo', 'small') THEN concat('a photo of ', p_name) ELSE p_name END AS text FROM part WHERE p_type <> 'LARGE'")
def prefixed_text(spark, sf):
    hit = F.lower(F.trim("p_type")).isin("promo", "small")
    return table(spark, sf, "part").where("p_type <> 'LARGE'").select("p_partkey", F.when(hit, F.concat(F.lit("a photo of "), "p_name")).otherwise(F.col("p_name")).alias("text"))


@query("visual_queries", "SELECT p_partkey, CASE WHEN md5(concat('4:', CAST(p_partkey AS VARCHAR))) < '4' THEN 'visual' ELSE p_name END AS text FROM part")
def visual_queries(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(order_key(4, "p_partkey") < "4", "visual").otherwise(F.col("p_name")).alias("text"))


@query("excluded_texts", "SELECT p_partkey FROM part WHERE p_name NOT IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 60)")
def excluded_texts(spark, sf):
    p = table(spark, sf, "part")
    return p.join(p.groupBy("p_name").agg(F.count("*").alias("n")).where("n > 60"), "p_name", "left_anti").select("p_partkey")


@query("category_substring_filter", "SELECT page_id FROM pages WHERE contains(url, '/en/') OR contains(url, '/fr/')")
def category_substring_filter(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").contains("/en/") | F.col("url").contains("/fr/")).select("page_id")


@query("tag_groups", r"SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, count(*) AS n FROM pages WHERE NOT regexp_matches(url, '#top$') GROUP BY 1, 2")
def tag_groups(spark, sf):
    p = table(spark, sf, "pages").where(~F.col("url").rlike("#top$"))
    return p.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang")).agg(F.count("*").alias("n"))


@query("non_exhaustive_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END) IS NOT FALSE")
def non_exhaustive_filter(spark, sf):
    flag = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 2 == 0)
    return table(spark, sf, "orders").where((F.col("o_orderstatus") != "P") & F.coalesce(flag, F.lit(True))).select("o_orderkey")


@query("padded_arrays", f"WITH {DET}, l AS (SELECT image_id, list(x ORDER BY n) AS xs FROM det GROUP BY 1), m AS (SELECT max(len(xs)) AS top FROM l) SELECT image_id, array_to_string(list_concat(xs, list_transform(range(top - len(xs)), lambda i: -1)), ',') AS padded FROM l, m")
def padded_arrays(spark, sf):
    l = det(spark, sf).groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "x"))), lambda e: e["x"]).alias("xs"))  # noqa: E741
    top = l.agg(F.max(F.size("xs")).alias("top"))  # one row
    return l.crossJoin(top).select("image_id", F.array_join(F.concat("xs", F.array_repeat(F.lit(-1).cast("long"), F.col("top") - F.size("xs"))).cast("array<string>"), ",").alias("padded"))


@query("hex_colours", "SELECT p_partkey, upper(concat(lpad(to_hex(p_partkey % 256), 2, '0'), lpad(to_hex(p_size * 5), 2, '0'), lpad(to_hex((p_partkey * 7) % 256), 2, '0'))) AS colour FROM part")
def hex_colours(spark, sf):
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    return table(spark, sf, "part").select("p_partkey", F.concat(two(F.col("p_partkey") % 256), two(F.col("p_size") * 5), two((F.col("p_partkey") * 7) % 256)).alias("colour"))


@query("result_tallies", "SELECT o_orderstatus AS status, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 250000) AS processed, count(*) FILTER (WHERE o_totalprice <= 250000 AND o_custkey % 2 = 0) AS skipped FROM orders GROUP BY 1")
def result_tallies(spark, sf):
    big = F.col("o_totalprice") > 250000
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("total"), F.count_if(big).alias("processed"), F.count_if(~big & (F.col("o_custkey") % 2 == 0)).alias("skipped"))


@query("frechet_distance")
def frechet_distance(spark, sf):
    """Between the embeddings of even and odd labels: means and covariances are one aggregate of the 64 dimensions' products; the square root is numpy's."""
    from tesserae.operators.fid import frechet

    e = table(spark, sf, "embeddings")
    return frechet(e.where("label % 2 = 0"), e.where("label % 2 = 1"), "embedding")


@query("linear_probe")
def linear_probe(spark, sf):
    """Accuracy of one-vs-rest logistic regression on the rows that it was fitted to."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.functions import array_to_vector

    d = table(spark, sf, "embeddings").select(F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    m = OneVsRest(classifier=LogisticRegression(maxIter=20)).fit(d)
    return m.transform(d).agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy"))


@query("kmeans_agreement")
def kmeans_agreement(spark, sf):
    """Agreement of k-means clusters, as many as labels, with the labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from tesserae.operators.metrics import cluster_agreement

    d = table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    k = d.select("label").distinct().count()
    c = KMeans(k=max(2, k), seed=1, maxIter=20).fit(d).transform(d)
    return cluster_agreement(c, "label", "prediction").select(*(F.round(x, 4).alias(x) for x in ("nmi", "ari", "purity")))
