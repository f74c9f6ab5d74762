"""Sources and sinks: each query writes a table in a format to the shared folder and reads it back by its scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.columns import named, widened
from tesserae.operators.lineage import scratch
from tesserae.plans.boxes import DET, det
from tesserae.plans.registry import query, table
from tesserae.sources import images as S
from tesserae.sources import sinks as K


@query("labelled_csv_scan", "SELECT concat('im', doc_id, '.png') AS image, source AS label FROM documents")
def labelled_csv_scan(spark, sf):
    path = scratch(spark, "labels")
    d = table(spark, sf, "documents")
    d.select(F.col("lang").alias("other"), F.concat(F.lit("im"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"), F.col("source").alias("label")).write.option("header", True).csv(path)
    return S.labelled_csv(spark, path)


@query(
    "missing_images",
    "WITH l AS (SELECT concat('im', doc_id, '.png') AS image FROM documents), f AS (SELECT concat('im', doc_id, '.png') AS image FROM labels) SELECT DISTINCT image FROM l WHERE image NOT IN (SELECT image FROM f)",
)
def missing_images(spark, sf):
    """Names of a list that a folder's listing lacks."""
    name = F.concat(F.lit("im"), F.col("doc_id").cast("string"), F.lit(".png"))
    listing = table(spark, sf, "labels").select(F.concat(F.lit("/folder/"), name).alias("path"))
    return S.resolved(table(spark, sf, "documents").select(name.alias("image")), listing)[1]


@query(
    "split_files",
    "SELECT o_orderstatus AS split, o_orderpriority AS label, count(*) AS count FROM orders GROUP BY 1, 2",
)
def split_files(spark, sf):
    """Splits as a folder each and their counts per class, from the files."""
    path = scratch(spark, "splits")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("split"))
    K.write_splits(o, f"{path}/splits")
    K.write_counts(spark.read.option("header", True).csv(f"{path}/splits"), f"{path}/counts")
    return spark.read.schema("split string, label string, count long").option("header", True).csv(f"{path}/counts")


@query("file_scan", "SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'png' WHEN n_nationkey % 3 = 1 THEN 'jpg' ELSE 'mp4' END AS suffix, count(*) AS files, count(*) FILTER (WHERE n_regionkey = 0) AS at_top FROM nation GROUP BY 1")
def file_scan(spark, sf):
    """Files by suffix, in any case, of a folder and of all below it."""
    path = scratch(spark, "files")

    def write(batches):
        import pandas as pd

        from tesserae.sources.files import put

        for pdf in batches:
            for key, region in zip(pdf["n_nationkey"], pdf["n_regionkey"]):
                kind = ("png", "JPG", "mp4")[key % 3]
                put(f"{path}/{'' if region == 0 else f'r{region}/'}{key}.{kind}", "x")
                put(f"{path}/{key}.notes", "x")
            yield pd.DataFrame({"n": [len(pdf)]})

    table(spark, sf, "nation").select("n_nationkey", "n_regionkey").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    every = (*S.IMAGE_SUFFIXES, *S.VIDEO_SUFFIXES)
    count = lambda recursive, name: S.files(spark, path, every, recursive).groupBy(S.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias(name))
    return count(True, "files").join(count(False, "at_top"), "suffix", "left").na.fill(0)


@query("coco_round_trip", f"WITH {DET} SELECT image_id, concat('im', image_id) AS file_name, count(*) AS n, sum(w * h) * 1.0 AS area, sum(x + w) * 1.0 AS right_edges, min(category) AS least FROM det GROUP BY 1, 2")
def coco_round_trip(spark, sf):
    """A COCO document with corners, written and read."""
    path = f"{scratch(spark, 'coco')}.json"
    d = det(spark, sf)
    box = F.array(*(F.col(c).cast("double") for c in "xywh"))
    category = F.when(F.col("category") == "A", 1).when(F.col("category") == "N", 2).otherwise(3)
    anns = d.select((F.col("image_id") * 100 + F.col("n")).alias("id"), "image_id", category.cast("long").alias("category_id"), box.alias("bbox"), (F.col("w") * F.col("h")).cast("double").alias("area"), F.lit(0).alias("iscrowd"), "score")
    images = d.select(F.col("image_id").alias("id"), F.concat(F.lit("im"), F.col("image_id").cast("string")).alias("file_name"), F.lit(120).alias("width"), F.lit(100).alias("height")).distinct()
    cats = spark.createDataFrame([(1, "A"), (2, "N"), (3, "R")], "id long, name string")
    K.write_coco(images, anns, cats, path, corners=True)
    i, a, c = S.coco(spark, path, lines=True)
    named_ = a.join(F.broadcast(c.select(F.col("id").alias("category_id"), "name")), "category_id")  # three rows
    per = named_.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.sum(F.get("bbox", F.lit(2))).alias("right_edges"), F.min("name").alias("least"))
    return per.join(i.select(F.col("id").alias("image_id"), "file_name"), "image_id").select("image_id", "file_name", "n", "area", "right_edges", "least")


@query("result_records", f"WITH {DET}, r AS (SELECT *, row_number() OVER (ORDER BY image_id, score DESC, category, x, y, w, h) AS id FROM det) SELECT id, image_id, w * h * 1.0 AS area FROM r")
def result_records(spark, sf):
    """Predictions as annotations with ids."""
    d = det(spark, sf)
    category = F.when(F.col("category") == "A", 1).when(F.col("category") == "N", 2).otherwise(3)
    p = d.select("image_id", category.alias("category_id"), F.array(*(F.col(c).cast("double") for c in "xywh")).alias("bbox"), "score")
    return S.results(p, table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))).select("id", "image_id", "area")


@query("tracking_text_scan", f"WITH {DET} SELECT image_id AS frame, n AS id, x * 1.0 AS x, round(score, 4) AS conf FROM det WHERE n % 4 <> 0 AND category IN ('A', 'N')")
def tracking_text_scan(spark, sf):
    """Lines of tracked boxes; negative ids and other classes are left out."""
    path = scratch(spark, "mot")
    cls = F.when(F.col("category") == "A", 1).when(F.col("category") == "N", 2).otherwise(3)
    det(spark, sf).select("image_id", F.when(F.col("n") % 4 == 0, -1).otherwise(F.col("n")), "x", "y", "w", "h", "score", cls, F.lit(1)).write.csv(path)
    return S.tracks(spark, path, classes=[1, 2]).select("frame", "id", "x", F.round("conf", 4).alias("conf"))


@query("yolo_layout", f"WITH {DET} SELECT category AS stem, CASE WHEN n % 2 = 0 THEN printf('%d %.6f %.6f %.6f %.6f %.6f %.6f', n % 5, x / 120.0, y / 100.0, (x + w) / 120.0, y / 100.0, (x + w) / 120.0, (y + h) / 100.0) ELSE printf('%d %.6f %.6f %.6f %.6f', n % 5, (x + w / 2.0) / 120, (y + h / 2.0) / 100, w / 120.0, h / 100.0) END AS line, 3 AS classes FROM det")
def yolo_layout(spark, sf):
    """Lines of polygons and of boxes by stem, and the class names of data.yaml."""
    path = scratch(spark, "yolo")
    d = det(spark, sf)
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    boxes = d.select(F.col("category").alias("stem"), (F.col("n") % 5).alias("category"), *"xywh", F.lit(120.0).alias("width"), F.lit(100.0).alias("height"), F.when(F.col("n") % 2 == 0, F.array(x, y, x + w, y, x + w, y + h)).alias("polygon"))
    K.write_yolo(boxes, path, ["a", "b", "a", "c"])
    names = spark.read.text(f"{path}/data.yaml").where("value LIKE 'nc: %'").select(F.substring("value", 5, 9).cast("int").alias("classes"))
    return spark.read.text(f"{path}/labels").crossJoin(names).select("stem", F.col("value").alias("line"), "classes")  # names: one row


@query("voc_layout", f"WITH {DET} SELECT category AS stem, count(*) AS objects, CAST(sum(x + w) AS BIGINT) AS right_edges, 3 AS listed FROM det GROUP BY 1")
def voc_layout(spark, sf):
    """Documents by stem, and the list of stems."""
    path = scratch(spark, "voc")
    boxes = det(spark, sf).select(F.col("category").alias("stem"), F.lit("insect").alias("name"), *"xywh", F.lit(120).alias("width"), F.lit(100).alias("height"))
    K.write_voc(boxes, path)
    listed = spark.read.text(f"{path}/ImageSets/Main/default").agg(F.count("*").cast("int").alias("listed"))
    right = F.regexp_extract_all("value", F.lit(r"<xmax>(\d+)</xmax>"), F.lit(1))
    lines = spark.read.text(f"{path}/Annotations").select("stem", right.alias("r"))
    docs = lines.groupBy("stem").agg(F.sum(F.size("r").cast("long")).alias("objects"), F.sum(F.aggregate("r", F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))).alias("right_edges"))
    return docs.crossJoin(listed)  # one row


_PROBA = "WITH x AS (SELECT vec_id, list_transform(embedding[1:4], lambda z: CAST(z AS DOUBLE)) AS l FROM embeddings) SELECT vec_id"


@query("wide_columns", f"{_PROBA}, {', '.join(f'round(l[{k + 1}], 6) AS feat_{k}, round(l[{k + 1}] / 2, 6) AS proba_{k}' for k in range(4))} FROM x")
def wide_columns(spark, sf):
    """Arrays as numbered columns, written as CSV and read back; features are then found by their prefix."""
    path = scratch(spark, "wide")
    x = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda z: z.cast("double")).alias("l")).withColumn("p", F.transform("l", lambda z: z / 2))
    K.write_table(x.select("vec_id", *widened("l", 4, "feat_"), *widened("p", 4, "proba_")), path)
    d = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), *(F.round(F.col(c), 6).alias(c) for c in [*named(d, "feat_"), *named(d, "proba_")]))


@query("metric_file", "SELECT p_type, printf('%.4f', avg(p_retailprice)) AS price, printf('%.4f', avg(p_size)) AS size FROM part GROUP BY 1")
def metric_file(spark, sf):
    path = scratch(spark, "metrics")
    K.write_pivot(table(spark, sf, "part").groupBy("p_type").agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size")), path)
    return spark.read.option("header", True).option("sep", "\t").csv(path)


_TRACKLETS = f"{DET}, tk AS (SELECT image_id % 50 AS video, n AS track, list(CASE WHEN kind = 'O' AND category = 'R' THEN NULL ELSE [x, y, w, h] END ORDER BY image_id, x) AS b FROM det GROUP BY 1, 2)"


@query("tracklet_scan", f"WITH {_TRACKLETS} SELECT video * 100 + track AS id, video AS image_id, track % 3 AS category_id, len(b) AS frames, round(list_avg(list_transform(b, lambda v: CASE WHEN v IS NULL THEN 0 ELSE v[3] * v[4] END)), 6) AS area, CAST(list_sum(list_transform(b, lambda v: CASE WHEN v IS NULL THEN 0 ELSE v[1] END)) AS DOUBLE) AS lefts FROM tk")
def tracklet_scan(spark, sf):
    """Tracklet documents, one a video, written and read; absent boxes are zeros."""
    path = scratch(spark, "ytvis")
    box = F.when(~((F.col("kind") == "O") & (F.col("category") == "R")), F.array(*(F.col(c).cast("double") for c in "xywh")))
    tk = det(spark, sf).groupBy((F.col("image_id") % 50).alias("video"), F.col("n").alias("track")).agg(F.sort_array(F.collect_list(F.struct("image_id", "x", box.alias("b")))).alias("l"))
    boxes = F.transform("l", lambda e: e["b"])
    ann = F.struct((F.col("video") * 100 + F.col("track")).alias("id"), F.col("video").alias("video_id"), (F.col("track") % 3).alias("category_id"), boxes.alias("bboxes"), F.transform(boxes, lambda b: b[2] * b[3]).alias("areas"), F.lit(0).alias("iscrowd"))
    doc = tk.groupBy("video").agg(F.collect_list(ann).alias("annotations")).select(F.array(F.struct(F.col("video").alias("id"), F.lit(9).alias("length"))).alias("videos"), "annotations")
    doc.write.option("ignoreNullFields", False).json(path)
    v, a = S.tracklets(spark, path, lines=True)
    lefts = F.aggregate("bboxes", F.lit(0.0), lambda s, b: s + b[0])
    return a.join(v.select(F.col("id").alias("image_id")), "image_id").select("id", "image_id", "category_id", F.size("bboxes").cast("long").alias("frames"), F.round("area", 6).alias("area"), lefts.alias("lefts"))
