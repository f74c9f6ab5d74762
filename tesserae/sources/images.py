"""Scans: labelled tables with a declared schema, image folders, COCO documents and tracking text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.numbering import numbered_rows

LABELLED = T.StructType([T.StructField("image", T.StringType()), T.StructField("label", T.StringType())])
#: Suffixes that count as images and as videos, in lower case.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
VIDEO_SUFFIXES = ("mp4", "avi", "mov", "mkv", "webm", "flv", "wmv", "m4v", "mpg", "mpeg", "3gp", "ts")

COCO = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
        T.StructField(
            "annotations",
            T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("area", T.DoubleType()), T.StructField("iscrowd", T.IntegerType()), T.StructField("score", T.DoubleType())])),
        ),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
    ]
)


def labelled_csv(spark: SparkSession, path: str, require_label: bool = True) -> DataFrame:
    """A table with ``image``, and ``label`` where required; other columns are not read. Missing columns are an error of the plan."""
    df = spark.read.option("header", True).csv(path)
    want = ["image", "label"] if require_label else ["image"]
    if lacking := [c for c in want if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    return df.select(*want)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, recursive: bool = False, content: bool = False) -> DataFrame:
    """Files of a folder by suffix, in any case: path, length and, if asked for, content, which is else never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).where(suffix(F.col("path")).isin(*suffixes))
    return df.select("path", "length", *(["content"] if content else []))


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Images (by suffix) decoded by the JVM: path, width, height, channels, bytes (BGR); a file that can't be decoded has null bytes."""
    d = spark.read.format("image").load(folder).where(suffix(F.col("image.origin")).isin(*IMAGE_SUFFIXES))
    ok = F.col("image.width") > 0
    return d.select(F.col("image.origin").alias("path"), *(F.when(ok, F.col(f"image.{c}")).alias(a) for c, a in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "bytes"))))


def pixel_md5(images: DataFrame) -> DataFrame:
    """md5 of the decoded bytes; size and mode are not part of it."""
    return images.select("path", F.md5("bytes").alias("md5"))


def coco(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of COCO documents. A document is read whole by one task; with ``lines``, which takes documents as ``sinks.write_coco`` lays them
    out (a record a line), tasks share it."""
    names = ("images", "annotations", "categories")
    if not lines:
        d = spark.read.schema(COCO).option("multiLine", True).json(path)
        return tuple(d.select(F.explode(c).alias("x")).select("x.*") for c in names)
    d, value = spark.read.option("lineSep", "\n").text(path), F.col("value")
    frame = ['{"images": [', '], "annotations": [', '], "categories": [', "]}"]

    def records(k: int) -> DataFrame:
        at = [value.startswith(" " * (n + 1) + "{") for n in range(len(names))]
        known = at[0] | at[1] | at[2] | value.isin(*frame)
        mine = F.when(at[k], True).when(known, False).otherwise(F.raise_error(F.concat(F.lit("no record on this line of a COCO document: "), F.substring(value, 1, 80))).cast("boolean"))
        own = F.when(at[k], F.rtrim(value, F.lit(",")))  # a plan may read a record before it leaves other lines out
        x = F.from_json(own, COCO[names[k]].dataType.elementType, {"mode": "FAILFAST"})
        return d.where(mine).select(F.inline(F.array(x)))  # filters on fields stay above, so a line is parsed once

    return tuple(records(k) for k in range(len(names)))


def results(predictions: DataFrame, images: DataFrame) -> DataFrame:
    """Predictions (image_id, category_id, bbox, score) as annotations: area, polygon of the box, id by image and score. An image that isn't known is an error."""
    known = predictions.join(images.select(F.col("id").alias("image_id"), F.lit(True).alias("known")), "image_id", "left")
    x, y, w, h = (F.get("bbox", F.lit(k)) for k in range(4))
    checked = known.withColumn("image_id", F.when(F.col("known"), F.col("image_id")).otherwise(F.raise_error(F.concat(F.lit("unknown image "), F.col("image_id").cast("string"))).cast("long")))
    return numbered_rows(checked, ["image_id", -F.col("score"), "category_id", "bbox"], "id").select(
        F.col("id").cast("long").alias("id"),
        "image_id", "category_id", "bbox", "score", (w * h).alias("area"), F.array(F.array(x, y, x, y + h, x + w, y + h, x + w, y)).alias("segmentation"), F.lit(0).alias("iscrowd"),
    )


MOT = "frame long, id long, x double, y double, w double, h double, conf double, class long, visibility double"


def tracks(spark: SparkSession, path: str, classes: list[int] | None = None, drop_negative: bool = True) -> DataFrame:
    """Tracking text: a line per box; ids below 0 and classes not listed are left out."""
    d = spark.read.schema(MOT).csv(path)
    if drop_negative:
        d = d.where("id >= 0")
    return d.where(F.col("class").isin(*classes)) if classes else d


def resolved(table: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose image is in the listing (by name), and the names that are missing."""
    names = listing.select(F.element_at(F.split("path", "/"), -1).alias("image"))
    return table.join(names, "image", "left_semi"), table.join(names, "image", "left_anti").select("image").distinct()


TRACKLETS = "struct<id:long,video_id:long,category_id:long,bboxes:array<array<double>>,areas:array<double>,iscrowd:int>"


def tracklets(spark: SparkSession, path: str, one_class: bool = False, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Videos and annotations of YT-VIS documents. A video is an image, an absent box is [0, 0, 0, 0], an absent area 0; ``area`` is the mean over the frames.

    ``one_class``: all categories are -1. A document is read whole by one task; a file may hold one, or with ``lines`` one a line.
    """
    d = spark.read.schema(f"videos array<struct<id:long,height:int,width:int,length:int>>, annotations array<{TRACKLETS}>").option("multiLine", not lines).json(path)
    v = d.select(F.explode("videos").alias("x")).select("x.*")
    a = d.select(F.explode("annotations").alias("x")).select("x.*")
    return v, _tracked(a.withColumnRenamed("video_id", "image_id"), one_class)


def _tracked(a: DataFrame, one_class: bool) -> DataFrame:
    none = F.array(*(F.lit(0.0) for _ in range(4)))
    a = a.withColumns({"bboxes": F.transform("bboxes", lambda b: F.coalesce(b, none)), "areas": F.transform("areas", lambda x: F.coalesce(x, F.lit(0.0)))})
    mean = F.when(F.size("areas") > 0, F.aggregate("areas", F.lit(0.0), lambda s, x: s + x) / F.size("areas"))
    return a.withColumns({"category_id": F.lit(-1).cast("long") if one_class else F.col("category_id"), "area": mean})


def tracklet_results(predictions: DataFrame, videos: DataFrame) -> DataFrame:
    """Predicted tracklets (image_id, category_id, bboxes, score) as annotations: areas of boxes, their mean, ids in order of image and score. An image that isn't known is an error."""
    known = predictions.join(videos.select(F.col("id").alias("image_id"), F.lit(True).alias("known")), "image_id", "left")
    checked = known.withColumn("image_id", F.when(F.col("known"), F.col("image_id")).otherwise(F.raise_error(F.concat(F.lit("unknown image "), F.col("image_id").cast("string"))).cast("long"))).drop("known")
    sized = checked.withColumn("areas", F.transform("bboxes", lambda b: b[2] * b[3])).withColumn("iscrowd", F.lit(0))
    return numbered_rows(_tracked(sized, False), ["image_id", -F.col("score"), "category_id", "bboxes"], "id")


def shard_of_epoch(shards: list[str], epoch: int) -> str:
    """Annotation shards are taken in turn, one an epoch."""
    return shards[epoch % len(shards)]


def tar_members(spark: SparkSession, folder: str) -> DataFrame:
    """Files in the tar archives of a folder: archive, member, size and content. An archive is streamed by one task, a member at a time."""

    def members(batches):
        import io
        import tarfile

        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            yield pd.DataFrame({"archive": [path], "member": [m.name], "size": [m.size], "content": [tar.extractfile(m).read()]})

    return files(spark, folder, ("tar",), content=True).select("path", "content").mapInPandas(members, "archive string, member string, size long, content binary")
