"""Sinks: splits, counts, COCO, YOLO and VOC files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.lineage import settled


def write_splits(df: DataFrame, path: str) -> None:
    """One write, a folder per split: never a pass per split."""
    df.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def write_counts(df: DataFrame, path: str, label: str = "label") -> None:
    """Rows per split and class; the class is kept."""
    df.groupBy("split", label).agg(F.count("*").alias("count")).write.mode("overwrite").option("header", True).csv(path)


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, corners: bool = False) -> DataFrame:
    """One JSON row. With ``corners`` a box is [x1, y1, x2, y2]. A COCO document is one file by definition; larger sets stay tables."""
    if corners:
        x, y, w, h = (F.get("bbox", F.lit(k)) for k in range(4))
        annotations = annotations.withColumn("bbox", F.array(x, y, x + w, y + h))
    rows = lambda d, name: d.agg(F.sort_array(F.collect_list(F.struct(*(F.col(c) for c in ["id", *(c for c in d.columns if c != "id")])))).alias(name))
    one = rows(images, "images").crossJoin(rows(annotations, "annotations")).crossJoin(rows(categories, "categories"))
    return one.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, corners: bool = False) -> None:
    """One COCO file of tables of any size: executors write each table as JSON lines beside it, and the driver joins those files by streaming them, one block at a time.

    A record has a line of its own, so tasks can share the file (``images.coco`` with ``lines``)."""
    from tesserae.sources.files import joined

    if corners:
        x, y, w, h = (F.get("bbox", F.lit(k)) for k in range(4))
        annotations = annotations.withColumn("bbox", F.array(x, y, x + w, y + h))
    parts = {"images": images, "annotations": annotations, "categories": categories}
    for name, d in parts.items():
        d.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}.{name}")
    joined(path, {name: f"{path}.{name}" for name in parts})


def yolo_line(category, x, y, w, h, width, height):
    return F.format_string("%d %.6f %.6f %.6f %.6f", category, (x + w / 2) / width, (y + h / 2) / height, w / width, h / height)


def yolo_polygon(category, polygon, width, height):
    """A line of a polygon's points, x and y in turn, in shares of the image."""
    parts = F.transform(polygon, lambda v, i: F.format_string("%.6f", F.when(i % 2 == 0, v / width).otherwise(v / height)))
    return F.concat_ws(" ", category.cast("string"), F.array_join(parts, " "))


def data_yaml(names: list[str], train: str = "images") -> str:
    """Class names in order, each once, in quotes."""
    kept = list(dict.fromkeys(names))
    return f"train: {train}\nnc: {len(kept)}\nnames: [{', '.join(chr(34) + n + chr(34) for n in kept)}]\n"


def write_yolo(boxes: DataFrame, path: str, names: list[str] | None = None) -> None:
    """boxes: stem, category, x, y, w, h, width, height and, for lines of polygons, polygon. ``labels`` has a folder per image stem, with its lines; with ``names`` (few) a ``data.yaml``."""
    line = yolo_line(F.col("category"), *(F.col(c).cast("double") for c in ("x", "y", "w", "h", "width", "height")))
    if "polygon" in boxes.columns:
        line = F.when(F.size("polygon") > 0, yolo_polygon(F.col("category"), F.col("polygon"), F.col("width"), F.col("height"))).otherwise(line)
    boxes.select("stem", line.alias("value")).write.mode("overwrite").partitionBy("stem").text(f"{path}/labels")
    if names is not None:
        from tesserae.sources.files import put

        put(f"{path}/data.yaml", data_yaml(names))


_LARGE = 100_000  # objects of a document that a row may hold

_DOCUMENT = ["stem", "width", "height"]


def write_voc(boxes: DataFrame, path: str, large: int = _LARGE) -> None:
    """``Annotations``: a folder per image stem with its document; ``ImageSets/Main/default``: the stems.

    A document is one line. One of more than ``large`` objects is a file of its own with an object a line: its lines are sorted in ranges, written compressed beside, and a task
    a document joins them in blocks, so neither a row nor a task holds a document.
    """
    of = boxes.groupBy(*_DOCUMENT).agg(F.count("*").alias("n")).where(F.col("n") > large).select(*(F.col(c).alias(f"_{c}") for c in _DOCUMENT))
    of = settled(of)  # read twice or more
    same = lambda d: [d[c].eqNullSafe(F.col(f"_{c}")) for c in _DOCUMENT]
    few = of.isEmpty()
    docs = voc_document(boxes if few else boxes.join(of, same(boxes), "left_anti"))
    docs.select("stem", F.col("xml").alias("value")).write.mode("overwrite").partitionBy("stem").text(f"{path}/Annotations")
    if not few:
        _write_large(boxes.join(of, same(boxes), "left_semi"), of.select(*(F.col(f"_{c}").alias(c) for c in _DOCUMENT)), f"{path}/Annotations")
    boxes.select(F.col("stem").alias("value")).distinct().write.mode("overwrite").text(f"{path}/ImageSets/Main/default")


def _write_large(boxes: DataFrame, of: DataFrame, path: str) -> None:
    from tesserae.sources.files import concatenated, folders, removed

    line = lambda part, value: [*_DOCUMENT, F.lit(part).alias("part"), value.alias("value")]
    ends = of.select(*line(0, _head())).unionAll(of.select(*line(2, F.lit("</annotation>"))))
    order = [*_DOCUMENT, "part", "value"]
    lines = boxes.select(*line(1, _thing())).unionAll(ends).repartitionByRange(*order).sortWithinPartitions(*order)
    beside = f"{path}.large"
    lines.select(*_DOCUMENT, "value").write.mode("overwrite").option("compression", "gzip").partitionBy(*_DOCUMENT).text(beside)

    def join(batches):
        for batch in batches:
            for at in batch.column("at").to_pylist():
                stem, width, height = at.split("/")
                concatenated(path, f"{stem}/{width.partition('=')[2]}x{height.partition('=')[2]}.xml", beside, at)
            yield batch

    found = folders(beside)
    boxes.sparkSession.createDataFrame([(at,) for at in found], "at string").repartition(len(found)).mapInArrow(join, "at string").count()
    removed(beside)


def write_table(df: DataFrame, path: str) -> None:
    """Embeddings, metrics, predictions, evaluations: CSV with a header. Arrays are widened before (``functions.columns.widened``)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_pivot(df: DataFrame, path: str) -> None:
    """Tab-separated figures with four decimals."""
    cols = [F.format_string("%.4f", F.col(f"`{c}`").cast("double")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def _thing():
    return F.format_string("<object><name>%s</name><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>", "name", F.col("x").cast("int"), F.col("y").cast("int"), (F.col("x") + F.col("w")).cast("int"), (F.col("y") + F.col("h")).cast("int"))


def _head():
    return F.format_string("<annotation><filename>%s</filename><size><width>%d</width><height>%d</height><depth>3</depth></size>", *_DOCUMENT)


def voc_document(boxes: DataFrame) -> DataFrame:
    """stem, xml: boxes (stem, name, x, y, w, h, width, height) as one document per image."""
    d = boxes.groupBy(*_DOCUMENT).agg(F.array_join(F.sort_array(F.collect_list(_thing())), "").alias("things"))
    return d.select("stem", F.concat(_head(), "things", F.lit("</annotation>")).alias("xml"))


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
