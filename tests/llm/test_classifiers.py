import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm import cases
from tesserae.llm import quality_classifier, toxicity
from tesserae.llm.labelled import calibrated, held_out

SF = SF.replace("sf0.001", "sf0.1")


def judged(spark, found, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).collect()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r.y for r in rows])


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert found.count() == docs.count()
    s, p, y = judged(spark, found, "toxic")
    assert ((s >= 0) & (s <= 1)).all() and ((s >= 0.5) == p).all()
    assert p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.01


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = quality_classifier.quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert found.count() == docs.count()
    s, p, y = judged(spark, found, "quality")
    assert ((s >= 0.3) == p).all()
    assert p[y == 1].mean() > 0.99 and p[y == 0].mean() < 0.15


def toy(spark):
    r, docs, labels = random.Random(2), [], []
    for k in range(800):
        s = [cases.words(8, r.random(), 400).capitalize() + "." for _ in range(5)]
        bad = k % 4 == 0
        if bad:
            s[r.randrange(5)] = f"Well, you {r.choice(['vile', 'foul'])} thing!"
        docs.append((k, " ".join(s)))
        labels.append((k, int(not bad), int(bad)))
    docs = cases.documents(spark).select((F.col("doc_id") + 5000).alias("doc_id"), "text").unionByName(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("row", F.lit(1)).withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame(labels + [(5000, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_offending_sentences_are_found(spark):
    docs, labels = toy(spark)
    got = toxicity.toxicity(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id < 800:
            said = [r.text[o.start : o.end] for o in r.offending]
            assert [("vile" in x or "foul" in x) for x in said] == [True] * (r.doc_id % 4 == 0) and r.predicted == (r.doc_id % 4 == 0)
        elif not (r.text or "").strip():
            assert r.score == 0.0


def test_cases_and_folds(spark):
    docs, labels = toy(spark)
    got = quality_classifier.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality_classifier.quality):
        assert f(cases.empty(spark), none).count() == 0
        assert f(docs, none).count() == docs.count()
    assert spark.createDataFrame([(None,)], "x long").select(held_out(F.col("x"))).first()[0] is True


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = toy(spark)
    other = labels.withColumns({c: F.when(held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for f in (toxicity.toxicity, quality_classifier.quality):
        a, b = (sorted((r.doc_id, r.score) for r in f(docs, x).collect()) for x in (labels, other))
        assert a == b


def test_calibration_follows_the_margin():
    m = np.linspace(-3, 3, 200)
    a, b = calibrated(m, (m > 0.5).astype(int))
    assert a > 0 and 1 / (1 + np.exp(-(a * 0.5 + b))) > 0.3
