import random

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tesserae.llm.mixing import TARGETS, dimensions, mix, n_tokens, rake


def raked(cells, targets, sweeps=500):
    """Plain iterative proportional fitting: cells {(a, b): tokens}, targets a list of {value: share}."""
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    for _ in range(sweeps):
        for d, want in enumerate(targets):
            now = {}
            for k, v in w.items():
                now[k[d]] = now.get(k[d], 0) + v
            w = {k: v * want[k[d]] / now[k[d]] if now[k[d]] else 0.0 for k, v in w.items()}
    return w


def test_rake_matches_plain_fitting(spark):
    r = random.Random(3)
    cells = {(a, b): r.randrange(1, 900) for a in "xyz" for b in ("p", "q", None)}
    want_a = {"x": 0.2, "y": 0.5, "z": 0.3}
    total = sum(cells.values())
    by_b = {b: sum(v for k, v in cells.items() if k[1] == b) ** 0.5 for b in ("p", "q", None)}
    want_b = {b: v / sum(by_b.values()) for b, v in by_b.items()}
    df = spark.createDataFrame([(a, b, v) for (a, b), v in cells.items()], "a string, b string, tokens long")
    got = {(x.a, x.b): x.weight for x in rake(df, {"a": want_a, "b": 0.5}, tolerance=1e-10).collect()}
    expected = raked(cells, [want_a, want_b])
    assert total and got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in got)


def test_a_sample_meets_the_targets(spark):
    docs = spark.range(60_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.when(F.col("id") % 5 == 0, "de").otherwise("en").alias("lang"),
        (F.col("id") % 11 + 1).alias("tokens"),
    )
    got = mix(docs, {"source": 0.5, "lang": {"en": 0.5, "de": 0.5}}).cache()
    assert got.count() == 60_000
    kept = got.where("selected")
    total = kept.agg(F.sum("tokens")).first()[0]
    assert kept.where("lang = 'de'").agg(F.sum("tokens")).first()[0] / total == pytest.approx(0.5, abs=0.02)
    seen = {r.source: r.t for r in docs.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    root = sum(v**0.5 for v in seen.values())
    for r in kept.groupBy("source").agg(F.sum("tokens").alias("t")).collect():
        assert r.t / total == pytest.approx(seen[r.source] ** 0.5 / root, abs=0.02)
    assert got.agg(F.max("probability")).first()[0] == pytest.approx(1.0)
    again = mix(docs.repartition(7), {"source": 0.5, "lang": {"en": 0.5, "de": 0.5}})
    assert again.where("selected").agg(F.sum("doc_id")).first() == kept.agg(F.sum("doc_id")).first()


def test_cases(spark):
    import re

    docs = cases.documents(spark)
    counts = {r.doc_id: r.n for r in docs.select("doc_id", n_tokens(F.col("text")).alias("n")).collect()}
    assert counts == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(cases.texts())}
    got = mix(dimensions(docs, docs.columns), TARGETS).collect()
    assert len(got) == len(cases.texts())
    assert all(0 <= r.probability <= 1 and (r.tokens or not r.selected) for r in got)
    assert set(got[0].row.asDict()) == set(docs.columns)
    assert mix(dimensions(cases.empty(spark), ["doc_id"]), TARGETS).count() == 0


def test_no_python_on_executors(spark):
    import re

    docs = cases.documents(spark)
    assert not re.search("Python|Pandas|Arrow", mix(dimensions(docs, ["doc_id"]), TARGETS)._jdf.queryExecution().executedPlan().toString())


def test_input_columns_named_like_results(spark):
    docs = dimensions(cases.documents(spark), ["doc_id"]).withColumns({c: F.lit("clash") for c in ("weight", "probability", "selected", "cell", "doc", "ratio", "c_source", "v_lang", "share_lang")})
    got = mix(docs, TARGETS)
    assert {"doc_weight", "doc_probability", "doc_selected", "weight", "probability", "selected", "cell", "c_source"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == docs.count() and {(r.doc_weight, r.cell) for r in rows} == {("clash", "clash")}
    plain = mix(dimensions(cases.documents(spark), ["doc_id"]), TARGETS).collect()
    assert sorted((r.doc_id, r.probability, r.selected) for r in rows) == sorted((r.doc_id, r.probability, r.selected) for r in plain)
