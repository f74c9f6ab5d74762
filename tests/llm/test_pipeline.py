import corpus_pipeline as P
from tests.conftest import SF
from tests.llm import cases
from tests.llm.test_simhash import plain_components
from tesserae.llm.decontaminate import brute_force

SF = SF.replace("sf0.001", "sf0.01")


def stage(spark, k, docs, tmp_path):
    P.STAGES[k][1](spark, docs, SF).write.parquet(out := f"file://{tmp_path}/{k}")
    return spark.read.parquet(out)


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stage(spark, 0, docs, tmp_path)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    unique = stage(spark, 1, kept, tmp_path)
    groups = plain_components([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in unique.collect()) == sorted({c for _, c in groups.values()})
    clean = stage(spark, 2, unique, tmp_path)
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_force(rows, items)
    got = {r.doc_id: r for r in clean.collect()}
    assert got.keys() == {d for d, _ in rows if len(hits[d][2]) < 2}
    assert all(got[d].text == t for d, t in rows if d in got and not hits[d][1])
    assert not any(x[1] and len(got[d].text) >= len(dict(rows)[d]) for d, x in hits.items() if d in got)
    mixed = stage(spark, 3, clean, tmp_path)
    assert mixed.columns == docs.columns and 0.3 * clean.count() < mixed.count() <= clean.count()
    assert not set(map(tuple, mixed.collect())) - set(map(tuple, clean.collect()))
    out = stage(spark, 4, mixed, tmp_path)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixed.collect())


def test_run(spark):
    assert P.run(spark, SF).count() > 100


def test_stages_stand_odd_tables(spark, tmp_path):
    for n, docs in enumerate((cases.documents(spark), cases.empty(spark))):
        for k in range(4):
            (tmp_path / str(n)).mkdir(exist_ok=True)
            after = stage(spark, k, docs, tmp_path / str(n))
            assert after.columns == docs.columns
            docs = after if after.count() else docs
        assert stage(spark, 4, docs, tmp_path / str(n)).count() == docs.count()
